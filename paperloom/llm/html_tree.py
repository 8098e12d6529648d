"""Main text of web pages by site style trees.

1. Every page is parsed once into style nodes: a node is the path of elements (tag, classes, id
   without digits) from the root, so like elements of one page merge. For each node of a page,
   its presentation (the order of its children) and its content (the text below it) are hashed.
2. Different pages of one host merge (copies of a page count once): counts by (host, node, hash) give the entropy of presentation and content
   of each node, as a share of the entropy that as many different pages would have. Importance is
   their mean, weighted by ``CONTENT_WEIGHT``. ``PRIOR`` pages unlike all others are counted besides, so that few pages say little and no size of
   host is treated apart: a branch that is the same on all pages is low from six pages on. Nodes below ``least_importance`` are the low branches of the host.
3. Pages are parsed again and lose the low branches of their host, besides the branches whose
   element, role or name says what they are (menus, footers, forms, adverts, comments and so on) and that do not hold the article (``html_page``).

At scale: only hashes are shuffled for 2, dealt by (host, node, hash, page) and then pre-aggregated by
(host, node, hash), so one host with a third of all pages spreads over its pages. Low branches are one row for each host; they are broadcast
when their measured size allows, else joined with the pages salted by ``SALTS``.

Blocks are the runs of text between block elements; inside a block character references are
decoded and white space becomes one space. If article elements have more text than is outside them that does not count; else the same
holds for main elements; else all text counts but lists of links.

Defined cases: null or empty html has an empty text; a null url has no host and no tree, so only elements and names count there; unclosed elements end with their
parents, unclosed scripts, styles, comments and other raw text with the page, and a tag that never ends is dropped; if the low branches hold all of a page's text they are kept;
equal importance and threshold keep a node; among article elements of equal length the first decides; very long and deeply nested or broken pages take
time in proportion to their length; repeated pages have a row each; other columns, of whatever name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.html_page import Page, main_text, style_rows
from paperloom.llm.words import slices
from paperloom.session import checkpoint

CONTENT_WEIGHT = 0.9
PRIOR = 1
BROADCAST_BYTES = 32 << 20
SALTS = 32


def _style_rows(source: str | None) -> list[tuple[int, int, int, int]]:
    """(node, presentation, content, page) for the nodes of a page."""
    if not source:
        return []
    whole = xxhash.xxh64_intdigest(source.encode("utf-8", "replace")) >> 1
    return [(node, *row, whole) for node, row in style_rows(Page(source)).items()]


def _host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def importance(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, node, pages (different ones), importance (0 to 1) of the style nodes of all hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                hosts, found = batch.column(0).to_pylist(), [_style_rows(x) for x in batch.column(1).to_pylist()]
                flat = [(h, *row) for h, rows in zip(hosts, found, strict=True) for row in rows]
                columns = list(zip(*flat, strict=True)) or [(), (), (), (), ()]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "node", "shape", "content", "page"])

    rows = pages.select(_host(url).alias("host"), F.col(source).cast("string").alias("html")).where("host <> ''")
    rows = rows.mapInArrow(run, "host string, node long, shape long, content long, page long")
    counts = rows.groupBy("host", "node", "shape", "content").agg(F.count_distinct("page").alias("n"))

    def entropy(column: str) -> DataFrame:
        each = counts.groupBy("host", "node", column).agg(F.sum("n").alias("n"))
        return each.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("weighted"))

    content, shape = entropy("content"), entropy("shape").select("host", "node", F.col("weighted").alias("shape_weighted"))

    def share(weighted: str) -> F.Column:
        all_pages = F.col("pages") + PRIOR
        return 1 - F.col(weighted) / (all_pages * F.log(all_pages))

    both = content.join(shape, ["host", "node"])
    return both.select("host", "node", "pages", (CONTENT_WEIGHT * share("weighted") + (1 - CONTENT_WEIGHT) * share("shape_weighted")).alias("importance"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", least_importance: float = 0.25) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every page."""
    low = importance(pages, url, source).where(F.col("importance") < least_importance)
    low = checkpoint(low.groupBy("host").agg(F.collect_list("node").alias("low")))
    size = low.agg(F.coalesce(F.sum(F.length("host") + 8 * F.size("low") + 64), F.lit(0)).alias("size")).first()["size"]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"), _host(url).alias("host"))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                lows: dict[tuple[int, ...], frozenset[int]] = {}
                texts = []
                for html, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    key = tuple(nodes or ())
                    texts.append(main_text(Page(html), lows.setdefault(key, frozenset(key))) if html else "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], names=["page_id", "url", "text", "n_chars"]
                )

    narrow = rows.select("page_id", "url", "html", "low")
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
