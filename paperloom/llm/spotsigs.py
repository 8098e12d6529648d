"""Document fingerprints by spot signatures.

A signature is a common word (the anchor) and the ``CHAIN`` content words that follow it, at a
distance of ``SPACING`` content words. The set of a text's signatures is its fingerprint, written as sorted
8-digit hexadecimal numbers in a row. Sets are partitioned by their size into bands that grow by
1/0.8, and two sets are compared by their Jaccard similarity, which their sizes alone can rule out.

Fingerprints are one narrow pass over whole texts. ``edited`` gives each document the next one by
descending id: documents are dealt to ranges of the id (one shuffle of the texts, by range, so that a task has about one), and the first
document of each range is sent to the range before as well, so no row needs a global order.

Defined cases: null is the empty text; an empty text has an empty fingerprint, like only to
another empty one; a text without an anchor takes every content word for an anchor; a text
without content words is one signature of its bytes; null ids come last; equal ids are ordered by text; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import as_bytes, mix, slices, word_hashes_of, words
from paperloom.session import written as stored

CHAIN = 2
SPACING = 1
BAND = 0.8
#: Common words of the languages at hand, the anchors.
ANCHORS = (
    "a an the is are was were be been of in on at by for with to and or from that this it as "
    "le la les un une des du de et est en dans pour par sur avec que qui ne pas "
    "der die das ein eine den dem und ist in zu von mit auf für nicht sich "
    "el los las una unos y es en por con para se no su al del lo"
)
_ANCHOR_HASHES = np.unique(words(ANCHORS.encode())[0])


def signature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    n = len(texts)
    hashes, bounds = word_hashes_of(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    place = np.minimum(np.searchsorted(_ANCHOR_HASHES, hashes), len(_ANCHOR_HASHES) - 1)
    anchor = _ANCHOR_HASHES[place] == hashes
    content = np.flatnonzero(~anchor)
    with_anchor = np.bincount(owner[anchor], minlength=n) > 0
    spots = np.flatnonzero(anchor | ~with_anchor[owner])
    after = np.searchsorted(content, spots, side="right")
    chain = hashes[spots]
    length = np.zeros(len(spots), dtype=np.int64)
    for step in range(CHAIN):
        at = after + step * SPACING + SPACING - 1
        inside = at < len(content)
        at = np.minimum(at, max(len(content) - 1, 0))
        word = content[at] if len(content) else np.zeros(len(spots), dtype=np.int64)
        inside &= owner[word] == owner[spots] if len(content) else False
        chain = np.where(inside, mix(chain, step + 1) ^ hashes[word], chain) if len(hashes) else chain
        length += inside
    kept = length > 0
    # a text of one content word and no anchor has no chain; the word stands for itself
    kept |= ~with_anchor[owner[spots]] & (np.bincount(owner, minlength=n)[owner[spots]] == 1) if len(spots) else kept
    cells = np.unique((owner[spots][kept] << 32) | (mix(chain[kept], 31) >> np.uint64(32)).astype(np.int64))
    cut = np.searchsorted(cells, np.arange(n + 1, dtype=np.int64) << 32)
    low = (cells & 0xFFFFFFFF).astype(np.uint32)
    sets = [low[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for i, text in enumerate(texts):
        if text and not len(sets[i]):
            sets[i] = np.frombuffer(hashlib.sha256(text).digest()[:4], dtype=">u4").astype(np.uint32)
    return sets


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def band(size: int) -> int:
    """The size partition; sets of similarity BAND or more lie in the same or in neighbouring ones."""
    return int(np.floor(np.log(max(size, 1)) / -np.log(BAND)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 without a comparison if sizes rule ``least`` out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_signatures, band, fingerprint for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = signature_sets(as_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([band(len(s)) for s in sets], pa.int32()), pa.array([written(s) for s in sets], pa.string())],
                    names=["doc_id", "n_signatures", "band", "fingerprint"],
                )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_signatures long, band int, fingerprint string")


def matches(docs: DataFrame, queries: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, likeness) of each query text's matches among all documents, likeness of ``least`` (above 0) or more.

    Rows of equal fingerprints are one set until the end. A set's first signatures, in the order of their hashes, are as many as may be missing from a
    match and one more; two matching sets share one of these, and their sizes lie within ``least`` of each other. So sets meet by size band and
    first signatures in a hash join of short rows, and only pairs whose sizes allow it are compared. Empty texts match none.
    """
    spread = int(np.ceil(np.log(least) / np.log(BAND) - 1e-9))
    known = [stored(fingerprints(df, doc_id, text).where("n_signatures > 0").withColumn("set", F.xxhash64("fingerprint"))) for df in (queries, docs)]
    sets = [df.groupBy("set").agg(F.first("n_signatures").alias("size"), F.first("band").alias("band"), F.first("fingerprint").alias("fingerprint")) for df in known]

    def firsts(rows: DataFrame, name: str, bands: range) -> DataFrame:
        pieces = F.regexp_extract_all("fingerprint", F.lit("(.{8})"))
        hashed = F.array_sort(F.transform(pieces, lambda x: F.xxhash64(x)))
        chosen = F.slice(hashed, F.lit(1), (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))
        near = F.explode(F.array(*[F.col("band") + d for d in bands])).alias("near")
        return rows.select(F.col("set").alias(f"{name}_set"), F.col("size").alias(f"{name}_size"), F.explode(chosen).alias("first"), "band").select("*", near).drop("band")

    met = firsts(sets[0], "query", range(-spread, spread + 1)).join(firsts(sets[1], "other", range(1)), ["first", "near"])
    allowed = F.least("query_size", "other_size") >= least * F.greatest("query_size", "other_size") - 1e-9
    pairs = met.where(allowed).select("query_set", "other_set").distinct()
    for rows, name in zip(sets, ("query", "other"), strict=True):
        pairs = pairs.join(rows.select(F.col("set").alias(f"{name}_set"), F.col("fingerprint").alias(name)), f"{name}_set")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(parsed(x), parsed(y), least) for x, y in zip(a, b, strict=True)])

    scored = pairs.select("query_set", "other_set", alike.asNondeterministic()("query", "other").alias("likeness")).where(F.col("likeness") >= least)
    asked = known[0].select(F.col("set").alias("query_set"), F.col("doc_id").alias("query_id"))
    found = known[1].select(F.col("set").alias("other_set"), "doc_id")
    return scored.join(asked, "query_set").join(found, "other_set").select("query_id", "doc_id", "likeness")


def _ranges(docs: DataFrame, ranges: int) -> np.ndarray:
    """Existing ids, descending, that each begin a range; the first is the largest id."""
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.count()
    if not n:
        return np.empty(0, dtype=np.int64)
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (ranges * 20)))) == 0).distinct().toArrow().column("doc_id").to_numpy()
    top = ids.agg(F.max("doc_id").alias("top")).first()["top"]
    some = np.unique(some)[::-1]
    picked = some[:: max(1, len(some) // ranges)]
    return np.unique(np.concatenate([[top], picked]).astype(np.int64))[::-1].copy()


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text, and their and its neighbour's likeness.

    The edited text: the last half (rounded down) of the code points gives way to the first as many of the next
    document, by descending id; after the last comes the first. Ids are integers.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = _ranges(narrow, ranges)
    ascending = heads[::-1].copy()

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        """The row's range, and for a range's first id the range before."""
        if not len(ascending):
            return pd.Series([[0]] * len(ids))
        known = ids.notna().to_numpy()
        values = ids.fillna(0).astype("int64").to_numpy()
        up = np.searchsorted(ascending, values, side="left")
        own = np.where(known, len(ascending) - 1 - np.minimum(up, len(ascending) - 1), len(ascending) - 1)
        first = known & (ascending[np.minimum(up, len(ascending) - 1)] == values)
        return pd.Series([[int(p), int(p - 1) % len(ascending)] if f else [int(p)] for p, f in zip(own, first, strict=True)])

    rows = narrow.withColumn("parts", parts("doc_id")).select("doc_id", "text", F.posexplode("parts").alias("tail", "part"))
    dealt = rows.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int | None, str] | None = None  # the last document, whose next is not known yet
        first: tuple[int | None, str] | None = None
        part = None
        work: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for own, value, tail, where in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if where != part:
                    if waiting is not None and first is not None:
                        work.append((*waiting, first[1]))
                    part, waiting, first = where, None, None
                if waiting is not None:
                    work.append((*waiting, value))
                    size += len(waiting[1]) + len(value)
                    waiting = None
                if not tail:
                    waiting = (own, value)
                    first = first or waiting
                if size > 1 << 20:
                    yield _compared(work)
                    work, size = [], 0
        if waiting is not None and first is not None:
            work.append((*waiting, first[1]))
        yield _compared(work)

    return dealt.select("doc_id", "text", "tail", "part").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _compared(work: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of (id, text, next text); the next text is mostly the text of the row after."""
    changed = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for _, t, n in work]
    number: dict[str, int] = {}
    for _, t, n in work:
        number.setdefault(t, len(number))
        number.setdefault(n, len(number))
    sets = signature_sets([t.encode() for t in number])
    edits = signature_sets(changed)
    own, after = [sets[number[t]] for _, t, _ in work], [sets[number[n]] for _, _, n in work]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([w[0] for w in work], pa.int64()), pa.array([len(w[1]) for w in work], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array([written(s) for s in own], pa.string()), pa.array([written(s) for s in edits], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, edits, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
