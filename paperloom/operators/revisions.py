"""Differences between consecutive texts of a paper, and where they lie in the newer one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.slices import by_slices

CONTEXT = 3
PREFIX = 10
#: Cells of a table of lines that is kept while two texts are aligned; larger ones are halved.
CELLS = 1 << 26
_FIELDS = ("context_before", "context_after", "original_lines", "modified_lines")


def _places(lines: list[int]) -> dict[int, int]:
    """For each line the bits of its places."""
    out: dict[int, int] = {}
    for at, line in enumerate(lines):
        out[line] = out.get(line, 0) | 1 << at
    return out


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    where, full = _places(b), (1 << len(b)) - 1
    v = full
    for line in a:
        u = v & where.get(line, 0)
        v = (v + u | v - u) & full
    grown = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(grown[: len(b)], dtype=np.int64)])


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of line numbers.

    Equal lines at both ends are paired first. A row of the table of lengths is one number with a bit for each line of b, where a bit that is off marks
    a place at which the length grows; rows are kept and walked back. Tables of more than ``CELLS`` bits are halved at the best place first, so memory stays bounded.
    """
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        low, high, first, last = parts.pop()
        while low < high and first < last and a[low] == b[first]:
            out.append((low, first))
            low, first = low + 1, first + 1
        while low < high and first < last and a[high - 1] == b[last - 1]:
            high, last = high - 1, last - 1
            out.append((high, last))
        x, y = a[low:high], b[first:last]
        if not x or not y:
            continue
        if len(x) * len(y) > CELLS and len(x) > 1:
            half = len(x) // 2
            at = int((_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]).argmax())
            parts += [(low, low + half, first, first + at), (low + half, high, first + at, last)]
            continue
        where, full, rows = _places(y), (1 << len(y)) - 1, []
        v = full
        for line in x:
            u = v & where.get(line, 0)
            v = (v + u | v - u) & full
            rows.append(v)
        i, j = len(x), len(y)
        while i and j:
            if rows[i - 1] >> j - 1 & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> j - 1 & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((low + i, first + j))
    return sorted(out)


def _of_pair(old: str | None, new: str | None) -> list[dict[str, str]]:
    """The hunks between two texts: changes with up to ``CONTEXT`` equal lines around them, one hunk where these would meet."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    numbers: dict[str, int] = {}
    pairs = common_lines(*([numbers.setdefault(line, len(numbers)) for line in lines] for lines in (a, b)))
    changes, i, j = [], 0, 0  # (first, after) in a and in b
    for x, y in [*pairs, (len(a), len(b))]:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for change in changes:
        if groups and change[0] - groups[-1][-1][1] <= 2 * CONTEXT:
            groups[-1].append(change)
        else:
            groups.append([change])
    out = []
    for group in groups:
        first, last = group[0][0], group[-1][1]
        between = [line for before, after in zip(group, group[1:], strict=False) for line in a[before[1] : after[0]]]
        parts = {
            "context_before": a[max(0, first - CONTEXT) : first], "context_after": between + a[last : last + CONTEXT],
            "original_lines": [line for c in group for line in a[c[0] : c[1]]], "modified_lines": [line for c in group for line in b[c[2] : c[3]]],
        }
        out.append({name: " ".join(filter(None, map(str.strip, lines))) for name, lines in parts.items()})
    return out


_hunks = by_slices(
    f"array<struct<{', '.join(f'{name}: string' for name in _FIELDS)}>>",
    lambda old, new: pa.array([_of_pair(x, y) for x, y in zip(old, new, strict=True)], pa.list_(pa.struct([(name, pa.string()) for name in _FIELDS]))),
)


def hunks(pairs: DataFrame) -> DataFrame:
    """(pair, hunk, context_before, context_after, original_lines, modified_lines) from (pair, old, new) texts.

    One narrow pass: each pair's lines are aligned by a longest common subsequence, whatever their number and however often a line occurs, and set as a unified diff
    with ``CONTEXT`` lines around each change. Lines are trimmed and joined by a blank, blank ones left out; a null text has no lines; equal texts have no hunk.
    """
    found = pairs.select("pair", F.posexplode(_hunks("old", "new")).alias("at", "h"))
    return found.select("pair", (F.col("at") + 1).alias("hunk"), *[F.col(f"h.{name}") for name in _FIELDS])


def _start(c: Column | str, n: int = PREFIX) -> Column:
    return F.substring(c, 1, n)


def located(diffs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Hunks with the places, in the newer text, of their change and of what stood before and after it.

    diffs: pair, hunk, context_before, context_after, modified_lines; paragraphs: pair, paragraph_idx, section, content. A paragraph qualifies if it contains the first ten characters of
    modified_lines. Each context lies in that paragraph if it contains the context's first ten characters, else in the one before (after) it if that does, else nowhere (null). Of several
    paragraphs the one with most contexts placed is taken, then the first. Pure deletions have no place. Adds section, paragraph_idx, before_section, before_paragraph_idx,
    after_section and after_paragraph_idx.

    The starts of a pair's hunks meet its paragraphs as hashes: a paragraph's runs of as many characters are intersected with them, so rows after the join are true hits (and
    equal hashes, which the texts then tell apart), not hunks times paragraphs.
    """
    order = Window.partitionBy("pair").orderBy("paragraph_idx")
    own = F.struct("section", "paragraph_idx", "content")
    near = paragraphs.select("pair", own.alias("here"), F.lag(own).over(order).alias("before"), F.lead(own).over(order).alias("after"))
    runs = lambda chars, n: F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.xxhash64(F.slice(chars, i, n)))
    wanted = diffs.where("modified_lines <> ''").select("pair", "hunk", "context_before", "context_after", _start("modified_lines").alias("start"))
    wanted = wanted.withColumn("mark", F.xxhash64(F.split("start", "")))
    starts = wanted.groupBy("pair", F.length("start").alias("n")).agg(F.collect_set("mark").alias("marks")).groupBy("pair").agg(F.collect_list(F.struct("n", "marks")).alias("starts"))
    chars = near.join(starts, "pair").withColumn("chars", F.split("here.content", ""))
    mine = F.flatten(F.transform("starts", lambda s: F.when(F.size("chars") >= s["n"], F.array_intersect(runs(F.col("chars"), s["n"]), s["marks"])).otherwise(F.array().cast("array<bigint>"))))
    hits = chars.select("pair", "here", "before", "after", F.explode(F.array_distinct(mine)).alias("mark"))
    found = hits.join(wanted, ["pair", "mark"]).where(F.col("here.content").contains(F.col("start")))

    def place(context: str, other: str) -> Column:
        holds = lambda p: F.col(f"{p}.content").contains(_start(context))
        empty = F.struct(F.lit(None).cast(paragraphs.schema["section"].dataType).alias("section"), F.lit(None).cast(paragraphs.schema["paragraph_idx"].dataType).alias("paragraph_idx"))
        return F.when(holds("here"), F.struct("here.section", "here.paragraph_idx")).when(holds(other), F.struct(f"{other}.section", f"{other}.paragraph_idx")).otherwise(empty)

    found = found.withColumn("b", place("context_before", "before")).withColumn("a", place("context_after", "after"))
    score = F.col("b.paragraph_idx").isNotNull().cast("int") + F.col("a.paragraph_idx").isNotNull().cast("int")
    top = found.groupBy("pair", "hunk").agg(F.min_by(F.struct("here", "b", "a"), F.struct(-score, F.col("here.paragraph_idx"))).alias("t"))
    six = [F.col("t.here.section").alias("section"), F.col("t.here.paragraph_idx").alias("paragraph_idx")]
    six += [F.col(f"t.{k}.{name}").alias(f"{word}_{name}") for k, word in (("b", "before"), ("a", "after")) for name in ("section", "paragraph_idx")]
    return diffs.join(top.select("pair", "hunk", *six), ["pair", "hunk"], "left")
