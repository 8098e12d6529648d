"""Fuzzy title joins: blocked, filtered by cheap bounds, scored exactly.

The score is the Indel ratio, 100 * (1 - indel / (la + lb)) with indel = la + lb - 2 * LCS. Candidates
meet on an equality key; a length band and Spark's bounded ``levenshtein`` leave few pairs, as
levenshtein <= indel <= 2 * levenshtein; where the sides carry marks, bits of these bound the indel
distance for a few instructions a pair. Only survivors are scored, by a bit-parallel LCS in an
Arrow-batched function. Null and blank titles never match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from paperloom.functions import text as X
from paperloom.functions.slices import ROWS, SLICE, cuts
from paperloom.session import checkpoint, written

#: Characters of a gram by which near titles meet.
GRAM = 5
#: Parts of a title, in one of which lies its one edit.
PARTS = 8
#: Edits up to which partners are looked for before all that a threshold allows: these meet by few grams and in narrow bands of lengths.
FEW = 4
#: Buckets of grams whose frequencies the driver holds.
BUCKETS = 1 << 16
#: Characters from which on titles are scored without a bound before: the bound takes time with the square of the length.
LONG = 1000


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def indel_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if not total:
        return 100.0
    first = _shared(a, b)  # equal beginnings and ends belong to some longest common subsequence
    a, b = a[first:], b[first:]
    last = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - last], b[: len(b) - last]
    return 200.0 * (first + last + _lcs(a, b)) / total


@F.pandas_udf(DoubleType())
def _score_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)])


#: Marked so that a filter on the score is not computed beside it, which would score each pair twice.
_score = _score_all.asNondeterministic()


#: A count modulo 8 in four bits, such that one more or less flips one bit.
_RING = np.array([0, 1, 3, 7, 15, 14, 12, 8], dtype=np.uint64)
_PLACES = np.arange(0, 64, 4, dtype=np.uint64)


def _marks(titles: pa.Array) -> pa.Array:
    """Of a title its length, and in two numbers how many of 32 kinds of characters there are, by ``_RING``: each character put in or taken out flips one bit."""
    texts = pc.fill_null(titles.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    codes = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    last = np.append((codes[1:] & 0xC0) != 0x80, True)[: len(codes)]  # a character's last byte tells its kind
    kinds = np.repeat(np.arange(0, 32 * len(texts), 32), np.diff(ends))[last] + (codes[last] & 31)
    counts = np.bincount(kinds, minlength=32 * len(texts)).reshape(-1, 2, 16)
    both = np.bitwise_or.reduce(_RING[counts & 7] << _PLACES, axis=2).view(np.int64)
    parts = [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), counts.sum(axis=(1, 2))]
    return pa.StructArray.from_arrays([pa.array(p) for p in parts], names=["low", "high", "length"])


@F.arrow_udf(StructType([StructField(part, LongType()) for part in ("low", "high", "length")]))
def _marks_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for titles in batches:
        if titles.nbytes <= SLICE:
            yield from (_marks(titles[first : first + ROWS]) for first in range(0, len(titles), ROWS))
        else:
            yield from (_marks(titles[first:after]) for first, after in cuts([titles]))


#: struct<low, high, length> of a title, by which ``scored`` leaves out pairs; marked so that it is not computed for each of its fields.
marks = _marks_all.asNondeterministic()


def scored(pairs: DataFrame, a: str, b: str, threshold: int, marked: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of a score of ``threshold`` or more, with the score; cheap bounds come first. ``marked`` names the columns of marks of a and b."""
    la, lb = [F.col(f"{side}.length") for side in marked] if marked else [F.length(a), F.length(b)]
    budget = F.floor((100 - threshold) * (la + lb) / 100).cast("int")
    near = pairs.where(F.abs(la - lb) <= budget).withColumn("_budget", budget)
    if marked:  # the few that these leave cost less to score than to bound once more
        left, right = marked
        flipped = [F.bit_count(F.col(f"{left}.{part}").bitwiseXOR(F.col(f"{right}.{part}"))) for part in ("low", "high")]
        near = near.where(flipped[0] + flipped[1] <= F.col("_budget"))
    else:
        longest = F.greatest(la, lb)  # no pair can exceed the budget, or the exact score is cheaper than its bound
        near = near.where((F.col("_budget") >= longest) | (longest > LONG) | (F.expr(f"levenshtein({a}, {b}, _budget)") >= 0))
    other = F.when(F.col(a) != F.col(b), F.col(a))  # a null costs no comparison
    return near.withColumn("score", F.coalesce(_score(other, F.col(b)), F.lit(100.0))).where(F.col("score") >= threshold).drop("_budget")


def best(df: DataFrame, query: list[str], order_by: list[str | Column]) -> DataFrame:
    """The best row of each query; the first one wins ties."""
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), *order_by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _by_paper(rows: DataFrame, raw: str, name: str, *others: str) -> DataFrame:
    """Rows whose title is not blank: citing_arxiv_id, the normalised title, its marks and the other columns, moved once for all that goes by paper."""
    titles = rows.where(F.col(raw).rlike(r"\S")).select("citing_arxiv_id", *others, X.normalize_title(raw).alias(name))
    return titles.withColumn(f"{name}_marks", marks(name)).repartition("citing_arxiv_id")


def match_references(references: DataFrame, citations: DataFrame, threshold: int = 95) -> DataFrame:
    """(id, cited_arxiv_id, score): bib rows without a cited id, resolved by known references of the same paper.

    references: citing_arxiv_id, cited_arxiv_id, cited_paper_name, at. A reference goes to its best bib
    title; of bib rows with equal titles the last is meant; of references that meet one bib row the last wins.
    """
    known = _by_paper(references, "cited_paper_name", "name", "cited_arxiv_id", "at")
    open_rows = _by_paper(citations.where(X.is_blank("cited_arxiv_id")), "bib_title", "title", "id")
    open_rows = open_rows.groupBy("citing_arxiv_id", "title", "title_marks").agg(F.max("id").alias("id"))
    pairs = known.join(open_rows, "citing_arxiv_id")
    top = best(scored(pairs, "name", "title", threshold, ("name_marks", "title_marks")), ["citing_arxiv_id", "at"], ["id"])
    return top.groupBy("id").agg(F.max_by("cited_arxiv_id", "at").alias("cited_arxiv_id"), F.max_by("score", "at").alias("score"))


def resolve_citations(citations: DataFrame, references: DataFrame, threshold: int = 95) -> DataFrame:
    """The citations with the ids that match_references finds."""
    found = match_references(references, citations, threshold).select("id", F.col("cited_arxiv_id").alias("_found"))
    out = citations.join(found, "id", "left")
    return out.withColumn("cited_arxiv_id", F.when(X.is_blank("cited_arxiv_id"), F.coalesce("_found", "cited_arxiv_id")).otherwise(F.col("cited_arxiv_id"))).select(*citations.columns)


def match_bib_titles(paragraph_citations: DataFrame, candidates: DataFrame, threshold: int = 95) -> DataFrame:
    """The other way: each distinct bib title of a paper and its best candidate reference."""
    titles = _by_paper(paragraph_citations.where(X.is_blank("cited_arxiv_id")), "bib_title", "title").distinct()
    known = _by_paper(candidates, "cited_paper_name", "name", "cited_arxiv_id", "at")
    pairs = titles.join(known, "citing_arxiv_id")
    return best(scored(pairs, "title", "name", threshold, ("title_marks", "name_marks")), ["citing_arxiv_id", "title"], ["at"]).select("citing_arxiv_id", "title", "cited_arxiv_id", "score")


def _rare_grams(titles: DataFrame, threshold: int, edits: int | None = None) -> DataFrame:
    """Rows (side, key, length, gram): the first grams of each title (side, key, title), in an order of rising frequency; of side r those that side l may have.

    An insertion or deletion changes at most ``GRAM`` of a title's grams. If at most k of them lead from one title to another, the k * GRAM + 1 first
    grams of both, in one order of all grams, have one in common; k follows from the longest partner that the threshold allows, or is ``edits`` if that is less.
    """
    length = F.length("title")
    every = F.regexp_extract_all("title", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))  # overlapping; in one pass
    grams = F.transform(F.when(length < GRAM, F.array("title")).otherwise(every), lambda x: F.xxhash64(x))
    longest = length * (200 - threshold) / threshold  # where a title's partner contains it
    most = F.floor((100 - threshold) * (length + longest) / 100)
    most = ((most if edits is None else F.least(most, F.lit(edits))) * GRAM + 1).cast("int")
    each = titles.select("side", "key", length.alias("length"), most.alias("most"), F.array_distinct(grams).alias("grams"))
    bucket = F.pmod("gram", F.lit(BUCKETS)).cast("int").alias("bucket")
    counted = each.select(F.explode("grams").alias("gram")).groupBy(bucket).agg(F.count(F.lit(1)).alias("often")).collect()  # at most BUCKETS rows
    often = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted:
        often[row["bucket"]] = row["often"]

    def rarest(among: np.ndarray | None = None):
        @F.arrow_udf(ArrayType(LongType()))
        def one(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for lists, wanted in batches:
                for grams, n in zip(lists, wanted.to_pylist(), strict=True):  # a title at a time
                    values = grams.values.to_numpy(zero_copy_only=False)
                    values = values[np.lexsort((values, often[values % BUCKETS]))[:n]]
                    yield pa.array([values if among is None else values[among[values % BUCKETS]]], pa.list_(pa.int64()))

        return F.explode(one("grams", "most")).alias("gram")

    left = each.where("side = 'l'").select("side", "key", "length", rarest())
    there = np.zeros(BUCKETS, dtype=bool)
    there[[row["bucket"] for row in left.select(bucket).distinct().collect()]] = True
    return left.unionByName(each.where("side = 'r'").select("side", "key", "length", rarest(there)))


def _one_edit(lefts: DataFrame, rights: DataFrame, threshold: int) -> DataFrame:
    """(key, right_id, score): titles (key, title; id, title) of which one has a character more than the other.

    They agree before and after one of ``PARTS`` parts of the shorter title. So they meet by a hash of all but that part, and only parts are compared.
    """

    def rows(titles: DataFrame, *ways: str) -> DataFrame:
        """A row for each part and way, where these titles are shorter in the first way and longer in the second; ``n`` is the shorter one's length.

        These rows are many times what the optimiser takes them for, and so are those of grams; hence no join of them may broadcast.
        """
        more, n = F.col("w.more"), F.col("n")
        each = titles.select("*", F.explode(F.array(*[F.struct(F.lit(way).alias("way"), F.lit(more).alias("more")) for more, way in enumerate(ways)])).alias("w"))
        each = each.withColumn("n", F.length("title") - more).where(200.0 * n / (2 * n + 1) >= threshold)
        cut = lambda j: F.floor(n * j / PARTS).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: F.struct(j.alias("j"), cut(j).alias("a"), (cut(j + 1) + more).alias("b")))
        a, b = F.col("p.a"), F.col("p.b")
        meet = F.xxhash64("w.way", "n", "p.j", F.substring("title", F.lit(1), a), F.substring("title", b + 1, F.length("title")))
        return each.select("*", F.explode(parts).alias("p")).select(*[c for c in titles.columns if c != "title"], "n", meet.alias("meet"), F.substring("title", a + 1, b - a).alias("part"))

    left = rows(lefts.select("key", "title"), "right longer", "left longer").withColumnRenamed("part", "left_part")
    right = rows(rights.select(F.col("id").alias("right_id"), "title"), "left longer", "right longer").select("right_id", "meet", F.col("part").alias("right_part"))
    met = left.hint("merge").join(right, "meet").where("levenshtein(left_part, right_part, 1) = 1")  # lengths differ by one
    return met.select("key", "right_id", (200.0 * F.col("n") / (2 * F.col("n") + 1)).alias("score"))


def _more_edits(lefts: DataFrame, rights: DataFrame, threshold: int, edits: int | None) -> DataFrame:
    """(key, right_id, score): pairs of the threshold, titles (key, title; key, id, title) of at most so many edits or all of them.

    They meet in one of their rarest grams, as many as the edits can change and one more, and in a band of lengths. Titles themselves are fetched
    for the pairs that are left.
    """
    ratio = (200 - threshold) / threshold  # no partner is longer by more

    def band(length: Column) -> Column:
        return F.floor(F.log(length + 1.0) / F.log(F.lit(1.2))) if edits is None else F.floor(length / (2 * edits))

    def bands(length: Column) -> Column:
        least, most = F.floor(length / ratio), F.ceil(length * ratio)
        return F.sequence(band(least), band(most)) if edits is None else F.sequence(band(F.greatest(least, length - edits)), band(F.least(most, length + edits)))

    rights = rights.join(lefts.select(F.explode(bands(F.length("title"))).alias("band")).distinct(), band(F.length("title")) == F.col("band"), "left_semi")
    titles = lefts.select(F.lit("l").alias("side"), "key", "title").unionByName(rights.select(F.lit("r").alias("side"), "key", "title"))
    grams = checkpoint(_rare_grams(titles, threshold, edits))
    length = F.col("length")
    left = grams.where("side = 'l'").select(F.col("key").alias("left_key"), length.alias("left_length"), "gram", band(length).alias("band"))
    right = grams.where("side = 'r'").select(F.col("key").alias("right_key"), length.alias("right_length"), "gram", F.explode(bands(length)).alias("band"))
    apart, both = F.abs(F.col("left_length") - F.col("right_length")), F.col("left_length") + F.col("right_length")
    near = (apart <= F.floor((100 - threshold) * both / 100)) & (apart <= (both if edits is None else edits))
    pairs = left.hint("merge").join(right, ["gram", "band"]).where(near).select("left_key", "right_key").distinct()
    pairs = pairs.join(lefts.select(F.col("key").alias("left_key"), F.col("title").alias("left_title")), "left_key")
    pairs = pairs.join(rights.select(F.col("key").alias("right_key"), F.col("id").alias("right_id"), F.col("title").alias("right_title")), "right_key")
    return scored(pairs, "left_title", "right_title", threshold).select(F.col("left_key").alias("key"), "right_id", "score")


def near_titles(left: DataFrame, right: DataFrame, threshold: int = 97) -> DataFrame:
    """Best right title of each left one across sources: (left_id, right_id, score); of rights with one title the least id.

    No pair of the threshold is lost. Equal titles and those of one edit come first, then those of few, as these cost little; each time only those left
    titles go on for which one of more edits could be as good as the best that they have.
    """
    lefts, rights = (df.select("id", X.normalize_title("title").alias("title")).where("title <> ''").withColumn("key", F.xxhash64("title")) for df in (left, right))
    lefts, rights = written(lefts), written(rights.groupBy("key").agg(F.min("id").alias("id"), F.min("title").alias("title")))
    once = written(lefts.groupBy("key").agg(F.min("title").alias("title")))

    def top(found: DataFrame) -> DataFrame:
        """The best right of each left key; the least id wins ties."""
        least = found.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("score"), "right_id")).alias("top"))
        return written(least.select("key", F.col("top.right_id").alias("right_id"), (-F.col("top.score")).alias("score")))

    equal = once.select("key").join(rights.select("key", F.col("id").alias("right_id")), "key").withColumn("score", F.lit(100.0))
    best_ones = top(equal.unionByName(_one_edit(once, rights, threshold)))
    length, done = F.length("title"), 1
    for edits in (FEW, None):
        other = 200.0 * length / (2 * length + done + 1)  # the highest score of a title of more edits than those done
        open_ones = once.join(best_ones, "key", "left").where((other >= threshold) & (F.coalesce("score", F.lit(0.0)) <= other))
        open_ones = written(open_ones.select("key", "title"))
        if open_ones.isEmpty():
            break
        best_ones, done = top(best_ones.unionByName(_more_edits(open_ones, rights, threshold, edits))), edits
    return lefts.select("id", "key").join(best_ones, "key").select(F.col("id").alias("left_id"), "right_id", "score")


def match_statistics(df: DataFrame, matched: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("unmatched"))
