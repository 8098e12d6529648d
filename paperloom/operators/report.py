"""Counts and rates over the graph's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).where(F.col(name).isNotNull()).distinct()


def counts_by_type(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(ids: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the sorted distinct ids joined by a bar, for each group (nulls are no ids; the digest of no ids is that of the empty text).

    Ids become distinct in parallel and arrive in order as a stream; a task holds one batch of them and a digest, whatever the size of the set. SHA-256 takes its
    input in sequence, so one group's ids pass through one task; without groups the ranges of a parallel sort do, one after another.
    """
    groups = by or []
    rows = ids.select(*groups, F.col(name).cast("string").alias("_id")).distinct()
    if not groups:  # a row even if there are no ids
        rows = rows.unionByName(ids.sparkSession.range(1).select(F.lit(None).cast("string").alias("_id")))
    rows = rows.repartition(*groups).sortWithinPartitions(*groups, "_id") if groups else rows.orderBy("_id").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(now[1], now[0], strict=True)], pa.array([digest.hexdigest()])], names=[*groups, "fingerprint"])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(groups))]
            for *group, value in zip(*columns, batch.column(len(groups)).to_pylist(), strict=True):
                if now is None or now[1] != group:
                    if now is not None:
                        yield done()
                    now, digest, between = (list(batch.schema)[: len(groups)], group), hashlib.sha256(), b""
                if value is not None:
                    digest.update(between + value.encode())
                    between = b"|"
        if now is not None:
            yield done()

    kinds = [f"`{c}` {ids.schema[c].dataType.simpleString()}" for c in groups]
    return rows.mapInArrow(run, ", ".join([*kinds, "fingerprint string"]))


def digest(df: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """One row (n, digest) for a table's content, or one for each value of ``by``, whatever the order of its rows: the sum of a number for each row, out of the MD5 of its columns as text.

    Arrays are joined by commas, nulls written as <null>. Other engines can compute the same; sums of equal tables are equal, and repeated rows count.
    """
    kinds = dict(df.dtypes)
    text = [F.concat_ws(",", c) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def ratings(papers: DataFrame, reviews: DataFrame, key: str, rating: str) -> DataFrame:
    """Reviews and mean rating of every paper; reviews are aggregated before the join."""
    per = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg(rating).alias("mean_rating"))
    return papers.select(key).join(per, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def cited_and_rated(papers: DataFrame, citations: DataFrame, reviews: DataFrame, key: str, citing: str, cited: str, rating: str) -> DataFrame:
    """Distinct citing papers and mean rating; each side is aggregated by itself, so neither inflates the other."""
    incoming = citations.select(citing, cited).distinct().groupBy(F.col(cited).alias(key)).agg(F.count(F.lit(1)).alias("n_citations"))
    out = ratings(papers, reviews, key, rating).join(incoming, key, "left")
    return out.withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))


def acceptance(papers: DataFrame, venue: str, paper: str, accepted: Column) -> DataFrame:
    """Accepted share of distinct papers by venue, in per cent with two decimals."""
    each = papers.groupBy(venue, paper).agg(F.max(F.coalesce(accepted, F.lit(False)).cast("int")).alias("ok"))
    out = each.groupBy(venue).agg(F.sum("ok").alias("accepted"), F.count(F.lit(1)).alias("papers"))
    return out.withColumn("rate", F.round(F.lit(100.0) * F.col("accepted") / F.col("papers"), 2))
