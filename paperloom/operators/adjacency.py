"""Edges laid out for neighbourhood queries from either end.

``lay_out`` keeps the edges twice, as tables bucketed by one end and by the other. A lookup then brings its keys to the buckets, and the edges are not exchanged. A node of more than ``most``
edges is a hub: its edges carry one of several salts, which is part of the bucket, so they spread over buckets and over the tasks that read them; a table of hubs tells how many.

Defined cases: edges whose end is null are not found from it; repeated edges stay repeated; repeated keys count once; a key without edges gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "_salt"


def lay_out(edges: DataFrame, name: str, ends: tuple[str, str], folder: str, buckets: int = 64, most: int = 100_000) -> None:
    """Writes the tables ``<name>_<end>`` and ``<name>_<end>_hubs`` for both ends, with their files below a shared folder. At scale take a bucket for each 128 MB or so of edges."""
    for end, other in (ends, ends[::-1]):
        degrees = edges.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & F.col(end).isNotNull())
        degrees.select(end, F.ceil(F.col("n") / most).cast("int").alias("salts")).write.mode("overwrite").option("path", f"{folder}/{name}_{end}_hubs").saveAsTable(f"{name}_{end}_hubs")
        hubs = edges.sparkSession.table(f"{name}_{end}_hubs")
        salted = edges.join(hubs, end, "left").withColumn(SALT, F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int"))
        writer = salted.select(*edges.columns, SALT).repartition(buckets, end, SALT).write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}_{end}")
        writer.bucketBy(buckets, end, SALT).sortBy(end).saveAsTable(f"{name}_{end}")


def neighbourhood(spark: SparkSession, name: str, keys: DataFrame) -> DataFrame:
    """The edges at the keys, whose one column names the end; no exchange of edges."""
    end = keys.columns[0]
    asked = keys.where(F.col(end).isNotNull()).distinct().join(spark.table(f"{name}_{end}_hubs"), end, "left")
    asked = asked.select(end, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias(SALT))
    return spark.table(f"{name}_{end}").join(asked, [end, SALT], "left_semi").drop(SALT)
