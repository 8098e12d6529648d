"""Readers of CSV, JSON, NDJSON, paper graphs, side-cars and raw text; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as X
from paperloom.schema import METADATA, PAPER_GRAPH, REQUIRED_METADATA, WRAPPERS, Table


def conform(rows: DataFrame, table: Table) -> DataFrame:
    """Required columns are checked, optional ones filled with null, all others dropped, types cast."""
    missing = [c for c in table.required if c not in rows.columns]
    if missing:
        raise ValueError(f"{table.name}: no column {', '.join(missing)}")

    def cast(field: T.StructField):
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        source = rows.schema[field.name].dataType
        if isinstance(field.dataType, T.ArrayType) and isinstance(source, T.StringType):
            return F.from_json(field.name, field.dataType).alias(field.name)
        if isinstance(field.dataType, T.StringType) and isinstance(source, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(field.name).alias(field.name)
        if isinstance(field.dataType, (T.LongType, T.IntegerType)) and isinstance(source, T.StringType):
            return F.col(field.name).try_cast("double").cast(field.dataType).alias(field.name)  # ids stored as 378965.0
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return rows.select(*[cast(f) for f in table.schema])


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """Quoted fields may hold line ends; every field is read as text, so ids keep their digits."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return conform(rows, table)


def read_json(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """An array of objects, one object, or an object with the table's wrapper field; ids are read as text."""
    fields = [T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType()) for f in table.schema]
    present = T.StructType(fields)
    wrapper = WRAPPERS.get(table.name)
    schema = T.StructType([*fields, T.StructField(wrapper, T.ArrayType(present))]) if wrapper else present
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    if wrapper:
        flat = F.when(F.col(wrapper).isNotNull(), F.col(wrapper)).otherwise(F.array(F.struct(*[F.col(f.name) for f in fields])))
        rows = rows.select(F.inline(flat))
    return conform(rows, table)


def read_dois(spark: SparkSession, path: str) -> DataFrame:
    """Distinct arXiv ids of a metadata dump, one object a line or arrays; malformed lines and other DOIs are skipped."""
    schema = "doi string, DOI_ string, paper_doi string"
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r'"DOI"\s*:', '"DOI_":').alias("line"))
    single = lines.where(~F.col("line").startswith("[")).select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"))
    listed = lines.where(F.col("line").startswith("[")).select(F.explode(F.from_json("line", f"array<struct<{schema.replace(' string', ': string')}>>")).alias("r"))
    found = single.unionByName(listed).select(X.doi_to_id(F.coalesce("r.doi", "r.DOI_", "r.paper_doi")).alias("arxiv_id"))
    return found.where("arxiv_id is not null").distinct()


def read_paper_graphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Paper-graph documents with paper_arxiv_id: one a file, named by it, or with ``lines`` one a line that holds it.

    Documents of the history are skipped. Of many papers the second form spares as many small files.
    """
    if lines:
        named = spark.read.schema(f"paper_arxiv_id string, {PAPER_GRAPH}").json(path)
        return named.where(~F.col("paper_arxiv_id").contains("history"))
    rows = spark.read.schema(PAPER_GRAPH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    named = rows.withColumn("paper_arxiv_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return named.where(~F.col("paper_arxiv_id").contains("history"))


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers with all required fields, the others), from one object a file or, with ``lines``, a line."""
    rows = spark.read.schema(METADATA).option("multiLine", not lines).json(path)
    whole = F.lit(True)
    for name in REQUIRED_METADATA:
        whole = whole & F.col(name).isNotNull()
    return rows.where(whole), rows.where(~whole)


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content), a row for each file."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
