"""Lookups on tables, and their maintenance as batch merges into new snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.schema import STAGES, Table
from paperloom.session import checkpoint


def lookup(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among the keys; the join is on the columns of ``keys``."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def narrow(df: DataFrame, table: Table) -> DataFrame:
    return df.select(*(table.narrow or table.names))


def where_all(df: DataFrame, order_by: str = "id", **equal) -> DataFrame:
    """Rows where every named column has the given value, in order."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()], F.lit(True))).orderBy(order_by)


def first_match(df: DataFrame, keys: list[str], value: str, order_by: str = "id", last: bool = False) -> DataFrame:
    """One row a key: the value of its first (or last) row. Aggregated before the shuffle."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(value, order_by).alias(value))


def exists(keys: DataFrame, df: DataFrame, name: str = "exists") -> DataFrame:
    """Every key with whether ``df`` has it."""
    known = df.select(*keys.columns).distinct().withColumn(name, F.lit(True))
    return keys.join(known, keys.columns, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_wins(df: DataFrame, key: list[str], order_by: list[str | Column]) -> DataFrame:
    """The first row of each key; rows with a null in the key all stay."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order_by))
    keyed = df.where(whole).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return keyed.unionByName(df.where(~whole))


def not_stored(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the table lacks; null keys never match."""
    return new.join(old.select(*key), key, "left_anti")


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more, allowMissingColumns=True)


def insert(old: DataFrame, new: DataFrame, key: list[str], order_by: list[str | Column]) -> DataFrame:
    """The table with the rows it lacked; the first row of a key in the batch wins."""
    rows = not_stored(first_wins(new, key, order_by), old, key) if key else new
    return append(old, rows.select(*[c for c in old.columns if c in new.columns]))


def insert_citations(old: DataFrame, new: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """As insert, but self-citations are refused and unresolved ones always go in."""
    key = ["citing_arxiv_id", "cited_arxiv_id"]
    return insert(old, new.where(~F.col(key[0]).eqNullSafe(F.col(key[1]))), key, order_by)


def update(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Non-null values of the changes overwrite; unknown keys are ignored. Keys of the changes are unique."""
    values = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = old.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def replace(old: DataFrame, changes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with whole rows replaced, the rows as they were)."""
    before = old.join(changes.select(*key), key, "left_semi")
    known = changes.join(old.select(*key).distinct(), key, "left_semi")
    return append(old.join(changes.select(*key), key, "left_anti"), known), before


def delete(old: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table without the keyed rows, the deleted rows); keys may be any columns of the table."""
    return old.join(keys.distinct(), keys.columns, "left_anti"), lookup(old, keys)


def delete_where(old: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """As delete, for a condition; rows where it is unknown stay."""
    hit = F.coalesce(condition, F.lit(False))
    return old.where(~hit), old.where(hit)


def with_ids(df: DataFrame, order_by: list[str], start: int = 1, name: str = "id") -> DataFrame:
    """Dense ids in key order, without a window over everything.

    Rows are ranged by the key; each range numbers its own rows and adds the counts of those before it.
    The counts are one row for each range. The ranged rows are kept in the shared folder before anything is counted: computed twice,
    ranges need not agree, as their bounds come from samples and adaptive execution may merge partitions.
    """
    ranged = checkpoint(df.withColumn("_place", F.struct(*order_by)).repartitionByRange("_place").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").count()
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_number", F.row_number().over(Window.partitionBy("_range").orderBy("_place")))
    out = numbered.join(F.broadcast(offsets), "_range")  # one row a partition
    return out.withColumn(name, F.col("_offset") + F.col("_number") + F.lit(start - 1)).drop("_place", "_range", "_offset", "_number")


def next_id(df: DataFrame, name: str = "id") -> int:
    return int(df.agg(F.coalesce(F.max(name), F.lit(0)).alias("top")).first()["top"]) + 1


def get_or_create(dimension: DataFrame, names: DataFrame, name: str = "name", id_name: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the dimension with all names, (name, id) of the asked names)."""
    asked = names.select(name).where(F.col(name).isNotNull()).distinct()
    fresh = with_ids(not_stored(asked, dimension, [name]), [name], next_id(dimension, id_name), id_name)
    grown = append(dimension, fresh.withColumn(id_name, F.col(id_name).cast(dimension.schema[id_name].dataType)))
    return grown, grown.join(asked, name, "left_semi").select(name, id_name)


def initialize_tasks(tasks: DataFrame, papers: DataFrame) -> DataFrame:
    """A row with all stages open for each paper that has none; ids blank or repeated are left out."""
    ids = papers.select(F.trim("paper_arxiv_id").alias("paper_arxiv_id")).where("paper_arxiv_id <> ''").distinct()
    fresh = with_ids(not_stored(ids, tasks, ["paper_arxiv_id"]), ["paper_arxiv_id"], next_id(tasks))
    return append(tasks, fresh.select("id", "paper_arxiv_id", *[F.lit(False).alias(s) for s in STAGES]))


def set_states(tasks: DataFrame, papers: DataFrame, **flags: bool) -> DataFrame:
    """The tasks with the given flags for the given papers."""
    marked = papers.select("paper_arxiv_id").distinct().withColumn("_hit", F.lit(True))
    joined = tasks.join(marked, "paper_arxiv_id", "left")
    return joined.select(*[F.when(F.col("_hit"), F.lit(flags[c])).otherwise(F.col(c)).alias(c) if c in flags else F.col(c) for c in tasks.columns])


def pending(tasks: DataFrame, stage: str, n: int = 100_000, done: bool = False) -> DataFrame:
    """The oldest n papers whose stage is open (or done); paragraph also needs paper_graph."""
    state = F.col(stage) if done else ~F.col(stage)
    if stage == "paragraph" and not done:
        state = state & F.col("paper_graph")
    return tasks.where(state).orderBy("id").limit(n)


def most_recent(df: DataFrame, date: str, since: str, n: int, *tie: str) -> DataFrame:
    return df.where(F.col(date) >= F.lit(since)).orderBy(F.desc(date), *tie).limit(n)


def positional(df: DataFrame, order_by: list[str], start: int, end: int) -> DataFrame:
    """Rows [start:end) in order; a negative end counts from the last row."""
    ranked = with_ids(df, order_by, 0, "_at")
    stop = F.lit(end) if end >= 0 else F.lit(df.count() + end)
    return ranked.where((F.col("_at") >= start) & (F.col("_at") < stop)).drop("_at")


def ordered_distinct(df: DataFrame, name: str, order_by: str) -> DataFrame:
    """Trimmed, non-blank values, each with its first place."""
    value = F.trim(F.col(name))
    return df.select(value.alias(name), F.col(order_by).alias("first_at")).where(F.col(name) != "").groupBy(name).agg(F.min("first_at").alias("first_at"))
