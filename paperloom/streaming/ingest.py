"""Ingestion of new papers as a stream of metadata files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions import text as X
from paperloom.operators.store import append, first_wins, not_stored
from paperloom.schema import METADATA, Table
from paperloom.sources.ledger import Ledger
from paperloom.sources.tables import Snapshots


def papers(spark: SparkSession, folder: str, category: str | None = None, delay: str | None = None) -> DataFrame:
    """The stream of metadata rows in a folder, with a timestamp ``published_at``.

    ``category`` keeps papers with that major category; ``delay`` drops repeated ids as long as they may arrive late.
    """
    rows = spark.readStream.schema(METADATA).json(folder).withColumn("published_at", F.try_to_timestamp("published"))
    if category is not None:
        rows = rows.where(X.major_category("categories", category))
    if delay is not None:
        rows = rows.where("published_at is not null").withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["id"])
    return rows


def window_of(df: DataFrame, date: str, today: str, interval_days: int = 2, delay_days: int = 2) -> DataFrame:
    """Rows of the interval that ends ``delay_days`` before today; consecutive intervals tile the days."""
    end = F.date_sub(F.lit(today).cast("date"), delay_days)
    return df.where(F.to_date(date).between(F.date_sub(end, interval_days - 1), end))


def _order(rows: DataFrame, key: list[str]) -> list[str]:
    """Columns that decide which row of a key is first: times, then all others that have an order."""
    others = [(c, kind) for c, kind in rows.dtypes if c not in key and not kind.startswith(("map", "variant"))]
    return sorted((c for c, _ in others), key=lambda c: (not dict(others)[c].startswith(("timestamp", "date")), c))


def ingest(stream: DataFrame, store: Snapshots | Ledger, table: Table, build: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch is built into rows, and those with new keys are added to the table; known keys are left as they are.

    Of several rows of a key in a batch the earliest one goes in, and of equal times the least by its other columns, so that a batch that is played again
    picks the same. A batch that is played again adds nothing, and one that died while it was written is not seen, so a failed one can simply
    run again from the checkpoint. Stored rows are read for their keys alone and not written again. A ledger takes other writers at the same time.
    """

    def merge(batch: DataFrame, _: int) -> None:
        key, built = list(table.key), build(batch)
        if isinstance(store, Ledger):
            store.insert(table, built, _order(built, key))
            return
        stored = store.scan(table)
        fresh = not_stored(first_wins(built, key, _order(built, key)), stored, key)
        store.add(table, append(stored.limit(0), fresh.select(*[c for c in table.names if c in fresh.columns])))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
