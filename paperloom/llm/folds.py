"""The fold of a document: rows with crc32(id) mod 5 = 0 are held out of all learning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the held-out fold, and for a null id, which nothing learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
