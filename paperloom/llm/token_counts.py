"""Exact token-length histogram, and what every context limit would keep.

Executors encode whole texts and count lengths batch by batch, so only (length, documents) pairs
are shuffled. Suffix sums over the histogram then answer totals, quantiles and truncated totals for any limit:
inside blocks of 1,024 lengths, plus the totals of later blocks.

Encoding counts the merges of each distinct piece of text once and remembers them, as texts repeat
their words; the memory is bounded by ``MEMORY`` pieces.

Defined cases: a null or empty text has length 0; each row counts, repeated ones too; a very long text is encoded piece by piece
and has a length of its own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import tokenizer
from paperloom.llm.words import slices
from paperloom.session import checkpoint

BLOCK = 1024
MEMORY = 1 << 18
_PIECES = regex.compile(tokenizer.PATTERN)


class Counted:
    """Token counts of texts under a vocabulary."""

    def __init__(self, ranks: bytes):
        self.encoder = tokenizer.encoding(ranks)
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for piece in _PIECES.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = len(self.encoder.encode_ordinary(piece))
                if len(piece) < 64:
                    known[piece] = n
            total += n
        return total


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = tokenizer.DEFAULT_VOCABULARY) -> DataFrame:
    """(length, n_docs): how many texts have each encoded length."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer.read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counted(shared.value)
        for whole in batches:
            found: Counter[int] = Counter()
            for batch in slices(whole, "text"):
                found.update(count(t) for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["length", "n_docs"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row for each length: documents and tokens there, at that length or more, and cut to it.

    truncated_tokens is the total if each text is cut to this length; for a limit L between two lengths it is
    that of the next length minus (length - L) * docs_at_least. quantile is the share of documents up to it.
    """
    histogram = checkpoint(histogram)  # read twice below; one row a length
    rows = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later, all_rows = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"], *[F.sum(c).over(all_rows).alias(f"all_{c}") for c in "dt"]
    )
    here = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", (F.sum("n_docs").over(here) + F.col("later_d")).alias("docs_at_least"), (F.sum("n_tokens").over(here) + F.col("later_t")).alias("tokens_at_least"), "all_d", "all_t"
    )
    return joined.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_d")).alias("quantile"),
    )
