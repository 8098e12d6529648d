"""Quality classifier: a factorisation machine over hashed words, structure and length.

Features of a text: its words, hashed to ``2**WORD_BITS`` slots and weighted by damped frequency at unit
norm; shares of symbols, capitals, digits, repeated words, short lines and the like, cut into
overlapping steps; and its length. The machine adds a linear term and pairwise interactions of rank ``RANK``, scored in
linear time by half the difference of the squared sum and the sum of squares.

Executors turn whole texts into features, at most ``N_FEATURES`` for a text of any length. Learning runs on the driver over the features of a
bounded, deterministic sample of labelled rows (``max_rows``, the least by hash of the id, and ``max_features``); scoring is one narrow pass over whole texts.

Defined cases: a null or empty text is scored by its structure alone; rows without a label teach
nothing; several labels of an id each count, once however often its row is repeated, and of an id with several texts the one of the least
hash teaches; very long texts are counted whole; equal texts have equal scores; with no labels, or none that meet a document, every score is 0.5;
with labels of one kind the scores follow it; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import as_bytes, slices, word_hashes_of
from paperloom.session import written

WORD_BITS = 15
RANK = 6
STEPS = 12
_CLASS = np.zeros(256, dtype=np.int64)  # other symbols
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:192] = 4  # continuation bytes
_CLASS[192:] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 8
#: Names of the structure statistics, in order.
STATISTICS = ("symbols", "capitals", "digits", "punctuation", "spaces", "lines", "unique_words", "top_words", "adjacent_repeats", "word_length", "length", "singles")
N_FEATURES = (1 << WORD_BITS) + len(STATISTICS) * (STEPS + 1)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    offset: float = 0.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: bounds, feature numbers, values."""
    n = len(texts)
    hashes, bounds = word_hashes_of(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n, dtype=np.int64), counts)
    slot = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cells, times = np.unique((owner << WORD_BITS) | slot, return_counts=True)
    cell_owner, cell_slot = cells >> WORD_BITS, cells & ((1 << WORD_BITS) - 1)
    weight = 1 + np.log(times)
    norm = np.sqrt(np.bincount(cell_owner, weight**2, minlength=n))
    weight = weight / np.maximum(norm, 1e-9)[cell_owner]

    classes = np.zeros((n, 9))
    for i, text in enumerate(texts):
        if text:
            classes[i] = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=9)
    chars = np.maximum(classes.sum(axis=1) - classes[:, 4], 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2] + classes[:, 5], 1)
    words = np.maximum(counts, 1)
    distinct = np.bincount(cell_owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, cell_owner, times)
    again = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n)
    once = np.bincount(cell_owner[times == 1], minlength=n)
    shares = np.column_stack(
        [
            classes[:, 0] / chars * 4, classes[:, 2] / letters, classes[:, 3] / chars * 4, classes[:, 8] / chars * 4, classes[:, 6] / chars * 3, classes[:, 7] / words * 4,
            distinct / words, top / words * 3, again / words * 2, chars / words / 16, np.log1p(chars) / 14, once / words,
        ]
    )
    place = np.clip(shares, 0, 1) * STEPS
    low = np.minimum(place.astype(np.int64), STEPS - 1)
    part = place - low
    base = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * (STEPS + 1)
    extra_at = np.stack([base + low, base + low + 1], axis=2).reshape(n, -1)
    extra = np.stack([1 - part, part], axis=2).reshape(n, -1)

    k = extra.shape[1]
    out_bounds = np.concatenate([[0], np.cumsum(distinct + k)])
    at, values = np.empty(out_bounds[-1], dtype=np.int64), np.empty(out_bounds[-1])
    first = np.searchsorted(cell_owner, np.arange(n))
    spot = out_bounds[cell_owner] + np.arange(len(cells)) - first[cell_owner]
    at[spot], values[spot] = cell_slot, weight
    tail = (out_bounds[1:] - k)[:, None] + np.arange(k)
    at[tail], values[tail] = extra_at, extra
    return out_bounds, at, values


def _raw(machine: Machine, bounds: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and each row's weighted factor sums."""
    first = bounds[:-1]
    linear = np.add.reduceat(machine.linear[at] * values, first)
    weighted = machine.factors[at] * values[:, None]
    sums = np.add.reduceat(weighted, first, axis=0)
    squares = np.add.reduceat((weighted**2).sum(axis=1), first)
    return machine.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bounds: np.ndarray, at: np.ndarray, values: np.ndarray, labels: np.ndarray, rounds: int = 20, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Machine:
    """Adaptive-gradient descent on the logistic loss, from sparse rows as features() gives them."""
    rng = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(N_FEATURES), rng.normal(0, 0.01, (N_FEATURES, RANK)), 0.0
    if not len(labels):
        return Machine(0.0, linear, np.zeros_like(factors))
    seen_linear, seen_factors, seen_bias = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    rows = np.arange(len(labels))
    for _ in range(rounds):
        rng.shuffle(rows)
        for low in range(0, len(rows), batch):
            pick = rows[low : low + batch]
            sizes = bounds[pick + 1] - bounds[pick]
            own = np.concatenate([[0], np.cumsum(sizes)])
            cells = np.repeat(bounds[pick] - own[:-1], sizes) + np.arange(own[-1])
            a, v = at[cells], values[cells]
            raw, sums = _raw(Machine(bias, linear, factors), own, a, v)
            error = np.repeat((_logistic(raw) - labels[pick]) / len(pick), sizes)
            slots, where = np.unique(a, return_inverse=True)
            g = np.bincount(where, error * v) + 1e-5 * linear[slots]
            inner = np.repeat(sums, sizes, axis=0) - factors[a] * v[:, None]
            gf = np.column_stack([np.bincount(where, error * v * inner[:, r]) for r in range(RANK)]) + 1e-5 * factors[slots]
            seen_linear[slots] += g**2
            seen_factors[slots] += gf**2
            linear[slots] -= rate * g / np.sqrt(seen_linear[slots])
            factors[slots] -= rate * 0.5 * gf / np.sqrt(seen_factors[slots])
            gb = error[own[:-1]].sum()
            seen_bias += gb**2
            bias -= rate * gb / np.sqrt(seen_bias)
    return Machine(bias, linear, factors)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 6000, max_features: int = 24_000_000) -> Machine:
    """A machine from at most ``max_rows`` labels, the least by hash of their id, and the features of their texts.

    The sample is chosen among the labels alone, so its broadcast to the texts has that bound. Of these rows the first by hash reach the driver whose features come to at most ``max_features`` (12 bytes
    each), so that many long texts do not burst it.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label"))
    chosen = chosen.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_label").limit(max_rows)
    known = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                bounds, at, values = features(as_bytes(batch.column(1)))
                offsets = pa.array(bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (values, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["_id", "_mark", "_at", "_values"])

    kind = known.schema["_id"].dataType.simpleString()
    found = known.select("_id", "_text", F.xxhash64("_text").alias("_mark")).mapInArrow(run, f"_id {kind}, _mark long, _at array<int>, _values array<double>")
    one = found.groupBy("_id").agg(F.min_by(F.struct("_at", "_values"), "_mark").alias("_row"))
    one = written(one.join(F.broadcast(chosen), "_id"))  # at most max_rows, as the labels
    order = Window.orderBy("_h", "_id", "_label")
    sizes = one.select("_h", "_id", "_label", F.size("_row._at").cast("long").alias("_n")).withColumn("_place", F.row_number().over(order)).withColumn("_sum", F.sum("_n").over(order))
    kept = sizes.where(F.col("_sum") <= max_features).agg(F.coalesce(F.max("_place"), F.lit(0))).first()[0]
    table = one.orderBy("_h", "_id", "_label").limit(kept).select("_row.*", "_label").toArrow().combine_chunks()
    labels = (np.asarray(table.column("_label").to_pylist(), dtype=float) > 0.5).astype(float)
    if not len(labels):
        return fit(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), labels)
    at, values = (table.column(c).combine_chunks() for c in ("_at", "_values"))
    sizes = at.value_lengths().to_numpy()
    return fit(np.concatenate([[0], np.cumsum(sizes)]), at.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), labels)


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, _ = _raw(shared.value, *features(as_bytes(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_logistic(raw), pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
