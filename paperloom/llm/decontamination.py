"""Benchmark decontamination with an FM-index for each shard of training text.

Executors cut their documents into shards of about ``SHARD_WORDS`` words (a longer text becomes
overlapping pieces), index each shard once, search the benchmark's windows backwards through the
wavelet ranks, locate the matches by sampled suffix positions and merge them into spans. There
is no shuffle. The benchmark, which does not grow with the corpus, reaches executors in blocks of about ``BLOCK_WORDS`` words, each
searched in turn; there may be ``MOST_BLOCKS`` of them, and a larger benchmark is refused with a ValueError, to be searched in parts.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one.

Defined cases: a null or empty text has no words and is clean; items without words are no items; a
null item id counts as an empty one; equal item ids are one item; an empty benchmark leaves every
document clean; repeated rows get equal results; very long texts are indexed in overlapping pieces; ``contamination`` reads no other columns,
``cut`` passes them through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.fm_index import FMIndex
from paperloom.llm.words import as_bytes, slices, words

SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20
MOST_BLOCKS = 16
_SLICE = 3 << 20


@dataclass(frozen=True)
class Block:
    """Distinct windows of some items: word hashes, right-aligned windows over them, their items."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    names: list[str]


def _block(items: list[tuple[str, np.ndarray]], width: int) -> Block:
    rows, owners, lengths = [], [], []
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    for name, hashes in items:
        n = min(width, len(hashes))
        view = np.lib.stride_tricks.sliding_window_view(hashes, n)
        padded = np.zeros((len(view), width), dtype=np.uint64)
        padded[:, width - n :] = view
        rows.append(padded)
        lengths.append(np.full(len(view), n))
        owners.append(np.full(len(view), number[name]))
    table = np.column_stack([np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)])
    distinct, which = np.unique(table, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([which.ravel(), np.concatenate(owners)]), axis=0)
    vocabulary, at = np.unique(distinct[:, :width], return_inverse=True)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Block(vocabulary, at.reshape(len(distinct), width).astype(np.int32), distinct[:, width].astype(np.int64), bounds, pairs[:, 1], names)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> Iterator[Block]:
    """The benchmark's windows in blocks of bounded size, read one partition at a time."""
    pending: list[tuple[str, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        hashes, _, _ = words(row["text"].encode("utf-8", "replace"))
        for at in range(0, max(1, len(hashes) - window + 1), BLOCK_WORDS):
            part = hashes[at : at + BLOCK_WORDS + window - 1]
            if len(part):
                pending.append((row["id"], part))
                size += len(part)
            if size >= BLOCK_WORDS:
                yield _block(pending, window)
                pending, size = [], 0
    if pending:
        yield _block(pending, window)


@dataclass
class Hits:
    """What a slice of documents holds: word offsets, hit words, item names by document."""

    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hit: np.ndarray
    items: list[set[str]]


def _pieces(bounds: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shards: the documents, first words and end words of their pieces."""
    docs, lows, highs, size = [], [], [], 0
    for doc, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        while low < high:
            stop = min(high, low + SHARD_WORDS)
            if size and size + stop - low > 2 * SHARD_WORDS:
                yield np.array(docs), np.array(lows), np.array(highs)
                docs, lows, highs, size = [], [], [], 0
            docs.append(doc)
            lows.append(low)
            highs.append(stop)
            size += stop - low
            low = high if stop == high else stop - overlap
    if docs:
        yield np.array(docs), np.array(lows), np.array(highs)


def find(texts: list[bytes], shared: Iterable[Broadcast], width: int) -> Hits:
    """Hit words and items of each text."""
    bounds_bytes = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds_bytes[1:])
    hashes, starts, ends = words(b"\n".join(texts))
    bounds = np.searchsorted(starts, bounds_bytes)
    marks = np.zeros(len(hashes) + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in texts]
    for docs, lows, highs in _pieces(bounds, width - 1):
        sizes = highs - lows
        piece_bounds = np.zeros(len(docs) + 1, dtype=np.int64)
        np.cumsum(sizes, out=piece_bounds[1:])
        taken = np.repeat(lows - piece_bounds[:-1], sizes) + np.arange(piece_bounds[-1])
        index = FMIndex(hashes[taken], piece_bounds)
        for broadcast in shared:
            block: Block = broadcast.value
            symbols = index.ids_of(block.vocabulary)
            phrases = symbols[block.windows]
            inside = np.arange(width) >= width - block.lengths[:, None]
            present = np.flatnonzero(((phrases > 0) | ~inside).all(axis=1))
            low, high = index.search(phrases[present], block.lengths[present])
            counts = np.maximum(high - low, 0)
            if not counts.any():
                continue
            which = np.repeat(present, counts)
            rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = index.locate(rows)
            word = taken[at]
            np.add.at(marks, word, 1)
            np.add.at(marks, word + block.lengths[which], -1)
            doc = docs[np.searchsorted(piece_bounds, at, side="right") - 1]
            for d, w in np.unique(np.column_stack([doc, which]), axis=0).tolist():
                items[d].update(block.names[i] for i in block.items[block.item_bounds[w] : block.item_bounds[w + 1]].tolist())
    return Hits(bounds, starts, ends, np.cumsum(marks[:-1]) > 0, items)


def _spans(hits: Hits, doc: int, base: int) -> list[tuple[int, int]]:
    """Merged byte ranges of the hit words of a document."""
    low, high = hits.bounds[doc], hits.bounds[doc + 1]
    edge = np.diff(hits.hit[low:high].view(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1) + low, np.flatnonzero(edge == -1) + low - 1
    return list(zip((hits.starts[first] - base).tolist(), (hits.ends[last] - base).tolist(), strict=True))


def _share(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[Broadcast]:
    context = benchmark.sparkSession.sparkContext
    shared = []
    for block in blocks(benchmark, item_id, text, window):
        if len(shared) == MOST_BLOCKS:
            raise ValueError(f"the benchmark has more than {MOST_BLOCKS} blocks of {BLOCK_WORDS} words; search it in parts")
        shared.append(context.broadcast(block))
    return shared


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, items (sorted ids) and spans (merged, in code points)."""
    shared = _share(benchmark, item_id, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                texts = as_bytes(batch.column(1))
                hits = find(texts, shared, window)
                total = np.concatenate([[0], np.cumsum(hits.hit)])
                n_hit = total[hits.bounds[1:]] - total[hits.bounds[:-1]]
                spans, base = [], 0
                for d, t in enumerate(texts):
                    found = _spans(hits, d, base) if n_hit[d] else []
                    spans.append([{"start": len(t[:a].decode()), "end": len(t[:b].decode())} for a, b in found])
                    base += len(t) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(hits.bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in hits.items], pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def cut(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """All rows and columns, with the spans removed from the text; rows left without a word go.

    Clean rows come out as they went in, those without words included.
    """
    shared = _share(benchmark, item_id, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, _SLICE):
                place = batch.schema.get_field_index(text)
                texts = as_bytes(batch.column(place))
                hits = find(texts, shared, window)
                total = np.concatenate([[0], np.cumsum(hits.hit)])
                n_hit = total[hits.bounds[1:]] - total[hits.bounds[:-1]]
                if not n_hit.any():
                    yield batch
                    continue
                values, keep, base = batch.column(place).to_pylist(), np.ones(len(texts), dtype=bool), 0
                for d, t in enumerate(texts):
                    if n_hit[d]:
                        rest, at = [], 0
                        for a, b in _spans(hits, d, base):
                            rest.append(t[at:a])
                            at = b
                        values[d] = b"".join([*rest, t[at:]]).decode()
                        keep[d] = n_hit[d] < hits.bounds[d + 1] - hits.bounds[d]
                    base += len(t) + 1
                columns = [pa.array(values, f.type) if i == place else batch.column(i) for i, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


