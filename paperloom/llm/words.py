"""Words of texts as 64-bit hashes, computed with whole-array arithmetic.

A word is a maximal run of UTF-8 bytes that are a digit, an ASCII letter (lower-cased) or above
0x7F; that equals the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text. Work is cut
into chunks between words, so memory follows the chunk and not the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
_M64 = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64)).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of one chunk."""
    global _POWERS
    is_word = _WORD[part]
    edge = np.diff(is_word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = _powers(longest * 2)
    letters = _LOWER[part[is_word]].astype(np.uint64) + np.uint64(1)
    at = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(at, lengths)
    letters *= _POWERS[place]
    return mix(np.add.reduceat(letters, at) + lengths.astype(np.uint64)), starts, ends


def words(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start bytes, end bytes) of all words in a buffer."""
    buffer = np.frombuffer(data, dtype=np.uint8) if isinstance(data, (bytes, memoryview)) else data
    hashes, starts, ends = [], [], []
    at, n = 0, len(buffer)
    while at < n:
        stop = min(at + CHUNK, n)
        while stop < n:  # back to the last byte that is in no word; a longer word stays whole
            gaps = np.flatnonzero(~_WORD[buffer[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(stop + CHUNK, n)
        h, s, e = _hash_chunk(buffer[at:stop])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def word_hashes_of(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and len(texts)+1 offsets into them."""
    sizes, parts = [], []
    for text in texts:
        sizes.append(len(text) + 1)
        parts.append(text)
    bounds = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    hashes, starts, _ = words(b"\n".join(parts))
    return hashes, np.searchsorted(starts, bounds).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text; one long text is a piece of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column.cast(pa.binary())).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter, non-empty text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[i : n - width + 1 + i]
    return mix(out, width)
