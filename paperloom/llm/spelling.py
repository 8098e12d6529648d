"""Spelling variants of words by blocked Gram matrices of letter counts.

1. ``words`` counts the runs of letters of whole texts, each text's distinct runs at once, and keeps those of enough letters and
   occurrences. One occurrence in 31, told by a checksum of document and run, loses a letter (the contract's planted errors).
2. Letters fall into about as many groups as the vocabulary has decimal digits, balanced by how often they occur. A word's block is
   the vector of its letters by group, whose sum is its length. One edit changes a block by one letter of one group (inserted, deleted) or
   by one letter between two groups (replaced), so a block meets itself, the blocks one letter longer and those of the same length that differ in
   two groups: ``near`` sends each word to these, once a pair of blocks.
3. Of a block's words and of each arriving slice NumPy multiplies the matrices of letter counts; squared distances follow from the product
   and the norms. One edit is a squared distance of 1 between adjacent lengths, or of 2 within a length; pairs at these are verified letter by letter.
4. A word's form is its near word of most occurrences, if it has ten times as many; roots follow forms by doubling.

At scale: blocks of more than ``TILE`` words (or ``TILE_LETTERS`` letters) are dealt in tiles, and words that meet them arrive sorted behind the tile and are
taken in slices, so a task holds one tile and one slice whatever the size of blocks. No block is cut short. Counts and best forms are
reduced within a slice before they are shuffled. Blocks are numbers, sums of a fixed number for each letter's group; if two blocks share a number
their words are compared as well, and the true groups of an edit decide, so that each pair counts once.

Defined cases: a null or empty text has no words; a null id is the empty text in the checksum; repeated rows count each; words of any length
are compared whole; ties of occurrences go to the smallest word; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import written

TILE = 2048
TILE_LETTERS = 1 << 17
#: Words that a task keeps counts of before it passes them on.
HELD = 400_000
CHUNK = 1 << 20
#: Cells of a matrix of pairs, and of letters of pairs, at a time.
CELLS = 1 << 22
ERRORS = 31
TIMES = 10
_GAP = re.compile(rb"[^a-z\xc0-\xff]")
#: Column of a letter (a-z and U+00C0 to U+00FF, in Latin-1) in the matrices.
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)
N_LETTERS = 90


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end between runs."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: distinct words of at least ``least_length`` code points that occur at least ``least_count`` times."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

    def rows(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("latin-1", "replace").lower()  # lower() of bytes takes A-Z alone
                begun = zlib.crc32(f"{name.as_py()}:".encode())
                for word, times in Counter(chain.from_iterable(map(runs.findall, _pieces(data)))).items():
                    mark = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if mark % ERRORS == 0:
                        word = word[: mark % len(word)] + word[mark % len(word) + 1 :]
                        if len(word) < least_length:
                            continue
                    found[word] += times
                if len(found) > HELD:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    narrow = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_groups(known: DataFrame, size: int) -> np.ndarray:
    """The group of each letter (256 places, Latin-1): as many groups as ``size`` has digits less one, three at least, of about equal use."""
    n = max(3, int(math.log10(max(size, 1))))
    totals = known.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()  # at most 90 letters
    out, load = np.zeros(256, dtype=np.int64), [0] * n
    for row in sorted(totals, key=lambda r: (-r["count"], r["letter"])):
        least = load.index(min(load))
        out[ord(row["letter"])] = least
        load[least] += row["count"]
    return out


def _shifts(n: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What distinguishes a word from those of the blocks it is sent to, as (group with one more letter, group with one less or -1), and roles by those two."""
    moves = [(i, -1) for i in range(n)] + [(i, j) for i in range(n) for j in range(i + 1, n)]
    roles = np.full((n, n + 1), -1)
    for place, (i, j) in enumerate(moves):
        roles[i, j] = place + 2
    roles[np.arange(n), np.arange(n)] = 1
    return moves, roles


class _Words:
    """Words of a tile or a slice as flat letters and a matrix of letter counts."""

    def __init__(self, column: pa.Array, n: np.ndarray, roles: np.ndarray):
        texts = [w.encode("latin-1") for w in column.to_pylist()]
        self.column, self.n, self.roles = column, n, roles
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        cells = np.repeat(np.arange(len(texts)), self.lengths) * N_LETTERS + _COLUMN[self.flat]
        exact = np.float32 if self.lengths.max() < 2000 else np.float64
        self.counts = np.bincount(cells, minlength=len(texts) * N_LETTERS).reshape(-1, N_LETTERS).astype(exact)
        self.squares = (self.counts**2).sum(axis=1)

    def part(self, low: int, high: int) -> _Words:
        out = object.__new__(_Words)
        out.__dict__ = {"flat": self.flat, "column": self.column.slice(low, high - low)} | {k: getattr(self, k)[low:high] for k in ("n", "roles", "lengths", "starts", "counts", "squares")}
        return out


def _verified(a: _Words, b: _Words, ia: np.ndarray, ib: np.ndarray, groups: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """Which candidate pairs are one edit apart, and in the role in which they meet."""
    good = np.zeros(len(ia), dtype=bool)
    for length in np.unique(a.lengths[ia]):
        for more in (0, 1):
            every = np.flatnonzero((a.lengths[ia] == length) & (b.lengths[ib] == length + more))
            step = max(1, CELLS // int(length))
            for some in (every[x : x + step] for x in range(0, len(every), step)):
                place = np.arange(length)
                x = a.flat[a.starts[ia[some]][:, None] + place]
                y = b.flat[b.starts[ib[some]][:, None] + np.arange(length + more)]
                differ = x != y[:, :length]
                first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
                row = np.arange(len(some))
                if more:
                    fine = ~((x != y[:, 1:]) & (place >= first[:, None])).any(axis=1)
                    role = roles[groups[y[row, first]], -1]
                else:
                    fine = differ.sum(axis=1) == 1
                    at = np.minimum(first, length - 1)
                    role = roles[groups[y[row, at]], groups[x[row, at]]]
                good[some] = fine & (role == b.roles[ib[some]])
    return good


def _pairs(a: _Words, b: _Words, groups: np.ndarray, roles: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a and b by their Gram matrix; within: b is a, and each pair counts once."""
    want = b.squares - np.where((b.roles >= 2) & (b.roles < 2 + roles.shape[0]), 1, 2)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // max(1, len(b.n)))
    for low in range(0, len(a.n), step):
        gram = a.counts[low : low + step] @ b.counts.T
        ia, ib = np.nonzero(gram * 2 == a.squares[low : low + step, None] + want)
        ia = ia + low
        if within:
            ia, ib = ia[ia < ib], ib[ia < ib]
        good = _verified(a, b, ia, ib, groups, roles)
        out.append((ia[good], ib[good]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _best(own: np.ndarray, other: np.ndarray, a: _Words, b: _Words) -> pa.RecordBatch:
    """For each word of a in the pairs: how many words of b, and the one of most occurrences, the smallest of equal ones."""
    rank = np.empty(len(b.n), dtype=np.int64)
    rank[pc.sort_indices(b.column).to_numpy()] = np.arange(len(b.n))
    order = np.lexsort((rank[other], -b.n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    sizes = np.diff(np.append(first, len(own)))
    return pa.RecordBatch.from_arrays(
        [a.column.take(pa.array(own[first])), pa.array(sizes, pa.int64()), pa.array(b.n[other[first]], pa.int64()), b.column.take(pa.array(other[first]))], names=["word", "n_near", "best_n", "best"]
    )


def _met(batches: Iterator[pa.RecordBatch], groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Near words from rows (key, tile, role, word, n), sorted by the first three: a tile's own words, in role 0, come before those that meet it."""
    roles = _shifts(int(groups.max()) + 1)[1]
    held: list[pa.RecordBatch] = []
    tile: _Words | None = None
    now: tuple[int, int, bool] | None = None

    def taken() -> _Words:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return _Words(table.column("word").combine_chunks(), table.column("n").to_numpy(), table.column("role").to_numpy())

    def both(a: _Words, b: _Words, within: bool = False) -> Iterator[pa.RecordBatch]:
        ia, ib = _pairs(a, b, groups, roles, within)
        if len(ia):
            yield _best(ia, ib, a, b)
            yield _best(ib, ia, b, a)

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal tile
        if held and now[2]:
            tile = taken()
            tile.roles = np.ones(len(tile.n), dtype=np.int64)
            yield from both(tile, tile, within=True)
        elif held and tile is None:
            held.clear()
        elif held:
            yield from both(tile, taken())

    for batch in batches:
        if not batch.num_rows:
            continue
        key, at, role = (batch.column(c).to_numpy() for c in range(3))
        kind = np.stack([key, at, role == 0])
        letters = np.cumsum(pc.utf8_length(batch.column(3)).to_numpy())
        edges = np.flatnonzero(np.any(kind[:, 1:] != kind[:, :-1], axis=0)) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            this = (int(key[low]), int(at[low]), bool(role[low] == 0))
            if this != now:
                yield from done()
                if now is None or this[:2] != now[:2]:
                    tile = None
                now = this
            while low < high:  # what meets a tile is taken in slices
                stop = high
                if not this[2]:
                    before = letters[low - 1] if low else 0
                    stop = min(high, low + TILE, max(low + 1, int(np.searchsorted(letters, before + TILE_LETTERS, side="right"))))
                    if held and (sum(b.num_rows for b in held) + stop - low > TILE or sum(b.column(3).nbytes for b in held) > 2 * TILE_LETTERS):
                        yield from done()
                held.append(batch.slice(low, stop - low))
                low = stop
    yield from done()


def near(known: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word of (word, n) with near ones, their number and the one of most occurrences."""
    spark = known.sparkSession
    size = known.count()
    groups = letter_groups(known, size)
    n_groups = int(groups.max()) + 1
    moves, _ = _shifts(n_groups)
    # a block's number is the sum of its letters' numbers; words of up to 2**29 letters stay below 2**63
    numbers = np.random.default_rng(5).integers(1 << 33, 1 << 34, n_groups)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            lengths = np.array([len(w) for w in data], dtype=np.int64)
            found = np.add.reduceat(numbers[groups[np.frombuffer(b"".join(data), dtype=np.uint8)]], np.cumsum(lengths) - lengths) if data else lengths
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(lengths)], names=["word", "n", "key", "letters"])

    keyed = known.select("word", "n").mapInArrow(keys, "word string, n long, key long, letters long")
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("letters") / TILE_LETTERS)).cast("int")
    blocks = written(keyed.groupBy("key").agg(tiles.alias("tiles")))
    own = keyed.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    home = own.select("key", F.col("own").alias("tile"), F.lit(0).alias("role"), "word", "n")
    beside = own.where("own > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tile"), F.lit(1).alias("role"), "word", "n")
    shift = lambda i, j: int(numbers[i]) - (int(numbers[j]) if j >= 0 else 0)
    sent = F.explode(F.array(*[F.struct((F.col("key") - shift(i, j)).alias("key"), F.lit(place + 2).alias("role")) for place, (i, j) in enumerate(moves)]))
    other = keyed.select("word", "n", sent.alias("to")).select(F.col("to.key").alias("key"), F.col("to.role").alias("role"), "word", "n").join(blocks, "key")
    other = other.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "role", "word", "n")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * (len(moves) + 1) // 200_000)
    dealt = home.unionByName(beside).unionByName(other).repartition(n, "key", "tile").sortWithinPartitions("key", "tile", "role")
    found = dealt.mapInArrow(lambda batches: _met(batches, groups), "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of (word, form). A form is of more occurrences than its word, so chains end, and halve with each round."""
    points = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = points.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = points.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step)
        points = step.drop("moved")
        if step.where("moved").isEmpty():
            return points


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of the texts; form and form_n are null where no near word occurs ``times`` as often."""
    known = written(words(docs, doc_id, text, least_length, least_count))
    joined = known.join(near(known), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    out = written(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
