"""Vector codes: product quantisation by Lloyd's rounds over resident members.

1. Components become integers, floor(4096 x); vectors are cut into ``PARTS`` consecutive parts. The codebook of each part position starts as that part of
   the vectors of the ``ENTRIES`` smallest ids.
2. Parts are dealt once to owners (position, entry, salt), in blocks. Each round the owners sum their resident members; these sums, one for each
   entry, make the next codebooks, and the driver holds nothing else. Members whose nearest entry is another one then migrate: they alone are shuffled, to the
   owner of their new entry, and the union with those that stay keeps its partitioning, so that those are not moved.
3. With the last codebooks every vector is encoded in one narrow pass over the table, which needs no shuffle of parts.

At scale: a position and entry has as many salts as a quarter of the partitions, whose number follows the bytes of the table, so an entry that owns most parts, such as
that of a vector which a third of all rows repeat, is spread. Members carry neither ids nor labels. Resident blocks are kept in memory
and on disk; what a lost executor held is made again from the table and the codebooks of the rounds. Sums by label are added up before they are shuffled; they are
broadcast to the rows when their number allows, else joined in salts.

Defined cases: rows without a vector, or with a null or non-finite component, are dropped; so are vectors of another length than that of the least id; a length that 8 does not
divide is cut at floor(i * length / 8). Fewer ids than entries make a shorter codebook. Of several vectors of an id the least one, by component, starts a codebook;
a null id comes after all others. Repeated rows each count, and each is returned. Components of any size are exact (Python's integers where doubles are not); errors
beyond a long are given as the largest long. Null labels are one label. Other columns are not read. An empty table, or one in which nothing is kept, gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
PARTITION_BYTES = 16 << 20
#: Components that a task works on at a time.
CELLS = 1 << 21
#: Members of a block.
BLOCK = 1 << 15
#: Labels whose sums are broadcast.
LABELS = 100_000
SALTS = 32
LONGEST = (1 << 63) - 1

Key = tuple[int, int, int]


def _cuts(length: int) -> list[tuple[int, int]]:
    return [(i * length // PARTS, (i + 1) * length // PARTS) for i in range(PARTS)]


def _grid(values: np.ndarray) -> np.ndarray:
    """floor(4096 x), as doubles where all later sums of squares are exact in them, else as Python integers."""
    if not values.size or np.abs(values).max() < 256:  # 2**20 after scaling; its squared differences fit 2**42
        return np.floor(values * SCALE)
    exact = [math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each member, the lowest of equal ones, and its squared distance."""
    if members.dtype == object or entries.dtype == object:
        members, entries = (np.array([int(x) for x in m.ravel().tolist()], dtype=object).reshape(m.shape) for m in (members, entries))
        far = np.stack([((members - e) ** 2).sum(axis=1) for e in entries], axis=1).astype(object)
        pick = np.array([min(range(len(row)), key=row.__getitem__) for row in far], dtype=np.int64)
    else:
        if members.shape[1] > 512:  # a sum of more squares may pass 2**53
            members, entries = members.astype(np.int64), entries.astype(np.int64)
        far = (members**2).sum(axis=1)[:, None] - 2 * (members @ entries.T) + (entries**2).sum(axis=1)
        pick = far.argmin(axis=1)
    return pick, far[np.arange(len(pick)), pick]


def _packed(members: np.ndarray) -> np.ndarray:
    return members if members.dtype == object else members.astype(np.int32)


def _unpacked(members: np.ndarray) -> np.ndarray:
    return members if members.dtype == object else members.astype(np.float64)


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part position a matrix, one row for each entry."""

    length: int
    entries: tuple[np.ndarray, ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, vector (doubles) of the rows whose vector is there, without null or non-finite components."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & fine).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors of the smallest ids; rows as kept() gives them. A few vectors reach the driver."""
    found: list[list[float]] = []
    rest = rows
    while len(found) < entries:
        got = rest.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
        if not got:
            break
        if not found:
            rows = rows.where(F.size("vector") == len(got[0]["vector"]))
            got = [r for r in got if len(r["vector"]) == len(got[0]["vector"])]
        ids = dict.fromkeys(r["vec_id"] for r in got)
        found += [next(r["vector"] for r in got if r["vec_id"] == i) for i in ids]
        last = got[-1]["vec_id"]
        if last is None:
            break
        rest = rows.where(F.col("vec_id").isNull() | (F.col("vec_id") > F.lit(last)))
    if not found:
        return None
    grid = _grid(np.array(found[:entries], dtype=np.float64).reshape(len(found[:entries]), -1))
    return Codebooks(grid.shape[1], tuple(grid[:, low:high] for low, high in _cuts(grid.shape[1])))


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the integer components of their column ``vector``."""
    step = max(1, CELLS // max(1, length))
    for whole in batches:
        for low in range(0, whole.num_rows, step):
            batch = whole.slice(low, step)
            flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
            yield batch, _grid(flat.astype(np.float64).reshape(batch.num_rows, length))


def _owner(key: Key) -> int:
    return zlib.crc32(b"%d:%d:%d" % key)


def _joined(pairs: Iterator[tuple[Key, np.ndarray]]) -> Iterator[tuple[Key, np.ndarray]]:
    """The members in as few blocks as ``BLOCK`` allows, with no more than a few blocks in hand."""
    held: dict[Key, list[np.ndarray]] = {}
    total = 0
    for key, members in pairs:
        held.setdefault(key, []).append(members)
        total += len(members)
        if total > 4 * BLOCK:
            fullest = max(held, key=lambda k: sum(map(len, held[k])))
            parts = held.pop(fullest)
            total -= sum(map(len, parts))
            yield fullest, np.concatenate(parts)
    for key, parts in held.items():
        yield key, np.concatenate(parts)


def _split(pairs: Iterator[tuple[Key, np.ndarray]], books: Codebooks, moving: bool) -> Iterator[tuple[Key, np.ndarray]]:
    """Members that stay with their owner, or those that move, by their new owner."""
    for (position, entry, salt), members in pairs:
        pick, _ = _nearest(_unpacked(members), books.entries[position])
        for to in np.unique(pick).tolist():
            if (to != entry) == moving:
                yield (position, to, salt), members[pick == to]


def _sums(pairs: Iterator[tuple[Key, np.ndarray]]) -> Iterator[tuple[tuple[int, int], tuple[int, list[int]]]]:
    """Count and componentwise sum of the resident members of each position and entry of a partition."""
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for (position, entry, _), members in pairs:
        here = members.sum(axis=0) if members.dtype == object else members.sum(axis=0, dtype=np.int64)
        out[position, entry] = _added(out.get((position, entry)), (len(members), [int(x) for x in here]))
    yield from out.items()


def _added(a: tuple[int, list[int]] | None, b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    return b if a is None else (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])


def _updated(books: Codebooks, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
    out = []
    for position, book in enumerate(books.entries):
        rows = [[int(x) for x in entry] for entry in book]
        for entry in range(len(rows)):
            if (position, entry) in sums:
                n, total = sums[position, entry]
                rows[entry] = [x // n for x in total]
        exact = all(abs(x) < 1 << 20 for row in rows for x in row)
        out.append(np.array(rows, dtype=np.float64 if exact else object).reshape(book.shape))
    return Codebooks(books.length, tuple(out))


def dealt(rows: DataFrame, books: Codebooks, n: int) -> RDD:
    """((position, entry, salt), members): blocks of parts with the owners of their nearest entries."""
    salts = max(1, n // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for place, (_, grid) in enumerate(_matrices(batches, books.length)):
            keys, blocks = [], []
            for position, (low, high) in enumerate(_cuts(books.length)):
                pick, _ = _nearest(grid[:, low:high], books.entries[position])
                for entry in np.unique(pick).tolist():
                    members = grid[pick == entry, low:high]
                    for k, first in enumerate(range(0, len(members), BLOCK)):
                        keys.append((position, entry, (task * 31 + place + k) % salts))
                        blocks.append(pickle.dumps(_packed(members[first : first + BLOCK])))
            columns = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)] if keys else [pa.array([], pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.binary())], names=["position", "entry", "salt", "block"])

    found = rows.select("vector").mapInArrow(run, "position int, entry int, salt int, block binary")
    return found.rdd.map(lambda r: ((r[0], r[1], r[2]), pickle.loads(r[3]))).partitionBy(n, _owner).mapPartitions(_joined, preservesPartitioning=True)


def migrated(state: RDD, books: Codebooks) -> RDD:
    """The members with the owners of their nearest entries: those that change theirs are shuffled, the others stay where they are."""
    stay = state.mapPartitions(lambda pairs: _split(pairs, books, False), preservesPartitioning=True)
    move = state.mapPartitions(lambda pairs: _split(pairs, books, True)).partitionBy(state.getNumPartitions(), _owner)
    return stay.union(move).mapPartitions(_joined, preservesPartitioning=True)


def learn(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows (as kept() gives them); None if there are none."""
    books = first_codebooks(rows, entries)
    if books is None:
        return None
    rows = rows.where(F.size("vector") == books.length)
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * books.length * 4 // PARTITION_BYTES)
    state = None
    for _ in range(rounds):
        before = state
        state = (dealt(rows, books, n) if before is None else migrated(before, books)).persist(StorageLevel.MEMORY_AND_DISK)
        sums = state.mapPartitions(_sums).reduceByKey(_added, min(n, 16)).collectAsMap()  # a row for each position and entry
        if before is not None:
            before.unpersist()
        books = _updated(books, sums)
    if state is not None:
        state.unpersist()
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of the rows (as kept() gives them) of the codebooks' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, grid in _matrices(batches, books.length):
            codes, errors = np.zeros((batch.num_rows, PARTS), dtype=np.uint8), np.zeros(batch.num_rows, dtype=object)
            for position, (low, high) in enumerate(_cuts(books.length)):
                codes[:, position], far = _nearest(grid[:, low:high], books.entries[position])
                errors += np.array([int(x) for x in far], dtype=object)
            columns = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(e, LONGEST) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.where(F.size("vector") == books.length).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of the kept rows."""
    rows = kept(vectors, vec_id, embedding, label)
    books = learn(rows, rounds, entries) or Codebooks(0, tuple(np.zeros((1, 0)) for _ in range(PARTS)))
    coded = written(encode(rows, books))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(30,0)")).cast("long")
    sums = written(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        out = coded.join(F.broadcast(sums), same, "left")
    else:
        salted = sums.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_salt") == F.col("_of")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
