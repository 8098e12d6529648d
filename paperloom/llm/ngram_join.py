"""Jaccard self-join on five-word shingles by chosen paths.

1. Each document becomes a set of shingle hashes and a sketch of ``COORDINATES`` sampled tokens (a
   minimum for each of as many hash functions). Documents with equal sets are one class of copies.
2. Chosen paths: in each of ``runs`` runs a set joins the bucket of one sampled token, so that two
   sets meet with probability J a run. Small buckets are compared by brute force on sketches.
   A bucket of more than ``BUCKET`` sets is split again by a further token, or by two: one path in ``BRANCH`` forks, and all
   fork in the first round, so that a pair of the threshold keeps about one common path a run, while sets that are less alike part
   and the rows of a round do not grow.
   Before that its sets are compared to one of them, the pivot. Where many are near the pivot (a crowd of near copies, which no
   token splits), all that may have a near one for a partner are tied to the pivot, and the near ones leave. What is still crowded
   after ``ROUNDS`` rounds is tied to its pivot whole. Ties only say "verify together".
3. Ties form candidate groups, whose sets are compared exactly. Up to ``BLOCK_SETS`` sets that is one piece of work.
   Of a larger group each set is kept as its difference from a set P of the group's usual shingles. Jaccard distance is a metric:
   sets whose distances to P add up to at most 1 - threshold are linked without being compared, and such whose
   distances differ by more are not. What remains meets in pairs of blocks of differences, each a task of its own.
   Only per-document counts and a spanning forest leave a task, so no group is expanded into its pairs.

The chance to miss a pair of Jaccard J outside crowded buckets is at most (1-J)**runs, plus about 1e-4 for the sketch filter;
with 6 runs a pair at 0.8 is found with probability 0.9998. Inside crowded buckets ``expected_recall`` gives it
by depth: a pair at 0.8 is found with probability 0.998 after four rounds and 0.98 after twelve; pairs above 0.9 nearly always.
The near ones of a dense crowd lose a partner only if the partner's sketch is less like the pivot's by 0.44 or more.
The two sketches differ from each other in a share of at most 0.2 of 96 coordinates, so that has a probability of about 1e-7.

Defined cases: documents without words (null texts too) link to nothing and are classes of their
own; shorter texts are one shingle; very long texts are cut into shingles whole; equal sets have similarity 1; repeated rows are linked
documents; a null id yields a class id only through its class; ids of several texts are told apart by the text; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.words import as_bytes, mix, shingle_hashes, slices, word_hashes_of
from paperloom.session import checkpoint, written

COORDINATES = 96
BUCKET = 800
BRANCH = 3
ROUNDS = 24
#: A crowd is dense if so many of its sets are near its pivot.
DENSE = 0.25
BLOCK_SETS = 1500
BLOCK_SHINGLES = 1 << 20
#: So many sets, on average, say what is usual in a large group.
USUAL = 32
#: Tables of up to so many rows (a few hundred bytes each) or bytes are broadcast; larger ones meet by salted keys.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 1 << 16, 16 << 20, 64
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
#: Five standard deviations of a sketch's estimate at the usual threshold.
_SLACK = 0.2
#: With this slack a partner is overlooked with a probability of about 1e-7 (see above).
_SLACK_IN_CROWD = 0.12
#: Upper ends of the classes of distance to P, in quarters of 1 - threshold; the last class is open.
_ENDS = (1, 2, 3, 5, 6, 7)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes_of(texts)
    return [np.unique(shingle_hashes(hashes[a:b], width)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in sets], dtype=np.uint64)
    sums = np.array([mix(s, 7).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
    return mix(sums + sizes, 11).astype(np.int64)


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit tokens for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    out = np.empty((len(sets), COORDINATES), dtype=np.uint16)
    for i in range(COORDINATES):
        least = np.minimum.reduceat((flat ^ _XOR[i]) * _ODD[i], at)
        out[:, i] = (mix(least, i) >> np.uint64(48)).astype(np.uint16)
    return out


def expected_recall(similarity: float, rounds: int, runs: int = 6) -> float:
    """The probability that a pair has a common path after so many rounds of splitting."""
    lost = 0.0
    for r in range(rounds):
        one = 1 - similarity + similarity * lost
        lost = one * one if r == rounds - 1 else (1 - 1 / BRANCH) * one + one * one / BRANCH
    return float(1 - (1 - similarity + similarity * lost) ** runs)


def _key(doc_id: str, text: str) -> Column:
    """A name of a row that rows of one id and different texts do not share."""
    return F.concat_ws("-", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.hex(F.xxhash64(F.col(text).cast("string"))))


def _features(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, key, n (distinct shingles), set_hash, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(as_bytes(batch.column(2)), width)
                filled = [i for i, s in enumerate(sets) if len(s)]
                sketches: list[bytes | None] = [None] * len(sets)
                if filled:
                    for i, row in zip(filled, _sketches([sets[i] for i in filled]), strict=True):
                        sketches[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(_set_hashes(sets), pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "key", "n", "set_hash", "sketch"],
                )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, key string, n long, set_hash long, sketch binary")


def _token(path: Column, coordinate: Column) -> Column:
    """The path one token further: the 16-bit token at a coordinate of the sketch."""
    value = F.substring(F.col("sketch"), coordinate * 2 + 1, F.lit(2))
    return F.xxhash64(path, coordinate, value)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, gathered from batches that are sorted by them."""
    pending: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(len(table), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change).tolist()
        first = tuple(c[0] for c in columns)
        if pending and first != last:
            yield pa.concat_tables(pending)
            pending = []
        low = 0
        for cut in cuts:
            pending.append(table.slice(low, cut - low))
            yield pa.concat_tables(pending)
            pending, low = [], cut
        pending.append(table.slice(low))
        last = tuple(c[-1] for c in columns)
    if pending:
        yield pa.concat_tables(pending)


def _roots(tied: np.ndarray) -> np.ndarray:
    """The least member that each thing is tied to, from a symmetric matrix of ties."""
    n = len(tied)
    labels = np.arange(n, dtype=np.int32)
    while True:
        least = np.concatenate([np.where(tied[low : low + 512], labels[None, :], np.int32(n)).min(axis=1, initial=n) for low in range(0, n, 512)])
        least = np.minimum(labels, least)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _ties_in(sets: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ties of one bucket as (set, root): sets whose sizes and sketches allow the threshold."""
    sets, first = np.unique(sets, return_index=True)
    sizes, sketches = sizes[first], sketches[first]
    goal = (threshold - _SLACK) * COORDINATES
    tied = np.zeros((len(sets), len(sets)), dtype=bool)
    for i in range(len(sets) - 1):
        like = (sketches[i + 1 :] == sketches[i]).sum(axis=1) >= goal
        tied[i, i + 1 :] = like & (np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i]))
    if not tied.any():
        return sets[:0], sets[:0]
    roots = _roots(tied | tied.T)
    moved = roots != np.arange(len(sets))
    return sets[moved], sets[roots[moved]]


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["a", "b"])


def _brute_force(rows: DataFrame, threshold: float) -> DataFrame:
    """Ties (a, b) inside the buckets of (path, set_hash, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if table is not None and carry is not None:
                table = pa.concat_tables([carry, table])
            elif table is None:
                table = carry
            if table is None:
                return
            path = table.column("path").to_numpy()
            cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
            stop = len(path) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
            carry = table.slice(stop) if batch is not None else None
            if stop:
                yield _edges(*_buckets(table.slice(0, stop), threshold))
            if batch is None:
                return

    narrow = rows.select("path", "set_hash", "n", "sketch")
    return narrow.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def _buckets(table: pa.Table, threshold: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    path, sets, sizes = (table.column(c).to_numpy() for c in ("path", "set_hash", "n"))
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(path), COORDINATES)
    first = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(path)]]))
    two = first[count == 2]
    like = (sketches[two] == sketches[two + 1]).sum(axis=1) >= (threshold - _SLACK) * COORDINATES
    like &= np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1])
    a, b = [sets[two[like]]], [sets[two[like] + 1]]
    for low, m in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        x, y = _ties_in(sets[low : low + m], sizes[low : low + m], sketches[low : low + m], threshold)
        a.append(x)
        b.append(y)
    return a, b


def _meet(rows: DataFrame, table: DataFrame, n: int, key: str = "path", how: str = "inner", small: bool | None = None) -> DataFrame:
    """Rows joined with a table of one row a key: broadcast if it has few rows, else by keys salted on both sides."""
    if n <= BROADCAST_ROWS if small is None else small:
        return rows.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64("set_hash"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.select("*", salt).join(table.select("*", salts), [key, "salt"], how).drop("salt")


def _likened(rows: DataFrame, n: int) -> DataFrame:
    """Rows of n crowded buckets with the bucket's pivot and their estimated likeness to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine, pivot = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES) for i in (3, 5))
                like = pa.array((mine == pivot).mean(axis=1))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), like], names=["path", "set_hash", "n", "sketch", "pivot", "like"])

    pivots = rows.groupBy("path").agg(F.min_by(F.struct("set_hash", "sketch"), F.xxhash64("path", "set_hash")).alias("p"))
    pivots = checkpoint(pivots.select("path", F.col("p.set_hash").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")))
    both = _meet(rows, pivots, n).select("path", "set_hash", "n", "sketch", "pivot", "pivot_sketch")
    return both.mapInArrow(run, "path long, set_hash long, n long, sketch binary, pivot long, like double")


def candidate_ties(sets: DataFrame, threshold: float = 0.8, runs: int = 6) -> DataFrame:
    """Ties (a, b) between (set_hash, n, sketch) rows that are worth comparing exactly."""
    columns = ["set_hash", "n", "sketch"]
    starts = F.array(*[_token(F.lit(r).cast("long"), F.lit(r * (COORDINATES // runs))) for r in range(runs)])
    rows = sets.select(*columns, F.explode(starts).alias("path"))
    ties = []
    for turn in range(ROUNDS):
        crowded = checkpoint(rows.groupBy("path").count().where(F.col("count") > BUCKET).select("path"))
        n = crowded.count()
        ties.append(_brute_force(_meet(rows, crowded, n, how="left_anti") if n else rows, threshold))
        if not n:
            break
        seen = written(_likened(_meet(rows, crowded, n, how="left_semi"), n))
        near, last = 2 * threshold - 1 + 0.05, turn == ROUNDS - 1
        dense = seen.groupBy("path").agg(F.avg((F.col("like") >= near).cast("int")).alias("share")).select("path", (F.col("share") >= DENSE).alias("dense"))
        seen = _meet(seen, checkpoint(dense), n)
        far = near - (1 - threshold) - 2 * _SLACK_IN_CROWD
        tied = F.lit(last) | (F.col("dense") & (F.col("like") >= far))
        ties.append(seen.where(tied).select(F.col("set_hash").alias("a"), F.col("pivot").alias("b")))
        if last:
            break
        one, two = (_token(F.col("path"), F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDINATES)).cast("int")) for j in range(2))
        forks = F.lit(turn == 0) | (F.pmod(F.xxhash64("path", F.lit("fork")), F.lit(BRANCH)) == 0)
        further = F.when(forks, F.array_distinct(F.array(one, two))).otherwise(F.array(one))
        rows = seen.where(~F.col("dense") | (F.col("like") < near)).select(*columns, F.explode(further).alias("path"))
    out = ties[0]
    for more in ties[1:]:
        out = out.unionByName(more)
    return out.where("a <> b")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b."""
    na, nb = len(a), len(b)
    if na * nb <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.float32).reshape(na, nb)
    out = np.zeros((na, nb), dtype=np.float32)
    (ta, oa), (tb, ob) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b))
    both = np.intersect1d(ta, tb)
    if not len(both):
        return out
    parts = []
    for tokens, owner in ((ta, oa), (tb, ob)):
        place = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        known = both[place] == tokens
        place, owner = place[known], owner[known]
        order = np.argsort(place, kind="stable")
        parts.append((place[order], owner[order], np.bincount(place, minlength=len(both))))
    (pa_, oa, fa), (pb, ob, fb) = parts
    often = fa * fb * 64 > na * nb  # cheaper as a column of a matrix than pair by pair
    columns = np.cumsum(often) - 1
    n_often, step = int(often.sum()), max(1, (4 << 20) // max(na, nb))
    for low in range(0, n_often, step):
        tables = []
        for place, owner, n in ((pa_, oa, na), (pb, ob, nb)):
            mine = often[place] & (columns[place] >= low) & (columns[place] < low + step)
            table = np.zeros((n, min(step, n_often - low)), dtype=np.float32)
            table[owner[mine], columns[place[mine]] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    rare = ~often[pa_]
    place, owner = pa_[rare], oa[rare]
    start, times = np.cumsum(fb) - fb, fb[place]
    upto = np.cumsum(times)
    low = 0
    while low < len(place):
        done = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + (4 << 20), side="right")))
        t = times[low:high]
        within = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
        partner = ob[np.repeat(start[place[low:high]], t) + within]
        cells, often_met = np.unique(np.repeat(owner[low:high], t) * nb + partner, return_counts=True)
        out.reshape(-1)[cells] += often_met
        low = high
    return out


def _linked(a: list[np.ndarray], n_a: np.ndarray, b: list[np.ndarray], n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of the threshold or more, from sets of the sizes n, or their differences from one set."""
    apart_a, apart_b = (np.array([len(s) for s in x], dtype=np.float64) for x in (a, b))
    shared = _overlaps(a, b).astype(np.float64) + ((n_a - apart_a)[:, None] + (n_b - apart_b)[None, :]) / 2
    return shared >= threshold * (n_a[:, None] + n_b[None, :] - shared) - 1e-9


_OUT = "set_hash long, root long, links long, grp long, n long, copies long, class int, difference binary"


def _compared(hashes: np.ndarray, linked: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    """Links of each set, and its root in the forest of a symmetric matrix of links."""
    arrays = [pa.array(x, pa.int64()) for x in (hashes, hashes[_roots(linked)], (linked.astype(np.float32) @ copies.astype(np.float64)).astype(np.int64))]
    rest = [pa.nulls(len(hashes), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([*arrays, *rest], names=["set_hash", "root", "links", "grp", "n", "copies", "class", "difference"])


def _distance_class(apart: np.ndarray, n: np.ndarray, n_usual: int, threshold: float) -> np.ndarray:
    """The class of each set's Jaccard distance to the usual set, from the size of their difference."""
    distance = apart / np.maximum((n + n_usual + apart) / 2, 1)
    return np.searchsorted(np.array(_ENDS) * (1 - threshold) / 4 - 1e-12, distance, side="left").astype(np.int32)


def _whole_groups(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """Of rows (part, grp, set_hash, copies, usual, text): links and roots in groups without a usual set, else differences from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["part"]):
            hashes, copies = (group.column(c).to_numpy() for c in ("set_hash", "copies"))
            sets = shingle_sets(as_bytes(group.column("text").combine_chunks()), width)
            real = _set_hashes(sets) == hashes
            _, first = np.unique(hashes[real], return_index=True)
            pick = np.flatnonzero(real)[first]
            hashes, copies, sets = hashes[pick], copies[pick], [sets[i] for i in pick]
            if not len(sets):
                continue
            n = np.array([len(s) for s in sets], dtype=np.int64)
            usual = group.column("usual")[0].as_py()
            if usual is None:
                linked = _linked(sets, n, sets, n, threshold)
                np.fill_diagonal(linked, False)
                yield _compared(hashes, linked, copies)
                continue
            common = np.frombuffer(usual, dtype=np.uint64)
            differences = [np.setxor1d(s, common, assume_unique=True) for s in sets]
            classes = _distance_class(np.array([len(d) for d in differences]), n, len(common), threshold)
            grp = pa.array(np.full(len(sets), group.column("grp")[0].as_py()), pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), none, none, grp, pa.array(n), pa.array(copies, pa.int64()), pa.array(classes), pa.array([d.tobytes() for d in differences], pa.binary())],
                names=["set_hash", "root", "links", "grp", "n", "copies", "class", "difference"],
            )

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, _OUT)


def _usual_sets(texts: DataFrame, width: int) -> DataFrame:
    """(grp, usual) from some sets of each large group: the shingles of more than half of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["grp"]):
            column = group.column("text")
            sets = [shingle_sets(as_bytes(column.slice(i, 1).combine_chunks()), width)[0] for i in range(len(column))]
            shingles, often = np.unique(np.concatenate(sets), return_counts=True)
            usual = shingles[2 * often > len(sets)]
            yield pa.RecordBatch.from_arrays([pa.array([group.column("grp")[0].as_py()], pa.int64()), pa.array([usual.tobytes()], pa.binary())], names=["grp", "usual"])

    return texts.select("grp", "text").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "grp long, usual binary")


def _block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(set_hash, root, links) for each set in each pair of blocks of (part, side, set_hash, n, copies, difference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["part"]):
            hashes, copies, n, side = (group.column(c).to_numpy() for c in ("set_hash", "copies", "n", "side"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("difference").to_pylist()]
            order = np.lexsort([hashes, side])
            hashes, copies, n, side, sets = hashes[order], copies[order], n[order], side[order], [sets[i] for i in order]
            if side[0] == 0:
                linked = _linked(sets, n, sets, n, threshold)
                np.fill_diagonal(linked, False)
            else:  # two blocks, one of which may be empty
                cut = int(np.searchsorted(side, 2))
                linked = np.zeros((len(sets), len(sets)), dtype=bool)
                if 0 < cut < len(sets):
                    linked[:cut, cut:] = _linked(sets[:cut], n[:cut], sets[cut:], n[cut:], threshold)
                    linked[cut:, :cut] = linked[:cut, cut:].T
            yield _compared(hashes, linked, copies)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, _OUT).select("set_hash", "root", "links")


def _large_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(set_hash, root, links) of (grp, set_hash, n, copies, class, difference): by distance classes where these tell, else by pairs of blocks.

    Distances below ends e of both classes that add up to 1 - threshold or less make a link certain; a lower end of one class that is above the
    upper end of the other by more than 1 - threshold rules it out. Only the remaining pairs of classes are compared.
    """
    tokens = F.floor(F.length("difference") / 8)
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(tokens) / BLOCK_SHINGLES)).cast("int")
    kinds = rows.groupBy("grp", "class").agg(F.sum("copies").alias("sum_copies"), F.min("set_hash").alias("least"), size.alias("blocks"))
    kinds = checkpoint(kinds)
    low, high = (F.element_at(F.array(*map(F.lit, ends)), F.col("class") + 1) for ends in ((0, *_ENDS), (*_ENDS, 1 << 20)))
    ends = kinds.select("grp", "class", "sum_copies", "least", "blocks", low.alias("low"), high.alias("high"))
    other = ends.select("grp", *(F.col(c).alias(f"other_{c}") for c in ("class", "sum_copies", "least", "blocks", "low", "high")))
    meet = ends.join(other, "grp")
    sure = F.col("high") + F.col("other_high") <= 4
    never = (F.col("low") - F.col("other_high") >= 4) | (F.col("other_low") - F.col("high") >= 4)
    certain = meet.where(sure).groupBy("grp", "class").agg(
        F.sum("other_sum_copies").alias("around"), F.bool_or(F.col("class") == F.col("other_class")).alias("own"),
        F.coalesce(F.min(F.when(F.col("class") == F.col("other_class"), F.col("least"))), F.min("other_least")).alias("root"),
    )
    ties = meet.where(sure).select(F.col("least").alias("set_hash"), F.col("other_least").alias("root"), F.lit(0).cast("long").alias("links"))
    known = rows.join(certain, ["grp", "class"]).select("set_hash", "root", (F.col("around") - F.when(F.col("own"), F.col("copies")).otherwise(0)).cast("long").alias("links"))
    name = lambda kind, block: F.col(kind).cast("long") * (1 << 32) + block
    others = F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda b: name("other_class", b))
    partners = meet.where(~sure & ~never).groupBy("grp", "class", "blocks").agg(F.flatten(F.collect_list(others)).alias("partners"))
    own = name("class", F.pmod(F.xxhash64("set_hash"), F.col("blocks"))).alias("own")
    placed = rows.join(partners, ["grp", "class"]).select("grp", "set_hash", "n", "copies", "difference", own, F.explode("partners").alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    part = F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))
    return known.unionByName(ties).unionByName(_block_pairs(placed.select(part.alias("part"), side.alias("side"), "set_hash", "n", "copies", "difference"), threshold))


def _verified(docs: DataFrame, members: DataFrame, doc_id: str, text: str, threshold: float, width: int) -> DataFrame:
    """(set_hash, root, links) of members (set_hash, grp, key, copies, n), from the documents' texts."""
    spans = members.groupBy("grp").agg(F.count(F.lit(1)).alias("group_sets"), F.sum("n").alias("group_shingles"))
    parts = F.greatest(F.ceil(F.col("group_sets") / BLOCK_SETS), F.ceil(F.col("group_shingles") / BLOCK_SHINGLES)).cast("int")
    large = checkpoint(spans.select("grp", "group_sets", parts.alias("parts")).where("parts > 1"))
    texts = docs.select(_key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    whole = members.select("key", "set_hash", "copies", "grp")
    n_large = large.count()
    if not n_large:
        rows = texts.join(whole, "key").select(F.col("grp").alias("part"), "grp", "set_hash", "copies", F.lit(None).cast("binary").alias("usual"), "text")
        return _whole_groups(rows, threshold, width).select("set_hash", "root", "links")
    whole = _meet(whole, large, n_large, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    chosen = checkpoint(whole.where("parts > 1").where(F.pmod(F.xxhash64("set_hash", F.lit("usual")), F.col("group_sets")) < USUAL).select("key", "grp"))
    sample = texts.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, "key").dropDuplicates(["grp", "key"])
    usual = checkpoint(_usual_sets(sample, width))
    small = usual.agg(F.coalesce(F.sum(F.length("usual")), F.lit(0)).alias("b")).first()["b"] <= BROADCAST_BYTES
    rows = _meet(texts.join(whole, "key"), usual, n_large, "grp", "left", small)
    usual_or_none = F.when(F.col("parts") > 1, F.coalesce("usual", F.lit(b"")))
    part = F.when(F.col("parts") > 1, F.xxhash64("grp", F.pmod(F.xxhash64("set_hash"), F.col("parts") * 4))).otherwise(F.col("grp"))
    done = checkpoint(_whole_groups(rows.select(part.alias("part"), "grp", "set_hash", "copies", usual_or_none.alias("usual"), "text"), threshold, width))
    near = _large_groups(done.where("difference is not null").select("grp", "set_hash", "n", "copies", "class", "difference"), threshold)
    return done.where("difference is null").select("set_hash", "root", "links").unionByName(near)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, runs: int = 6) -> DataFrame:
    """One row for each document: doc_id, key, class_id, n_links, n_shingles, first.

    class_id: the least id among documents joined by chains of links. n_links: other documents of
    similarity ``threshold`` or more. first: whether the row's key (id and text) is its class's first.
    """
    features = checkpoint(_features(docs, doc_id, text, width))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    sets = checkpoint(
        features.where("n > 0").groupBy("set_hash").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    groups = components(candidate_ties(sets, threshold, runs)).withColumnsRenamed({"node": "set_hash", "label": "grp"})
    members = checkpoint(groups.join(sets.select("set_hash", F.col("least.key").alias("key"), "copies", "n"), "set_hash"))
    compared = checkpoint(_verified(docs, members, doc_id, text, threshold, width))
    links = compared.groupBy("set_hash").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("set_hash").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "set_hash"})
    known = sets.join(links, "set_hash", "left").join(classes, "set_hash", "left").where("copies > 1 or links > 0")
    known = known.select("set_hash", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "set_hash").alias("label"))
    heads = known.groupBy("label").agg(F.min("least").alias("head"))
    known = checkpoint(known.join(heads, "label").select("set_hash", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), "n_links"))
    wordless = F.when(F.col("n") > 0, F.col("set_hash"))
    out = features.select("doc_id", "key", "n", wordless.alias("set_hash")).join(known, "set_hash", "left")
    return out.select(
        "doc_id", "key", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), F.coalesce(F.col("class_key") == F.col("key"), F.lit(True)).alias("first"),
    )


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each class, the one with the least id, with all columns.

    Of rows with equal id and text one is kept; a null text, or one without words, is a class of its own with its id.
    """
    joined = checkpoint(join(docs, doc_id, text, threshold, width).select("key", "first"))
    columns = docs.columns
    own, times = (next(n for i in range(len(columns) + 1) if (n := f"{base}{i}") not in columns) for base in ("key_", "rows_"))
    keys = joined.groupBy("key").agg(F.bool_or("first").alias("first"), F.count(F.lit(1)).alias("rows"))
    kept = keys.where("first").select(F.col("key").alias(own), F.col("rows").alias(times))
    rows = docs.withColumn(own, _key(doc_id, text)).join(kept, own)
    if keys.where("rows > 1").isEmpty():
        return rows.select(*columns)
    once = rows.where(F.col(times) > 1).dropDuplicates([own])
    return rows.where(F.col(times) == 1).unionByName(once).select(*columns)
