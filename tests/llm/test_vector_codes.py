"""Vector codes against Lloyd's rounds in plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from paperloom.llm import vector_codes

KIND = "vec_id long, embedding array<double>, label int, error string, vector int, salt int, position int"


def plain(rows, parts=8, entries=16, rounds=6):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return []
    d = len(order[0][1])
    fine = [r for r in fine if len(r[1]) == d]
    whole = [[int(x) * 4096 if abs(x) > 1e200 else math.floor(4096 * x) for x in r[1]] for r in fine]
    cut = lambda v, j: v[d * j // parts : d * (j + 1) // parts]
    firsts = {}
    for r in order:
        if len(r[1]) == d:
            firsts.setdefault(r[0], [int(x) * 4096 if abs(x) > 1e200 else math.floor(4096 * x) for x in r[1]])
    books = [[cut(v, j) for v in list(firsts.values())[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v, j):
        return min((far(cut(v, j), c), e) for e, c in enumerate(books[j]))

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for v in whole:
            for j in range(parts):
                members[j][nearest(v, j)[1]].append(cut(v, j))
        books = [[[sum(x) // len(x) for x in zip(*members[j][e], strict=True)] if members[j][e] else c for e, c in enumerate(books[j])] for j in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[nearest(v, j) for j in range(parts)] for v in whole]
    top = (1 << 63) - 1
    errors = [min(sum(f for f, _ in n), top) for n in found]
    by_label = defaultdict(int)
    for r, e in zip(fine, errors, strict=True):
        by_label[r[2]] += e
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in n), err, min(by_label[r[2]], top), sha) for r, n, err in zip(fine, found, errors, strict=True)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], KIND)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, d, spread=1.0):
    rng = random.Random(seed)
    return [(i * 3, [rng.choice([-1, 0, 0.5]) + rng.gauss(0, 0.2) * spread for _ in range(d)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("seed,n,d", [(1, 90, 16), (2, 40, 64), (3, 9, 8), (4, 60, 11)])
def test_rounds(spark, seed, n, d):
    rows = vectors(seed, n, d)
    assert result(vector_codes.codes(frame(spark, rows))) == plain(rows)


def test_a_hot_vector_and_ties(spark):
    rows = vectors(5, 60, 16) + [(1000 + i, [0.25] * 16, 7) for i in range(120)] + [(2000 + i, [0.25, -0.25] * 8, None) for i in range(20)]
    assert result(vector_codes.codes(frame(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(6, 30, 16)
    rows += [(500, None, 1), (501, [nan] + [0.0] * 15, 1), (502, [inf] + [0.0] * 15, 1), (503, [None] + [0.0] * 15, 1), (504, [0.5] * 8, 1), (505, [], None), (None, [0.1] * 16, None), (None, None, None)]
    rows += [rows[0], (0, [-3.0] * 16, 2), (0, [9.0] * 16, 2)]  # one id with several vectors, and a repeated row
    assert result(vector_codes.codes(frame(spark, rows))) == plain(rows)
    assert vector_codes.codes(frame(spark, rows).limit(0)).count() == 0
    assert vector_codes.codes(frame(spark, [(1, None, 1), (2, [nan], None)])).count() == 0
    same = [(1, [0.5] * 8, None)] * 5
    assert result(vector_codes.codes(frame(spark, same))) == plain(same)


def test_components_of_any_size(spark):
    rows = vectors(7, 24, 8) + [(900, [1e6, -1e6] * 4, 1), (901, [3e38] * 8, 1), (902, [-3e38] + [0.0] * 7, 2), (903, [1e-300] * 8, 2), (904, [1e308] * 8, 2)]
    assert result(vector_codes.codes(frame(spark, rows))) == plain(rows)


def test_labels_joined_in_salts(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    rows = vectors(8, 50, 8)
    assert result(vector_codes.codes(frame(spark, rows))) == plain(rows)


def test_only_members_that_change_their_entry_move(spark):
    rows = vector_codes.kept(frame(spark, vectors(9, 400, 16)))
    books = vector_codes.first_codebooks(rows)
    state = vector_codes.dealt(rows, books, 6)
    sums = state.mapPartitions(vector_codes._sums).reduceByKey(vector_codes._added).collectAsMap()
    after = vector_codes._updated(books, sums)
    moved = vector_codes.migrated(state, after)
    assert moved.getNumPartitions() == 6 and moved.partitioner == state.partitioner  # a union side by side: no exchange of those that stay
    place = lambda rdd: rdd.mapPartitionsWithIndex(lambda i, pairs: [(i, key, len(m)) for key, m in pairs]).collect()
    for i, key, _ in place(moved):
        assert vector_codes._owner(key) % 6 == i
    total = sum(n for _, _, n in place(state))
    movers = sum(n for _, _, n in place(state.mapPartitions(lambda pairs: vector_codes._split(pairs, after, True))))
    assert total == 400 * 8 == sum(n for _, _, n in place(moved)) and 0 < movers < total / 2


def test_blocks_join_without_loss():
    blocks = [((0, i % 3, 0), np.full((vector_codes.BLOCK // 2, 1), i)) for i in range(20)]
    out = list(vector_codes._joined(iter(blocks)))
    assert sum(len(m) for _, m in out) == sum(len(m) for _, m in blocks) and max(len(m) for _, m in out) <= 4.5 * vector_codes.BLOCK
