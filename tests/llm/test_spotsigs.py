import hashlib

import pytest

from paperloom.llm import spotsigs as S


def test_signatures():
    a, b, c, d, e = S.signature_sets([x.encode() for x in ("The red fox of blue water", "the RED fox, of blue water!", "no anchors whatsoever here", "...", "")])
    assert (a == b).all() and len(a) == 2 and len(c) > 0 and len(d) == 1 and len(e) == 0
    assert S.likeness(a, b) == 1.0 and S.likeness(a, c) == 0.0 and S.likeness(e, e) == 1.0 and S.likeness(a, e) == 0.0
    assert (S.parsed(S.written(a)) == a).all()


def test_likeness_pruning_and_bands():
    big, small = (S.signature_sets([(" ".join(f"the w{i} v{i}" for i in range(n))).encode()])[0] for n in (100, 50))
    assert S.likeness(big, small) == pytest.approx(0.5, abs=0.03) and S.likeness(big, small, least=0.8) == 0.0
    assert abs(S.band(100) - S.band(80)) <= 1 < abs(S.band(100) - S.band(50))


def brute_force(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    ordered = sorted(sorted(rows, key=lambda r: r[1] or ""), key=key, reverse=True)
    ordered = [r for i in sorted({key(r) for r in rows}, reverse=True) for r in sorted((r for r in rows if key(r) == i), key=lambda r: r[1] or "")]
    out = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        own, edit, near = S.signature_sets([x.encode() for x in (t, e, n)])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), S.written(own), S.written(edit), S.likeness(own, edit), S.likeness(own, near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_edited_equals_brute_force(spark, n):
    rows = [(i * 7 % 1000, f"The text number {i} of the é set and " * (i % 9)) for i in range(n)]
    if n > 2:
        rows += [(7, "tie a"), (7, "tie b"), (7, "tie b"), (None, "The null id"), (5000, None)]
    got = S.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


def test_odd_rows(spark, odd, none):
    assert S.edited(odd).count() == S.fingerprints(odd).count() == odd.count()
    assert S.edited(none).count() == 0 and S.fingerprints(none).count() == 0
    same = S.matches(odd, odd.where("doc_id = 1").limit(1)).collect()
    assert {r["doc_id"] for r in same} == {1} and all(r["likeness"] == 1.0 for r in same)


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_matches_equal_brute_force(spark, least):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(25):
        base = [w for _ in range(rng.choice([2, 20, 60])) for w in ("the", word(), word())]
        for k in range(6):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own[: len(own) - 3 * (k // 3)])))
    sets = S.signature_sets([t.encode() for _, t in rows])
    want = {(i, j): S.likeness(a, b) for i, a in enumerate(sets[::5]) for j, b in enumerate(sets) if len(a) and len(b)}
    want = {(5 * i, j): x for (i, j), x in want.items() if x >= least}
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["likeness"] for r in S.matches(df, df.where("doc_id % 5 = 0"), least).collect()}
    assert got == want and len(want) > 35
