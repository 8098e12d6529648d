import random

from paperloom.llm import ngram_join as N
from paperloom.llm.components import components
from paperloom.llm.words import words


def brute_force(rows, width=5, least=0.8):
    """(id, class, links) by comparing all pairs of word shingles."""
    sets = []
    for _, text in rows:
        h = words((text or "").encode())[0].tolist()
        sets.append({tuple(h[i : i + width]) for i in range(max(1, len(h) - width + 1))} if h else set())
    links = [[j for j in range(len(rows)) if i != j and sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(links[i])))
    return sorted(out, key=str)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 40, 120]))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in N.join(df).collect()), key=str)
    assert got == brute_force(rows)


def test_equals_brute_force(spark):
    rows = corpus(1, 40, 6)
    check(spark, rows + [(900, rows[5][1]), (901, rows[5][1].upper() + "!"), (902, None), (903, ""), (904, "..."), (905, "..."), (None, rows[7][1]), (7, "the same id again as another text"), (906, "w")])


def near_copies(n, edits, seed, words=200):
    """Copies of one text with so many words replaced, or from one to so many where edits is negative."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, out = [word() for _ in range(words)], []
    for _ in range(n):
        own = list(base)
        for place in rng.sample(range(words), edits if edits > 0 else rng.randint(1, -edits)):
            own[place] = word()
        out.append(" ".join(own))
    return out


def test_large_crowds(spark, monkeypatch):
    """5,000 near copies at 2, 6 and 12 edits of 200 words and 2,000 at 1 to 5, with the constants as they are: links of every 100th as by brute force, rows in proportion."""
    crowds = {edits: near_copies(5000 if edits > 0 else 2000, edits, edits) for edits in (2, 6, 12, -5)}
    rows = [(1_000_000 * e + i, t) for e, texts in crowds.items() for i, t in enumerate(texts)]
    seen, likened = [], N._likened

    def counted(rows, n):
        seen.append(rows.count())
        return likened(rows, n)

    monkeypatch.setattr(N, "_likened", counted)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows) and max(seen) <= 3 * 6 * len(rows) and seen[-1] < seen[0]
    found = wanted = 0
    for e, texts in crowds.items():
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
        for i in range(0, len(texts), 100):
            near = [j for j, s in enumerate(sets) if j != i and 5 * (k := len(s & sets[i])) >= 4 * (len(s) + len(sets[i]) - k)]
            n = got[1_000_000 * e + i][1]
            assert n <= len(near) and {got[1_000_000 * e + i][0]} >= {got[1_000_000 * e + j][0] for j in near[: 1 if n else 0]}
            found, wanted = found + n, wanted + len(near)
    assert wanted > 100_000 and found >= 0.999 * wanted


def test_groups_by_distance_to_their_usual_set(spark, monkeypatch):
    """Blocks of five sets: classes of distance make links certain, rule them out or have them compared."""
    monkeypatch.setattr(N, "BLOCK_SETS", 5)
    rows = [t for edits in (1, 2, 3, 4, 5) for t in near_copies(25, edits, 77)]
    check(spark, [(i, t) for i, t in enumerate(rows + rows[::7])])


def test_overlaps():
    import numpy as np

    rng = np.random.default_rng(5)
    for n, span in ((3, 40), (40, 60), (60, 100_000), (200, 900)):
        a, b = ([np.unique(rng.integers(0, span, rng.integers(0, 200))).astype(np.uint64) for _ in range(k)] for k in (n, n + 3))
        assert (N._overlaps(a, b) == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]).all()


def test_crowded_buckets_and_blocks(spark, monkeypatch):
    """Buckets are split at ten sets and groups compared in blocks of four: the same result."""
    monkeypatch.setattr(N, "BUCKET", 10)
    monkeypatch.setattr(N, "BLOCK_SETS", 4)
    check(spark, corpus(2, 12, 40))


def test_firsts_keep_one_of_each_class(spark, odd, none):
    kept = N.firsts(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 1 and N.firsts(none).count() == 0
    ids = sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i, _ in ids] == [1, 2, 3, 4, 5, 6, 7, 8]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[200 + i] for i in range(60)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
