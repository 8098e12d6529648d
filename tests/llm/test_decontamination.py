import random
import re

import numpy as np

from paperloom.llm import decontamination as D
from paperloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_index_counts_and_locates():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(30)] + [np.tile(np.array([1, 2], dtype=np.uint64), 50)] * 3
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.concatenate(texts)
    index = FMIndex(flat, bounds)
    for n in (1, 2, 3, 6):
        phrases = rng.integers(0, 4, (40, n)).astype(np.uint64)
        ids = index.ids_of(phrases.ravel()).reshape(phrases.shape)
        low, high = index.search(ids, np.full(len(phrases), n))
        for p, a, b in zip(phrases, low, high):
            want = sorted(s + i for t, s in zip(texts, bounds) for i in range(len(t) - n + 1) if (t[i : i + n] == p).all())
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def brute_force(docs, items, width=10):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    names |= own
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["a", "B", "c", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 11, 14]))) for i in range(12)] + [(3, text(10)), (None, text(12)), (90, None), (91, "...")]
    docs = [(i, text(rng.choice([0, 2, 9, 10, 60]))) for i in range(40)] + [(50, None), (51, items[3][1] + ", " + items[2][1]), (51, items[3][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs, "doc_id int, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)  # several blocks of the benchmark
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in D.contamination(df, bench).collect())
    assert got == sorted(brute_force(docs, items))


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 16)
    rng = random.Random(8)
    words = [rng.choice("abc") for _ in range(300)]
    items = [("x", " ".join(words[i : i + 10])) for i in (0, 9, 40, 290)]

    class Shared:
        value = D._block([(n, D.words(t.encode())[0]) for n, t in items], 10)

    hits = D.find([" ".join(words).encode()], [Shared], 10)
    assert int(hits.hit.sum()) == brute_force([(0, " ".join(words))], items)[0][2]


def test_cut_and_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, "word")], "item_id int, text string")
    got = D.cut(odd, bench)
    assert got.columns == odd.columns
    texts = [r["text"] for r in got.collect()]
    assert texts.count("The  to the river of the town") == 2 and "word" not in texts and len(texts) == odd.count() - 1
    assert D.contamination(odd, bench).count() == odd.count() and D.cut(none, bench).count() == 0
    assert D.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    span = D.contamination(odd.where("doc_id = 1"), bench).first()["spans"]
    assert [(s["start"], s["end"]) for s in span] == [(4, 52)]
