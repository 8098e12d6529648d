"""The network's gradients, windows of whole texts, and accuracy on documents that did not teach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import toxicity
from paperloom.llm.words import words


def test_gradients():
    x = toxicity.inputs([b"the cat sat on the mat and then " * 3, "another text é x".encode(), b"", b"one"])
    p = {k: v.astype(np.float64) for k, v in toxicity._fresh(np.random.default_rng(0)).items()}
    labels, weights = np.arange(len(x.windows)) % 2, np.full(len(x.windows), 0.3)
    _, slopes = toxicity.gradients(p, x, labels, weights)
    for name in p:
        at = np.unravel_index(np.abs(slopes[name]).argmax(), p[name].shape)
        kept, losses = p[name][at], []
        for step in (1e-3, -1e-3):
            p[name][at] = kept + step
            losses.append(toxicity.gradients(p, x, labels, weights)[0])
        p[name][at] = kept
        assert slopes[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-3, abs=1e-6), name


def plain_windows(text):
    hashes = words(text)[0].tolist()
    return [hashes[i : i + 32] for i in range(0, max(1, len(hashes) - 16), 16)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 47, 48, 49, 64, 65, 1000])
def test_windows_cover_texts(n):
    rng = random.Random(n)
    text = " ".join(rng.choice(["a", "river", "été", "x1"]) + str(rng.randrange(99)) for _ in range(n)).encode()
    other = b"some other words"
    x = toxicity.inputs([text, other])
    hashes = {i: h for i, h in enumerate(np.unique(words(text + b"\n" + other)[0]).tolist())}
    got = [[hashes[w] for w in row if w < len(x.slots)] for row, o in zip(x.windows.tolist(), x.owner.tolist(), strict=True) if o == 0]
    assert got == plain_windows(text)


def test_pieces_have_the_windows_of_the_whole(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 5, 9, 700]))) for _ in range(900)).encode()
    monkeypatch.setattr(toxicity, "PIECE", 3000)
    pieces = list(toxicity._pieces(text))
    assert len(pieces) > 5
    assert [w for p in pieces for w in plain_windows(p)] == plain_windows(text)
    network = toxicity.Network(toxicity._fresh(np.random.default_rng(1)))
    monkeypatch.setattr(toxicity, "PIECE", 1 << 20)
    whole = toxicity.score_texts(network, [text, b""])
    monkeypatch.setattr(toxicity, "PIECE", 3000)
    assert toxicity.score_texts(network, [text, b""]) == pytest.approx(whole, abs=1e-5)


def corpus(seed, n):
    """Invented words; toxic documents hold a few words of a list, or new ones with the same beginning."""
    rng = random.Random(seed)
    parts = "the an re ti on en st ly ou ha er bo ka mi lo".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        text = [word() for _ in range(rng.choice([20, 60, 150, 600]))]
        for _ in range(toxic * rng.randrange(2, 6)):
            text.insert(rng.randrange(len(text)), rng.choice(["zorgish", "vilquex", "snabdor", "grulth" + word()]))
        rows.append((seed * 10_000 + i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy(spark):
    train, test = corpus(1, 500), corpus(2, 200)
    docs = spark.createDataFrame([r[:2] for r in train + test], "doc_id long, text string")
    network = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, network).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in test)
    assert right >= 0.93 * len(test) and all(0 <= s <= 1 for s in got.values())
    unseen = ["on the river " * 40 + w + " we ha an er " * 30 for w in ("grulthkabo grulthmilo grulthenst", "zorgish vilquex")]
    assert (toxicity.score_texts(network, [t.encode() for t in unseen]) > 0.5).all()
    empty, long = toxicity.score_texts(network, [b"", b"the river on ha er " * 40_000])
    assert empty < 0.5 and long < 0.5


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 1), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    network = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, network).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, network).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(odd, labels.where("doc_id = 99"))).collect()} == {0.5}
    for kind in (0, 1):
        one = toxicity.score(odd, toxicity.learn(odd, labels.where(F.col("toxic").isNotNull()).withColumn("toxic", F.lit(kind)))).collect()
        assert all((r["score"] >= 0.5) == bool(kind) for r in one), kind
