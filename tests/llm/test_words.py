import random
import re

import numpy as np

from paperloom.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_words_equal_the_pattern(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ9 é.\n-ñ你_") for _ in range(rng.randrange(60))) for _ in range(200)]
    monkeypatch.setattr(W, "CHUNK", 64)
    hashes, bounds = W.word_hashes_of(t.encode() for t in texts)
    known = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        found = WORD.findall(lower(t))
        assert len(found) == b - a
        for word, h in zip(found, hashes[a:b].tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_positions():
    data = "One, twoé x".encode()
    _, starts, ends = W.words(data)
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == ["One", "twoé", "x"]


def test_shingles():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(W.shingle_hashes(h, 5)) == 3 and len(W.shingle_hashes(h[:2], 5)) == 1 and len(W.shingle_hashes(h[:0], 5)) == 0
