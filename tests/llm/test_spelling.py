"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            found[run] += 1
    kept = {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in kept if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in kept}
    best = {w: min(near[w], key=lambda v: (-kept[v], v), default=None) for w in kept}
    form = {w: v if v is not None and kept[v] >= 10 * kept[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), kept[w], len(near[w]), kept[form[w]] if form[w] else None) for w in kept}


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r["word"]: tuple(r)[1:] for r in df.collect()}


def edited(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcdeéÉñÀ×")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def texts(seed, n):
    """Words, their edits and edits of these, so that forms chain; anagrams; words of equal letters; capitals."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdeéÉñ") for _ in range(rng.randrange(6, 10))) for _ in range(n)] + ["aaaaaaaa", "aaaaaaaaa", "Straßen", "Éclairs"]
    out = []
    for word in common:
        once, twice = edited(rng, word), edited(rng, edited(rng, word))
        parts = [word] * rng.choice([2, 20, 120, 250]) + [once] * rng.choice([0, 2, 12]) + [twice] * rng.choice([0, 2, 3]) + [word[::-1]] * 2
        out.append(" ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.sample(parts, len(parts))))
    return list(enumerate(out))


@pytest.mark.parametrize("tile", [2048, 3])
def test_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)  # blocks of more words are dealt in tiles
    rows = texts(tile, 120)
    want = plain(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id int, text string"))) == want


def test_a_chain_of_forms_has_one_root(spark):
    rows = [(1, "abcdefgh " * 2 + "abcdefgx " * 20 + "abcdefxx " * 200 + "abcdexxx " * 2000)]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id int, text string")))
    assert got == plain(rows) and got["abcdefgh"][:2] == ("abcdefgx", "abcdexxx")


def test_slices_of_a_tile(monkeypatch):
    """Rows that come in small batches and slices give what one comparison of all pairs gives."""
    monkeypatch.setattr(spelling, "TILE", 4)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(9)) for _ in range(150)})
    groups = np.zeros(256, dtype=np.int64)
    rows = [(7, 0, 0, w, i + 1) for i, w in enumerate(words[:60])] + [(7, 0, 1, w, i + 100) for i, w in enumerate(words[60:])]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + 7], strict=True)], names=["key", "tile", "role", "word", "n"]) for i in range(0, len(rows), 7)]
    got, best = Counter(), {}
    for batch in spelling._met(iter(batches), groups):
        for r in batch.to_pylist():
            got[r["word"]] += r["n_near"]
            best[r["word"]] = min(best.get(r["word"], (0, "")), (-r["best_n"], r["best"]))
    n = {r[3]: r[4] for r in rows}
    near = {w: [v for v in words if one_edit(v, w) and (n[v] < 100 or n[w] < 100)] for w in words}
    assert got == {w: len(v) for w, v in near.items() if v}
    assert best == {w: min((-n[x], x) for x in v) for w, v in near.items() if v}


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(spelling.variants(odd)) == plain(rows)
    assert spelling.variants(none).count() == 0
    long = "y" * 300_000
    rows = [(None, f"{long} {long}x {long} {long}x " * 3), (5, "tiny")]
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id int, text string"))) == {w: v for w, v in plain_long(rows).items()}


def plain_long(rows):
    """As plain(), for two words that differ by their last letter."""
    found = Counter(w for _, t in rows for w in t.split() if len(w) > 6)
    return {w: (None, w, n, 1, None) for w, n in found.items()}
