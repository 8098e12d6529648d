"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in NumPy.

Inputs of a word are the embedding of its hash and the mean of the embeddings of its hashed runs of three to six characters, its ends marked, so that words never seen
are read by their letters. A text is read in windows of ``WINDOW`` words, each ``STRIDE`` after the one before, to its end. In a window gated units run over the words in both directions, attention
weighs their states, and the weighted state gives the window's raw score. A text's score is a logistic of its highest window and of the number of windows expected to be toxic.

Learning runs on the driver over windows of a bounded, deterministic sample of labelled rows: at most ``max_rows`` ids a class, the least by hash, and at most
``max_windows`` windows of each, evenly spaced over the whole text. The first rounds give each window its document's label; later ones take the highest windows of each
document, as only some windows of a toxic document are toxic. Words and runs of characters that few documents of the sample have keep an embedding of zero. A fifth of the documents is kept back for the logistic, weighted to the labels' true shares.
Scoring is one narrow pass over whole texts; the model's broadcast has a fixed size.

Defined cases: a null or empty text, or one without words, is scored as one window without words; very long texts are scored whole, piece by piece, with the windows
that they have in one piece; equal texts have equal scores but for rounding; several labels of an id each count; of an id with several texts the one of the least hash teaches;
with no labels, or none that meet a document, every score is 0.5; with labels of one kind the scores follow it; in learning alone, windows of over
``WINDOW_BYTES`` bytes are left out; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import _LOWER, _WORD, as_bytes, mix, slices, words

WINDOW, STRIDE = 32, 16
BITS = 15
WORD_WIDTH, CHAR_WIDTH, UNITS = 8, 12, 8
GRAMS = (3, 4, 5, 6)
#: Bytes of text worked on at a time.
PIECE = 1 << 20
WINDOW_BYTES = 4096
#: Windows that run through the network together.
TOGETHER = 2048


@dataclass
class Inputs:
    """Windows of texts: words[i, t] numbers a distinct word, or the number of distinct words where there is none; owner[i] is the text's place."""

    slots: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashed runs, first run of each word that has some, these words
    n_grams: np.ndarray
    windows: np.ndarray
    owner: np.ndarray


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes whose windows, taken together, are the text's."""
    data, at, size = np.frombuffer(text, dtype=np.uint8), 0, PIECE
    while len(text) - at > size:
        gaps = np.flatnonzero(~_WORD[data[at : at + size]])
        _, starts, ends = words(data[at : at + int(gaps[-1])]) if len(gaps) else (None, (), ())
        whole = (len(starts) - WINDOW) // STRIDE  # the last windows are left to the next piece
        if whole < 1:
            size *= 2
            continue
        yield text[at : at + int(ends[(whole - 1) * STRIDE + WINDOW - 1])]
        at, size = at + int(starts[whole * STRIDE]), PIECE
    yield text[at:]


def inputs(texts: list[bytes]) -> Inputs:
    """Windows of all texts and the hashed inputs of their distinct words. Memory follows the texts; long ones are cut before (_pieces)."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    hashes, starts, ends = words(buffer)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)

    lengths = ends[first] - starts[first] + 2
    total = np.cumsum(lengths)
    place = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - lengths, lengths)
    letters = np.full(len(place), 1, dtype=np.uint64)
    inner = (place > 0) & (place < np.repeat(lengths, lengths) - 1)
    letters[inner] = _LOWER[buffer[(np.repeat(starts[first], lengths) + place - 1)[inner]]]
    left = np.repeat(lengths, lengths) - place  # letters from here to the word's end
    grams, n_grams, owner = [], np.zeros(len(distinct), dtype=np.int64), np.repeat(np.arange(len(distinct)), lengths)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        run = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            run = run * np.uint64(0x100000001B3) + letters[at + k]
        mine = owner[at]
        begins = np.flatnonzero(np.diff(mine, prepend=-1))
        grams.append(((mix(run) >> np.uint64(64 - BITS)).astype(np.int64), begins, mine[begins]))
        n_grams += np.bincount(mine, minlength=len(distinct))

    counts = np.diff(bounds)
    each = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    text_of = np.repeat(np.arange(len(texts)), each)
    step = np.arange(len(text_of)) - np.repeat(np.cumsum(each) - each, each)
    at = (bounds[text_of] + step * STRIDE)[:, None] + np.arange(WINDOW)
    there = at < bounds[text_of + 1][:, None]
    padded = np.append(number.ravel(), len(distinct))
    return Inputs((distinct >> np.uint64(64 - BITS)).astype(np.int64), grams, n_grams, padded[np.where(there, at, len(number))], text_of)


def _of(x: Inputs, windows: np.ndarray) -> Inputs:
    """Some windows with the inputs of their own words alone."""
    n = len(x.slots)
    used = np.unique(windows)
    place = np.full(n + 1, -1)
    place[used] = np.arange(len(used))
    used, place[n] = used[used < n], np.count_nonzero(used < n)
    grams = []
    for slots, begins, owner in x.grams:
        mine = place[np.repeat(owner, np.diff(np.append(begins, len(slots))))]
        slots, mine = slots[mine >= 0], mine[mine >= 0]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        grams.append((slots, first, mine[first]))
    return Inputs(x.slots[used], grams, x.n_grams[used], place[windows], np.arange(len(windows)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """p: the arrays of the network. calibration: weights of the logistic over (highest window, expected toxic windows, 1)."""

    p: dict[str, np.ndarray]
    calibration: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width, h = WORD_WIDTH + CHAR_WIDTH, UNITS
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"words": (rng.normal(0, 0.1, (1 << BITS, WORD_WIDTH))).astype(np.float32), "chars": (rng.normal(0, 0.3, (1 << BITS, CHAR_WIDTH))).astype(np.float32)}
    for way in "fb":
        p |= {f"w{way}": draw(width, 3 * h), f"u{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, dtype=np.float32)}
    return p | {"attention": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, dtype=np.float32)}


def _embedded(p: dict[str, np.ndarray], x: Inputs, heard: np.ndarray | None = None) -> np.ndarray:
    """The input vector of each distinct word; heard: which of them show their own embedding besides their letters'."""
    letters = np.zeros((len(x.slots), CHAR_WIDTH), dtype=np.float32)
    for slots, begins, owner in x.grams:
        if len(slots):
            letters[owner] += np.add.reduceat(p["chars"][slots], begins, axis=0)
    letters /= np.sqrt(np.maximum(x.n_grams, 1))[:, None].astype(np.float32)
    own = p["words"][x.slots]
    return np.concatenate([own if heard is None else own * heard[:, None], letters], axis=1)


def _run(p: dict[str, np.ndarray], way: str, projected: np.ndarray, windows: np.ndarray, there: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, units) of one direction; what the gradient needs goes to keep."""
    h, u = UNITS, p[f"u{way}"]
    state = np.zeros((len(windows), h), dtype=np.float32)
    states = np.empty((WINDOW, len(windows), h), dtype=np.float32)
    for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
        x, g = projected[windows[:, t]], state @ u
        gates = _logistic(x[:, : 2 * h] + g[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
        after = n + z * (state - n)
        after *= there[:, t, None]
        if keep is not None:
            keep.append((t, state, z, r, n, g[:, 2 * h :]))
        states[t] = state = after
    return states


def _forward(p: dict[str, np.ndarray], vectors: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Raw scores of windows."""
    there = (windows < len(vectors)).astype(np.float32)
    states = []
    for way in "fb":
        projected = np.vstack([vectors @ p[f"w{way}"] + p[f"c{way}"], np.zeros((1, 3 * UNITS), dtype=np.float32)])
        states.append(_run(p, way, projected, windows, there, None if keep is None else keep.setdefault(way, [])))
    both = np.concatenate(states, axis=2)
    e = np.where(there.T > 0, both @ p["attention"], -1e9)
    a = np.exp(e - e.max(axis=0)) * there.T
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, both)
    if keep is not None:
        keep |= {"there": there, "both": both, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0]


def raw_scores(network: Network, x: Inputs) -> np.ndarray:
    """Raw scores of all windows."""
    vectors = _embedded(network.p, x)
    return np.concatenate([_forward(network.p, vectors, x.windows[low : low + TOGETHER]) for low in range(0, len(x.windows), TOGETHER)])


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values summed by index."""
    order = np.argsort(index, kind="stable")
    begins = np.flatnonzero(np.diff(index[order], prepend=-1))
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    if len(begins):
        out[index[order][begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def gradients(p: dict[str, np.ndarray], x: Inputs, labels: np.ndarray, weights: np.ndarray, heard: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted logistic loss of windows and its gradient by every array of the network."""
    keep: dict = {}
    windows = x.windows
    vectors = _embedded(p, x, heard)
    raw = _forward(p, vectors, windows, keep)
    score = _logistic(raw)
    loss = float(-(weights * (labels * np.log(score + 1e-9) + (1 - labels) * np.log(1 - score + 1e-9))).sum())
    there, both, a, pooled = (keep[k] for k in ("there", "both", "a", "pooled"))
    d = (weights * (score - labels)).astype(np.float32)
    out = {"out": pooled.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
    d_pooled = d[:, None] * p["out"]
    along = np.einsum("nh,tnh->tn", d_pooled, both)
    d_e = a * (along - (a * along).sum(axis=0))
    out["attention"] = np.einsum("tn,tnh->h", d_e, both)
    d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * p["attention"]
    d_vectors, h = np.zeros_like(vectors), UNITS
    for k, way in enumerate("fb"):
        u, d_u = p[f"u{way}"], np.zeros_like(p[f"u{way}"])
        d_x = np.empty((len(windows), WINDOW, 3 * h), dtype=np.float32)
        d_state = np.zeros((len(windows), h), dtype=np.float32)
        for t, before, z, r, n, g in reversed(keep[way]):
            d_after = (d_state + d_both[t][:, k * h : (k + 1) * h]) * there[:, t, None]
            d_n = d_after * (1 - z) * (1 - n * n)
            d_z, d_r = d_after * (before - n) * z * (1 - z), d_n * g * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_x[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u += before.T @ d_g
            d_state = d_after * z + d_g @ u.T
        by_word = _summed(windows.ravel(), d_x.reshape(-1, 3 * h), len(vectors) + 1)[:-1]
        out |= {f"u{way}": d_u, f"w{way}": vectors.T @ by_word, f"c{way}": by_word.sum(axis=0)}
        d_vectors += by_word @ p[f"w{way}"].T
    own = d_vectors[:, :WORD_WIDTH] if heard is None else d_vectors[:, :WORD_WIDTH] * heard[:, None]
    out["words"] = _summed(x.slots, own, 1 << BITS)
    letters = d_vectors[:, WORD_WIDTH:] / np.sqrt(np.maximum(x.n_grams, 1))[:, None].astype(np.float32)
    slots = np.concatenate([s for s, _, _ in x.grams])
    owner = np.concatenate([np.repeat(o, np.diff(np.append(b, len(s)))) for s, b, o in x.grams])
    out["chars"] = _summed(slots, letters[owner], 1 << BITS)
    return loss, out


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 5 / (size + 1e-9))
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def _of_texts(raw: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest window and expected toxic windows of each text."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, raw)
    return top, np.bincount(owner, _logistic(raw.astype(np.float64)), minlength=n)


def _design(top: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(top, -15, 15), np.log(expected + 0.01), np.ones(len(top))])


def _calibrated(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a logistic by Newton's steps, drawn towards the highest window alone; a step is halved until it helps."""
    prior, pull = np.array([1.0, 0.0, 0.0]), np.diag([0.5, 0.5, 0.05])

    def loss(w: np.ndarray) -> float:
        y = x @ w
        return float((weights * (np.logaddexp(0, y) - labels * y)).sum() + 0.5 * (w - prior) @ pull @ (w - prior))

    w = prior.copy()
    for _ in range(30):
        s = _logistic(x @ w)
        slope = x.T @ (weights * (s - labels)) + pull @ (w - prior)
        step = np.linalg.solve((x * (weights * s * (1 - s))[:, None]).T @ x + pull, slope)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return w


def fit(texts: list[list[bytes]], labels: np.ndarray, share: float, rounds: tuple[int, int] = (2, 8), batch: int = 512, rate: float = 0.01, least: int | None = None, seed: int = 3) -> Network:
    """A network from the windows of texts; share: that of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    network = Network(_fresh(rng))
    if not len(labels):
        network.p["out"][:], network.calibration = 0, np.zeros(3)
        return network
    x = inputs([w for t in texts for w in t])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kept_back = (np.arange(len(texts)) % 5 == 0) & (len(texts) >= 50)
    least = max(2, min(8, len(texts) // 200)) if least is None else least
    # what few documents have tells them apart and not their kind: its embeddings stay zero
    pairs = np.unique(np.append(x.slots, -1)[x.windows] * len(texts) + owner[:, None])
    documents = np.bincount(pairs[pairs >= 0] // len(texts), minlength=1 << BITS)
    met = np.unique(x.windows * len(texts) + owner[:, None]) // len(texts)
    of_word = np.bincount(met, minlength=len(x.slots) + 1)
    of_run = sum(np.bincount(slots, np.repeat(of_word[words_of], np.diff(np.append(begins, len(slots)))), minlength=1 << BITS) for slots, begins, words_of in x.grams)
    frequent = {"words": documents >= least, "chars": of_run >= least}
    for name, mask in frequent.items():
        network.p[name] *= mask[:, None]
    even = np.where(labels > 0.5, 0.5 / max(1, (labels > 0.5).sum()), 0.5 / max(1, (labels <= 0.5).sum())) * len(labels)
    sizes = np.bincount(owner, minlength=len(texts))
    weight = even[owner] / np.sqrt(sizes[owner])
    adam = _Adam(network.p, rate)
    learned = np.flatnonzero(~kept_back[owner])
    batch = min(batch, max(32, len(learned) // 64))  # so that small samples take as many steps
    for turn in range(sum(rounds)):
        if turn < rounds[0]:
            chosen, mass = learned, weight
        else:  # the two highest windows of each text, and one more, drawn evenly
            raw = raw_scores(network, x)
            order = np.lexsort((-raw, owner))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            toxic = labels[owner] > 0.5
            drawn = ~toxic & (rank == rng.integers(0, sizes)[owner])
            chosen, mass = np.flatnonzero(((rank < np.where(toxic, 2, 4)) | drawn) & ~kept_back[owner]), even[owner] / np.where(rank == 0, 1, 2)
        chosen = rng.permutation(chosen)
        for low in range(0, len(chosen), batch):
            some = chosen[low : low + batch]
            part = _of(x, x.windows[some])
            heard = (rng.random(len(part.slots)) > 0.2).astype(np.float32)
            slopes = gradients(network.p, part, labels[owner[some]], mass[some] / mass[some].sum(), heard)[1]
            for name, mask in frequent.items():
                slopes[name] *= mask[:, None]
            adam.step(slopes)
        adam.rate *= 0.85
    held = kept_back if kept_back.any() and len(set(labels[kept_back] > 0.5)) == 2 else np.ones(len(texts), dtype=bool)
    true = np.where(labels > 0.5, share / max(1e-9, (labels[held] > 0.5).mean()), (1 - share) / max(1e-9, (labels[held] <= 0.5).mean()))
    design = _design(*_of_texts(raw_scores(network, x), owner, len(texts)))
    network.calibration = _calibrated(design[held], labels[held], true[held])
    return network


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 1500, max_windows: int = 24) -> Network:
    """A network from at most ``max_rows`` labels of each kind, the least by hash of their id, and at most ``max_windows`` windows of each one's text.

    The sample is chosen among the labels alone, so its broadcast to the texts has that bound, and so have the windows that reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), (F.col(label).cast("double") > 0.5).cast("int").alias("_label"))
    known = known.withColumn("_h", F.xxhash64("_id"))
    n, share = known.agg(F.count("*"), F.coalesce(F.avg("_label"), F.lit(0.0))).first()
    chosen = known.limit(0)
    for kind in (0, 1):
        chosen = chosen.unionByName(known.where(F.col("_label") == kind).orderBy("_h", "_id").limit(max_rows))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi")

    def cut(data: bytes) -> list[bytes]:
        found = []
        for piece in _pieces(data):
            _, starts, ends = words(piece)
            for low in range(0, max(1, len(starts) - STRIDE), STRIDE):
                last = min(low + WINDOW, len(starts)) - 1
                found.append(piece[starts[low] : ends[last]] if len(starts) else b"")
        found = [w for w in found if len(w) <= WINDOW_BYTES] or [b""]
        return [found[i] for i in sorted(set(np.linspace(0, len(found) - 1, min(len(found), max_windows)).astype(int).tolist()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "_text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([cut(t) for t in as_bytes(part.column(1))], pa.list_(pa.binary()))], names=["_id", "_mark", "_windows"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_text", F.xxhash64("_text").alias("_mark")).mapInArrow(run, f"_id {kind}, _mark long, _windows array<binary>")
    one = found.groupBy("_id").agg(F.min_by("_windows", "_mark").alias("_windows"))
    table = one.join(F.broadcast(chosen), "_id").orderBy("_h", "_id", "_label").select("_windows", "_label").toArrow()
    return fit(table.column("_windows").to_pylist(), np.asarray(table.column("_label").to_pylist(), dtype=float), float(share))


def score_texts(network: Network, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts."""
    top, expected = np.full(len(texts), -np.inf), np.zeros(len(texts))
    some: list[tuple[int, bytes]] = []

    def take() -> None:
        x = inputs([t for _, t in some])
        place = np.array([i for i, _ in some])[x.owner]
        highest, number = _of_texts(raw_scores(network, x), place, len(texts))
        np.maximum(top, highest, out=top)
        np.add(expected, number, out=expected)
        some.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text) if len(text) > PIECE else (text,):
            if some and size + len(piece) > PIECE:
                take()
                size = 0
            some.append((i, piece))
            size += len(piece)
    if some:
        take()
    return _logistic(_design(top, expected) @ network.calibration)


def score(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, as_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
