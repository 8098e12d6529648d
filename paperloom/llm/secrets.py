"""Secret scans: three base patterns, and a token-efficiency test for other random strings.

A run of key-like characters that a tokenizer's vocabulary covers badly (few characters a token)
is random text. Digests of known lengths, integrity digests, UUIDs, dates, numbers of books, preprints, parcels and bank accounts, and names, paths and versions whose every part is a number or a
word are identifiers, not secrets, and are left out of the test; letters alone count only with four consonants in a row or three at two places, as words of poor cover that can be spoken are no keys; so is what a base span covers already, but not the rest of its run.

One narrow pass over whole texts without a shuffle. Spans are in code points, end exclusive.

Defined cases: a null or empty text has no spans; equal texts and repeated rows have equal spans; a span is the whole
match (name and value for ``assign``); spans of equal start follow the order of kinds, and overlapping ones are cut out as one; very long texts are
scanned whole, in time that grows with their length and number of spans; an empty table gives no rows; ``scan`` reads no other columns and
``redact`` passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import tokenizer
from paperloom.llm.words import slices

KINDS = ("assign", "access", "hex", "random")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{12,}")
#: Known digests by length, UUIDs, integrity digests, paths of two plain names or more, numbers and dates.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]{27,86}={0,2}"
    r"|/?(?:[A-Z]?[a-z]+(?:[_-][a-z]+)*[0-9]*|[0-9]+)(?:/(?:[A-Z]?[a-z]+(?:[_-][a-z]+)*[0-9]*|[0-9]+))+/?"
    r"|[0-9+/_=-]+|\d{4}-?\d\d-?\d\d[T_-]\d\d(?:[_-]?\d\d){0,2}(?:Z|[+-]\d\d(?:-?\d\d)?)?)"
)
#: Identifiers of other kinds: book, preprint and parcel numbers, Roman numerals.
NUMBERS = re.compile(r"ISBN(?:-?1[03])?[-:]?[0-9-]{9,16}[0-9Xx]|(?i:arxiv)[-:_]?\d{4}[-_.]?\d{4,5}(?:v\d+)?|1Z\d{3}[0-9A-Z]{13}|[IVXLCDM]+|[ivxlcdm]+")
ACCOUNT = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
#: A part of a name: a number, or letters with a short number before or after them.
PART = re.compile(r"\d*|(?:\d{1,3})?([A-Za-z]?[a-z]*|[A-Z]+)(?:\d{1,8}[a-z]?\d{0,3})?")
_PARTS = re.compile(r"[_+/=-]+|(?<=[a-z])(?=[A-Z][a-z])")
_CONSONANTS = re.compile(r"(?i)[b-df-hj-np-tv-xz]{4}|[b-df-hj-np-tv-xz]{3}[aeiouy].*[b-df-hj-np-tv-xz]{3}")
#: A date at the start is left out of the test, not what follows it.
DATE = re.compile(r"^\d{4}-?\d\d-?\d\d[T_-]")
_DIGIT, _LETTER, _CHANGE = re.compile(r"\d"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z](?=[A-Z])")
LEAST_LENGTH = 12
MOST_CHARS_A_TOKEN = 2.1
#: For letters of hardly changing case; rare prose words reach 1.8.
MOST_LETTERS_A_TOKEN = 1.7

Span = tuple[str, int, int]


def _is_account(word: str) -> bool:
    """Whether a bank account number's check digits are right."""
    return bool(ACCOUNT.fullmatch(word)) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def _is_name(word: str, encoder: tiktoken.Encoding) -> bool:
    """Whether every part of a snake, kebab or camel name, path or triplet is a number or a word (with a number) that the vocabulary covers well; one short word in four may be covered badly."""
    parts = _PARTS.split(word)
    poor = 0
    for part in parts:
        m = PART.fullmatch(part)
        if not m:
            return False
        letters = m[1] or ""
        if len(letters) > 3 and len(letters) <= MOST_CHARS_A_TOKEN * len(encoder.encode_ordinary(letters)):
            poor += 1 if len(letters) < 7 else len(parts)
    return len(parts) > 1 and poor <= len(parts) // 4


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _uncovered(runs: Iterator[re.Match[str]], taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of the runs that no span covers; both come by start and are passed through once."""
    covered: list[list[int]] = []
    for _, a, b in taken:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    at = 0
    for m in runs:
        low, high = m.span()
        while at < len(covered) and covered[at][1] <= low:
            at += 1
        i = at
        while i < len(covered) and covered[i][0] < high:
            if low < covered[i][0]:
                yield low, covered[i][0]
            low = covered[i][1]
            i += 1
        if low < high:
            yield low, high


def random_spans(text: str, taken: list[Span], encoder: tiktoken.Encoding, most: float = MOST_CHARS_A_TOKEN) -> list[Span]:
    found = []
    for low, high in _uncovered(CANDIDATE.finditer(text), taken):
        word = text[low:high]
        if KNOWN.fullmatch(word) or NUMBERS.fullmatch(word):
            continue
        rest = DATE.sub("", word)
        if len(rest) < LEAST_LENGTH or not _LETTER.search(rest):
            continue
        mixed = _DIGIT.search(rest) or len(_CHANGE.findall(rest)) >= 4
        if not mixed and not _CONSONANTS.search(rest):
            continue  # words that can be spoken
        if len(rest) <= (most if mixed else min(most, MOST_LETTERS_A_TOKEN)) * len(encoder.encode_ordinary(rest)) and not _is_account(word) and not _is_name(rest, encoder):
            found.append(("random", low, high))
    return found


def spans(text: str | None, encoder: tiktoken.Encoding, most: float = MOST_CHARS_A_TOKEN) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if not text:
        return [], []
    order = {kind: i for i, kind in enumerate(KINDS)}
    base = sorted(base_spans(text), key=lambda s: (s[1], order[s[0]]))
    more = random_spans(text, base, encoder, most)
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def redacted(text: str, found: list[Span], mark: str) -> str:
    """The text with each merged span replaced by the mark."""
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], mark]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = tokenizer.DEFAULT_VOCABULARY, most: float = MOST_CHARS_A_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (joined) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer.read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoding(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [spans(t, encoder, most) for t in batch.column(1).to_pylist()]
                counts = [pa.array([sum(s[0] == kind for s in every) for _, every in found], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(every) for _, every in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", vocabulary: str = tokenizer.DEFAULT_VOCABULARY, most: float = MOST_CHARS_A_TOKEN) -> DataFrame:
    """All rows and columns, with every span of the text replaced by the mark."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer.read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoding(shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                place = batch.schema.get_field_index(text)
                values = batch.column(place).to_pylist()
                for i, value in enumerate(values):
                    if found := spans(value, encoder, most)[1]:
                        values[i] = redacted(value, found, mark)
                columns = [pa.array(values, f.type) if i == place else batch.column(i) for i, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
