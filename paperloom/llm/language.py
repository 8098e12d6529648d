"""Language identification by compression.

Each language is a zstandard raw-content dictionary of sample text. A text is compressed with every
dictionary in turn, in pieces of a few KB, and belongs to the language whose dictionary leaves the
fewest bytes; where the two smallest sizes are close, the choice is marked as rejected.

Learning cuts the whole of every learned text into passages of ``PASSAGE`` characters. The ``passages`` distinct passages of the
least hashes of each language, however many copies texts have, are its dictionary: a bounded sample, all parts of all texts
having the same chance. Scoring reads whole texts and is one narrow pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties go to
the language with more learned rows, then to the smaller name; with nothing to learn from, as from an empty table, every text
is ``und``; a passage without a letter teaches nothing; very long texts are learned from and compressed piece by piece; repeated rows get equal
results; kept columns, of any name, pass through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.words import slices

PASSAGE = 512
PIECE = 4096
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Blanks after each piece let even a piece of a few words end as a compressed block.
_PAD = b" " * 64
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_TABLE = _LETTERS.tobytes()
#: What _plain keeps something of.
USABLE = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_LETTER = re.compile(r"[^\W\d_]")
FIELDS = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in the order of their learned rows."""

    dictionaries: tuple[tuple[str, bytes], ...]
    min_margin: float = 0.01


def _plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", passages: int = 64, min_margin: float = 0.01) -> LanguageModel:
    """Dictionaries of so many passages from the labelled rows; at most MAX_LANGUAGES languages, else ValueError."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null")
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PASSAGE}}}"), F.lit(0))  # in time that grows with the text, unlike substrings by place
    pieces = rows.select("lang", F.explode(cut).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    usable = F.col("text").rlike(USABLE)
    different = pieces.where(usable).groupBy("lang").agg(F.approx_count_distinct("key").alias("pieces"))
    counted = texts.join(different, "lang", "left").select("lang", "n", F.coalesce("pieces", F.lit(0)).alias("pieces")).limit(MAX_LANGUAGES + 1).collect()
    counts = {r["lang"]: r["n"] for r in counted}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel((), min_margin)
    # Copies share a hash, so the share let through follows the distinct passages and not the rows.
    scale = 1 << 30
    most = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(scale, scale * 8 * passages // max(1, r["pieces"])))])
    place = F.pmod("key", F.lit(scale))
    sample = (
        pieces.where((place < F.element_at(most, F.col("lang"))) & usable)
        .groupBy("lang", place.alias("place"), "key")
        .agg(F.min("text").alias("text"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "key")))
        .where(F.col("rank") <= passages)
        .orderBy("lang", "rank")
        .collect()
    )
    taught: dict[str, list[bytes]] = {}
    for row in sample:
        taught.setdefault(row["lang"], []).append(_plain(row["text"]))
    learned = sorted(taught, key=lambda k: (-counts[k], k))
    return LanguageModel(tuple((k, b" ".join(taught[k])) for k in learned), min_margin)


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.names = [k for k, _ in model.dictionaries]
        self.min_margin = model.min_margin
        self.compressors = []
        for _, content in model.dictionaries:
            settings = zstandard.ZstdCompressionParameters(
                window_log=17, chain_log=16, hash_log=15, search_log=3, min_match=3, target_length=16,
                strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))

    def one(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        plain = _plain(text)
        pieces = [plain[i : i + PIECE] + _PAD for i in range(0, len(plain), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], dtype=float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0, False
        least, second = np.partition(sizes, 1)[:2]
        margin = float((second - least) / second)
        score = float(1.0 / np.exp((least - sizes) / 4.0).sum())
        return self.names[best], score, margin, margin < self.min_margin


def _texts(batch: pa.RecordBatch, text: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(text)).to_pylist()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score, margin and rejected, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(keep)
    kinds = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "_text"):
                got = [scorer.one(x) for x in _texts(batch, "_text")]
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"_k{i}" for i in range(len(kept))), "lang_pred", "score", "margin", "rejected"])

    narrow = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)), FIELDS])
    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score", "margin", "rejected")


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, text):
                yield batch.filter(pa.array([not scorer.one(x)[3] for x in _texts(batch, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
