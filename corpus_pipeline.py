"""A training-corpus pipeline: each stage is one operator applied to what the stage before kept.

language ID -> one document of each near-duplicate group -> benchmark passages cut ->
secrets replaced -> sources mixed to target weights, as a shuffled corpus in shards.

run() writes each stage as Parquet below the folder that spark.checkpoint.dir names and reads it again.
Rows keep the columns of documents, and others of any name, until the last stage; where a text changes, n_chars follows it.
Every stage takes an empty table and then gives none of its rows. Very long texts are worked through whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, folds, language, mixing, ngram_join, secrets
from paperloom.session import read, shared_folder, ship


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, if there is one, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rejected ones go, and with them null texts and those without a letter.

    Equal texts fare alike, and repeated rows stay repeated; a null in another column changes nothing.
    """
    ship(spark)
    model = language.learn(read(spark, sf_dir, "documents").where(~folds.held_out()))
    return language.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    A null text, or one without words, is a group of its own. Of repeated rows one stays; null ids come last; rows of one id and
    different texts are different documents.
    """
    ship(spark)
    return ngram_join.firsts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document left without a word goes.

    Other texts, null ones too, stay as they are; repeated rows stay repeated; nulls in benchmark have no words.
    """
    ship(spark)
    return _with_length(decontamination.cut(docs, read(spark, sf_dir, "benchmark")))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays, with a null text as it is, and repeated rows stay repeated."""
    ship(spark)
    return _with_length(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row with the text for each time a document is taken, by shard, in shuffled order.

    A null or blank text is never taken; a null source is a source of its own; repeated rows each count; ties of order follow the id.
    """
    ship(spark)
    return mixing.dealt(mixing.mix(docs, carry=("text",)))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", replace_secrets),
    ("source_mixing", mix_sources),
]

#: Compression sizes, sketches, tokenizers and hashed permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
