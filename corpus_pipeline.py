"""Corpus pipeline: five stages over ``documents``, each one of the ``trackloom.llm`` operators.

Every stage works on all rows its predecessor kept and, but for the last, returns the
columns of documents; the stages are written and read again between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import langid, mixing, packing, sanitise, simhash
from trackloom.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if it has no letter or no language reaches this pooled probability (four languages: chance is 0.25).
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing label gets the one recognised."""
    out = langid.predict(docs, langid.train(docs), keep=["text", "lang", "source", "n_chars"])
    out = out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8)."""
    return simhash.representatives(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without personal data in its text."""
    out = sanitise.sanitised(docs, keep=["lang", "source", "n_chars"])
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens meet the target weights."""
    return mixing.mix(docs.select(*COLUMNS)).filter("sampled").select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_memo=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Trained networks, sketches and tokenizers are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
