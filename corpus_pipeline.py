"""A training corpus from raw documents: language, exact copies, near copies, source mix, token ids."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, exactdedup, langid, mixing, nearcopies
from barloom.llm.common import materialize, release

#: Kept columns, in order.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a language: texts of the learned languages lie above 0.38, those of other alphabets near 0.
LEAST_SCORE = 0.3
VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, ``lang`` filled with the prediction where it was null.

    Texts that are null or have no letters go, and those that lie too far from every learned profile.
    """
    judged = langid.predict(docs.select(COLUMNS), langid.learned(docs))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exactdedup.drop_exact_duplicates(docs.select(COLUMNS)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: that with the smallest doc_id.

    SimHash tries walked with a wide budget find the pairs; rows with a null doc_id stay.
    """
    return nearcopies.drop_near_copies(docs.select(COLUMNS)).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that sources meet their target weights; null is a source, equal ids draw alike."""
    return mixing.mix(docs.select(COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document and copy; repeated rows repeat, null ids stay null."""
    return bpe.digest(docs, path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: Language profiles, fingerprint components and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written, read again by the next, and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = materialize(docs, f"stage-{name}")
            if k:
                release(before)
            docs = before = written
    return docs
