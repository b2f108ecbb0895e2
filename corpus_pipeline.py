"""Corpus preparation in five stages; each takes what the one before it kept.

1. language ID: documents without letters, and texts unlike any learnt language, go
2. exact dedup: of equal texts the one with the largest id stays
3. SimHash near-dedup: of each group of near-duplicates the one with the smallest id stays
4. secret scans: found secrets are masked, ``n_chars`` follows
5. packing: the pieces of all remaining documents in sequences of 4,096 tokens

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import exact_dedup, language, packing, secret_scan, simhash  # noqa: E402
from plumbline.llm.common import stored, unused  # noqa: E402

TOKENIZER = "word_bpe_49k.json"
#: A text with more phrases than this for its length is in no learnt language: so many a character, and so many besides, as
#: few characters tell little. Fewer than ten can never exceed it.
FOREIGN_RATE, FOREIGN_BESIDES = 0.7, 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; what has no language goes."""
    model = language.fit(docs, ~language.held_out())
    found = unused(docs, "_language")
    told = language.with_language(docs, model, alias=found)
    foreign = F.col(found)["phrase_rate"] >= FOREIGN_RATE + FOREIGN_BESIDES / F.length("text")
    return told.where((F.col(found)["lang_pred"] != language.NONE) & ~foreign).drop(found)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within 3 bits."""
    return simhash.drop_near_duplicates(docs, width=3, budget=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked; no document goes."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
          ("secret scans", secrets), ("packing", packed)]
#: Cross-parsing, fingerprints, automata and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for label, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), label.replace(" ", "-"))
    return docs
