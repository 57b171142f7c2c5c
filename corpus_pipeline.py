"""The corpus pipeline: five stages over documents, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. All but the last
return the columns of documents. Executors collect their garbage before each stage, so that heap which one stage grew doesn't stand
beside the Python workers of the next.

Defined results: a null or empty text has no language and goes at the first stage, and so do texts without a letter; all columns are kept as they are,
whatever their names, but text and n_chars, which follow the redaction; of linked rows that of the smallest doc_id stays, of
rows that agree in doc_id and text one; a row of a null doc_id stays unless it is linked to one that has an id; an empty table gives an
empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import jaccard, langid, leaks, pieces, pii
from cairnframe.llm.common import Stored, settle

PIECES = os.environ.get("CAIRNFRAME_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: `und` and texts that hardly resemble any learned language go."""
    settle(spark)
    filters = langid.learn(spark, docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    return langid.keep(spark, docs, filters)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links, the one of the smallest doc_id."""
    settle(spark)
    return jaccard.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    settle(spark)
    return leaks.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    settle(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = PIECES) -> DataFrame:
    """All columns of documents with n_pieces, ids and the text decoded from them."""
    settle(spark)
    with open(model, "rb") as f:
        return pieces.encode(spark, docs, f.read(), keep=docs.columns)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stored(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir))
        if store.n > 1:
            store.drop(store.n - 1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned filters, components of links, transducers: SQL can't express the stages. tests/llm holds run() against brute force.
ORACLE_SQL = None
