"""Corpus pipeline: language ID, exact dedup, near-duplicate join, pseudonyms, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``; stages are written as Parquet and read again, so each is judged and recovered on its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm.exact_dedup import drop_duplicates
from heronlake.llm.jaccard_join import drop_linked
from heronlake.llm.language_id import UNKNOWN, fit, predict, remainder
from heronlake.llm.packing import pack_documents
from heronlake.llm.pii import pseudonymise_documents
from heronlake.llm.shared import stage

#: A document goes if fewer of its n-grams than this belong to any one language.
LEAST_SCORE = 0.25
#: Documents in one Arrow batch.
BATCH_ROWS = 1_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, ``lang`` set to the one found; those without letters or language go.

    Null text has no language. Repeated rows are judged alike; without any labelled row nothing is learned and all go.
    """
    model = fit(docs.where(remainder("doc_id") != 2))
    found = predict(docs, model)
    if not model.languages:
        return found.where(F.lit(False)).select(*docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of its repeats one. Null text counts as empty."""
    return drop_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; texts without words all stay."""
    return drop_linked(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by format-preserving pseudonyms; ``n_chars`` follows the new text. Null text stays null."""
    # the key belongs in a secret store; this one only makes results repeatable
    changed = pseudonymise_documents(docs, key="repeatable-example-key")
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2,048 ids: where each piece of each document lies. Null text packs as its end mark."""
    # workers serve all stages, so none keeps its words
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_words=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained filter nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    # whole documents pass through workers that serve all stages: smaller batches keep them small
    spark.conf.set(setting, BATCH_ROWS)
    try:
        for name, step in STAGES[:-1]:
            docs = stage(step(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(setting, before)
