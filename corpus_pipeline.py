"""Corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes every stage's result as Parquet below
``spark.checkpoint.dir`` and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language, neardup, packing, toxicity
from lodestrata.llm.queries import _vocabulary, table
from lodestrata.llm.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's largest language proportion below which its language is not certain enough.
LEAST_SHARE = 0.4


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic prediction; the model is learned from this stage's own input and the labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=~toxicity.held_out())
    return toxicity.keep(_columns(docs), model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und``, and with a proportion of LEAST_SHARE at least."""
    model = language.train(docs.where(language.teaching()))
    return language.keep(_columns(docs), model, LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five words, 0.8): the one with the smallest doc_id.

    Rows that repeat that doc_id all stay.
    """
    gone = neardup.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return _columns(docs).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, _vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL can express neither the learned stages nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
