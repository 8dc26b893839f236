"""Corpus pipeline: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; all but the last return the columns of ``documents``. Every stage handles
an empty input (no rows out) and passes rows with null ids or texts on, unless
they are repeated.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.llm import decontaminate, minhash, packing, secrets, toxicity
from aeroframe.llm.common import bound_batches, fold_of, materialize, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(docs.where(fold_of("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    bound_batches(spark)
    return docs.where(model.score(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    leaks = materialize(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))
    return decontaminate.remove_leaks(docs, leaks)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    marked = secrets.redact_secrets(docs)
    return marked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# Learning, banded hashing, a singular value decomposition and a tokenizer have
# no SQL form; the tests hold the stages against brute-force versions of their decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
