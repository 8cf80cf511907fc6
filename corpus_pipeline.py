"""Training-data pipeline: stages over `documents`, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of documents;
the last returns one row of token ids for each document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import boosted_rules, byte_bpe, edit_leaks, shingle_join, template_dedup
from cohortspark.llm.store import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees."""
    trees = boosted_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return boosted_rules.keep(docs, trees)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars follows the text."""
    out = template_dedup.drop_recurring(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return shingle_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_leaks.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontamination", decontamination), ("byte_encoding", byte_encoding)]

#: The trees, edit distances and merges are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
