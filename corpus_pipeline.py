"""A corpus cleaning pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Defined results, for every stage: a null text is the empty text; it is never toxic by itself
nor contaminated, and of several one stays in exact_dedup; null ids are rows like any other,
and a row with an id is preferred to them; of equal texts the largest id stays, of a class of
near copies the least; rows that repeat id and text are one document; texts of any length are
read whole; an empty table gives an empty table; columns beyond doc_id and text pass through
all stages but the last, whatever their names. Without labels of both classes the toxicity
stage has one score for all: it drops nothing unless all labels are toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontamination, exact_dedup, near_dedup, packing, shared, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: a window of 13 words in a text of any length, or a twentieth of its words."""
    return decontamination.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, placed into sequences."""
    return packing.pack(spark, docs, tokens.vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("decontamination", drop_contaminated), ("packing", pack)]

#: The learned toxicity score and the hash-based near-duplicate classes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    at = shared.work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = shared.written(stage(spark, docs, sf_dir), f"{at}/{number}-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
