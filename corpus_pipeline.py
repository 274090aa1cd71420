"""From raw documents to packed training sequences: each stage's table is written as Parquet and is the next one's input.

A stage begins by letting go of what the stages before it kept in memory and in temporary tables, as their results are written by then.

Defined cases: all columns of documents, and any others, whatever their names, pass through all stages but the last, whose rows are pieces. A null
or empty text is scored by its statistics (all 0) and fails the rules. Rows with a null doc_id are judged like any others, link with nothing
and stay. Repeated rows are scored and judged alike; of those that share doc_id and text one stays, of near duplicates that of the smallest
doc_id; rows that share a doc_id but not their text are documents of their own. Ties in a score fall on the good side of the threshold. An
empty table gives empty tables. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_dup, packing, quality_classifier, quality_rules, secret_scan
from tidemark.llm.common import release, shared_dir
from tidemark.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    release(spark)
    return quality_classifier.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    release(spark)
    return quality_rules.filter_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id."""
    release(spark)
    ship(spark)
    return near_dup.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    release(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, with their ids."""
    import public_tokenizers

    release(spark)
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [("quality_classifier", classify), ("quality_rules", rules), ("near_duplicates", deduplicate), ("secret_scan", secrets), ("packing", pack)]
#: Trained models, sketches and a tokenizer decide here, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
