"""The queries of this subpackage: thin digests of its operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embedding_dup, near_dup, oracles, packing, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_fst, url_filter, warc

#: The url entries (host, path, action).
URL_ENTRIES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(spark, warc.write_warc(table(spark, sf_dir, "pages")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_ENTRIES)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < secret_scan.BASE)
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind, *_ in secret_scan.KINDS[: secret_scan.BASE]]  # noqa: B023  used at once
    return got.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the contract, and `private`: whether any span was found."""
    got = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023  used at once
    return got.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("private"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_quality_rules, op4_minhash_near_dedup, op5_url_filters, op6_secret_scans, op7_embedding_near_dedup, op8_sentencepiece, op9_packing, op10_pii)}
ORACLE: dict[str, str] = {
    "op2_warc": oracles.WARC, "op3_quality_rules": oracles.QUALITY_RULES, "op4_minhash_near_dedup": oracles.NEAR_DUP,
    "op5_url_filters": oracles.URLS, "op6_secret_scans": oracles.SECRETS, "op7_embedding_near_dedup": oracles.EMBEDDINGS,
}
