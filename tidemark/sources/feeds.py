"""Parsers of JSON feeds: article lists, article searches and statistical tables. Raw texts in, typed rows out; nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the tier of financial media.
MEDIA_TIER = "TIER_2_FINANCIAL_MEDIA"
ARTICLE = ["headline", "published", "uncertain", "publisher", "tier", "url", "dedupe_key"]


def _articles(x: DataFrame, source: str, published: Column, publisher: str) -> DataFrame:
    got = x.select(
        F.coalesce("x.title", F.lit("")).alias("headline"), published.alias("published"), F.col(publisher).alias("publisher"),
        F.lit(MEDIA_TIER).alias("tier"), F.col("x.url").alias("url"), F.concat(F.lit(f"{source}::"), F.coalesce("x.url", F.lit("None"))).alias("dedupe_key"),
    )
    return got.withColumn("uncertain", F.col("published").isNull()).select(*ARTICLE)


def article_list(raw: DataFrame) -> DataFrame:
    """ARTICLE rows of {"articles": [{title, seendate: yyyyMMddTHHmmssZ, domain, url}]} (payload). Without a date an article is uncertain."""
    x = raw.select(F.explode(F.from_json("payload", "articles array<struct<title: string, seendate: string, domain: string, url: string>>")["articles"]).alias("x"))
    return _articles(x, "gdelt", F.expr("try_to_timestamp(nullif(x.seendate, ''), \"yyyyMMdd'T'HHmmss'Z'\")").cast("timestamp_ntz"), "x.domain")


def article_search(raw: DataFrame) -> DataFrame:
    """ARTICLE rows of {"articles": [{title, publishedAt: ISO 8601, source: {name}, url}]} (payload), in UTC."""
    x = raw.select(F.explode(F.from_json("payload", "articles array<struct<title: string, publishedAt: string, source: struct<name: string>, url: string>>")["articles"]).alias("x"))
    return _articles(x, "news_api", F.expr("try_cast(replace(nullif(x.publishedAt, ''), 'Z', '') AS TIMESTAMP_NTZ)"), "x.source.name")


def table_rows(raw: DataFrame) -> DataFrame:
    """table, line, period, value of {"BEAAPI": {"Results": {"Data": [{LineDescription, TimePeriod, DataValue}]}}} (table, payload); thousands
    are parted by commas, values that are no number are null."""
    kind = "BEAAPI struct<Results: struct<Data: array<struct<LineDescription: string, TimePeriod: string, DataValue: string>>>>"
    x = raw.select("table", F.explode(F.from_json("payload", kind)["BEAAPI"]["Results"]["Data"]).alias("x"))
    return x.selectExpr("table", "x.LineDescription AS line", "x.TimePeriod AS period", "try_cast(replace(x.DataValue, ',', '') AS DOUBLE) AS value")
