"""The engine's relations, as derived from the order tables: bars, benchmark, sectors, filings, series, articles, memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The volume-weighted price. Money is summed in whole cents, so that it doesn't depend on the order of summing.
CLOSE = "sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0D / sum(l_quantity)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier: symbol, ts, open, high, low, close, volume. The close is the volume-weighted price; the
    open that of the first line by a total order. One aggregation, combined before its shuffle."""
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.expr("l_extendedprice / l_quantity"))
    return li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "p"))["p"].alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.expr(CLOSE).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def most_bars(spark: SparkSession, sf_dir: str) -> int:
    """No symbol has more bars than this: the most lines of one. Counted without making bars."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, close of all suppliers together."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.expr(CLOSE).alias("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector: the region of each supplier."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("sector"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly observations of each supplier, published 45 days after the quarter."""
    q = F.date_trunc("quarter", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), q.alias("q")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("net"), F.round(F.sum(F.expr("l_extendedprice * l_tax")), 4).alias("cost"), F.sum("l_quantity").alias("units"), F.count("*").alias("n")
    )
    end = F.expr("CAST(q + INTERVAL 3 MONTHS - INTERVAL 1 DAY AS TIMESTAMP_NTZ)")
    return li.select("symbol", end.alias("period_end"), F.expr("CAST(q + INTERVAL 3 MONTHS + INTERVAL 44 DAYS AS TIMESTAMP_NTZ)").alias("published"), "revenue", "net", "cost", "units", "n")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals for each order priority, published 10 days after the month, and a revision published 40 days after."""
    m = F.date_trunc("month", "o_orderdate")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), m.alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    first = o.select("series", F.expr("CAST(m AS TIMESTAMP_NTZ)").alias("period"), F.expr("CAST(m + INTERVAL 1 MONTH + INTERVAL 10 DAYS AS TIMESTAMP_NTZ)").alias("published"), "value")
    return first.union(first.select("series", "period", F.expr("published + INTERVAL 30 DAYS"), F.round(F.col("value") * 1.01, 4)))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles: a user is a symbol, the type of an event gives tier and category."""
    tier = F.expr("CASE event_type WHEN 'purchase' THEN 'TIER_1_OFFICIAL' WHEN 'signup' THEN 'TIER_2_MAJOR' WHEN 'click' THEN 'TIER_3_SECONDARY' WHEN 'view' THEN 'TIER_4_SOCIAL' ELSE 'UNKNOWN' END")
    category = F.expr("CASE event_type WHEN 'purchase' THEN 'earnings' WHEN 'signup' THEN 'M&A' WHEN 'click' THEN 'guidance' WHEN 'error' THEN 'litigation' ELSE 'other' END")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("article_id"), F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("published"), tier.alias("tier"), category.alias("category"), (F.col("event_type") == "error").alias("uncertain"), F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("headline"), "value")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, start_ts, end_ts: from each supplier's first shipping on; every third supplier leaves after its last but 100 days."""
    b = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z"))
    return b.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("a").alias("start_ts"), F.expr("CASE WHEN l_suppkey % 3 = 0 THEN z - INTERVAL 100 DAYS END").alias("end_ts"))


#: The same relations in DuckDB SQL, by name.
SQL = {
    "bars": "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'p': l_extendedprice / l_quantity}).p AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "bench": "SELECT l_shipdate AS ts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / sum(l_quantity) AS close FROM lineitem GROUP BY 1",
    "sectors": "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "facts": "SELECT symbol, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS TIMESTAMP) AS period_end, CAST(q + INTERVAL 3 MONTH + INTERVAL 44 DAY AS TIMESTAMP) AS published, revenue, net, cost, units, n FROM (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('quarter', l_shipdate) AS q, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, round(sum(l_extendedprice * l_tax), 4) AS cost, sum(l_quantity) AS units, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "macro1": "SELECT series, CAST(m AS TIMESTAMP) AS period, CAST(m + INTERVAL 1 MONTH + INTERVAL 10 DAY AS TIMESTAMP) AS published, value FROM (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)",
    "macro": "SELECT * FROM macro1 UNION ALL SELECT series, period, published + INTERVAL 30 DAY, round(value * 1.01, 4) FROM macro1",
    "articles": "SELECT event_id AS article_id, CAST(user_id AS VARCHAR) AS symbol, ts AS published, CASE event_type WHEN 'purchase' THEN 'TIER_1_OFFICIAL' WHEN 'signup' THEN 'TIER_2_MAJOR' WHEN 'click' THEN 'TIER_3_SECONDARY' WHEN 'view' THEN 'TIER_4_SOCIAL' ELSE 'UNKNOWN' END AS tier, CASE event_type WHEN 'purchase' THEN 'earnings' WHEN 'signup' THEN 'M&A' WHEN 'click' THEN 'guidance' WHEN 'error' THEN 'litigation' ELSE 'other' END AS category, event_type = 'error' AS uncertain, concat_ws('-', event_type, json_extract_string(props, '$.k')) AS headline, value FROM events",
    "members": "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(l_shipdate) AS start_ts, CASE WHEN l_suppkey % 3 = 0 THEN max(l_shipdate) - INTERVAL 100 DAY END AS end_ts FROM lineitem GROUP BY l_suppkey",
}
