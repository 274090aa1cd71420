"""Queries: stored tables, the feature store, read views, payload parsers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.operators import filings, models, monitoring, store
from tidemark.operators import technical as T
from tidemark.plans import market as M
from tidemark.plans.base import Registry, rounded, with_
from tidemark.sources import payloads, synthetic, tables

R = Registry()


def _folder(spark) -> str:
    """A folder of its own in the cluster's shared one; a local session without one gets a folder of this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{d.rstrip('/')}/tidemark/store-{uuid.uuid4().hex}"


@R.query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 1")
def upsert_orders(spark, sf):
    """Orders upserted into a stored table: every tenth with another price, and copies of some under new keys."""
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    t = store.Table(spark, _folder(spark), ["o_orderkey"])
    t.upsert(o)
    new = o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).union(o.where("o_orderkey % 10 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    t.upsert(new)
    return t.read().select("o_orderkey", "o_custkey", "o_totalprice")


@R.query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def keep_last(spark, sf):
    li = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return store.keep_last(li, ["l_orderkey", "l_linenumber"], "l_partkey")


@R.query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click'")
def append_log(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    t = store.Table(spark, _folder(spark), ["event_id"])
    t.append(e.where("event_type IN ('purchase', 'signup')"))
    t.append(e.where("event_type = 'click'"))
    return t.read()


_F = ["return_20d", "realised_vol_20d", "dist_52w_high"]


@R.query(with_("SELECT symbol, ts, " + ", ".join(f"round({c}, 9) AS {c}" for c in _F) + " FROM f2", "bars", **M.FEATURES))
def feature_store_roundtrip(spark, sf):
    p = T.add(tables.bars(spark, sf), {**{k: T.RETURN_SET[k] for k in ("return_1d", "return_20d")}, "dist_52w_high": T.RANGE_SET["dist_52w_high"]}, {"realised_vol_20d": T.VOL_SET["realised_vol_20d"]})
    path = _folder(spark)
    store.write_features(p, path, "v1", _F)
    store.write_features(p.withColumn("return_20d", F.lit(0.0)), path, "v2", _F)
    return rounded(store.unpack_features(spark.read.parquet(path), _F, "v1"), 9)


@R.query(with_("SELECT feature, round(share, 6) AS share FROM (SELECT unnest(['return_1d', 'return_252d', 'sma_200']) AS feature, unnest([avg(CASE WHEN return_1d IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN return_252d IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN sma_200 IS NULL THEN 1.0 ELSE 0.0 END)]) AS share FROM f1)", "bars", **M.FEATURES))
def missing_shares(spark, sf):
    p = T.add(tables.bars(spark, sf), {**{k: T.RETURN_SET[k] for k in ("return_1d", "return_252d")}, "sma_200": T.SMA_SET["sma_200"]})
    cols = ["return_1d", "return_252d", "sma_200"]
    got = p.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return rounded(got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in cols])).alias("x")).select("x.*"))


@R.query("SELECT r.source_id, coalesce(n, 0) AS n_runs, CAST(coalesce(records, 0) AS BIGINT) AS records, coalesce(status, 'NEVER_RUN') AS status, last_started FROM (SELECT DISTINCT p_brand AS source_id FROM part UNION SELECT 'none') r LEFT JOIN (SELECT p_brand AS source_id, count(*) AS n, sum(l_linenumber) AS records, max(l_shipdate) AS last_started, max_by(l_linestatus, {'t': l_shipdate, 'k': l_orderkey, 'n': l_linenumber, 's': l_linestatus}) AS status FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) USING (source_id)")
def provider_health(spark, sf):
    """Brands as sources, their lines as runs."""
    runs = tables.table(spark, sf, "lineitem").join(tables.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    runs = runs.select(F.col("p_brand").alias("source_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_linestatus").alias("started"), F.col("l_linenumber").cast("long").alias("records"), F.col("l_linestatus").alias("status"))
    catalogue = tables.table(spark, sf, "part").select(F.col("p_brand").alias("source_id")).distinct().union(spark.createDataFrame([("none",)], "source_id string"))
    return store.provider_health(runs, catalogue).withColumn("last_started", F.col("last_started.l_shipdate"))


@R.query("SELECT reason, count(*) AS n FROM (SELECT o_orderpriority AS reason FROM orders UNION ALL SELECT 'STATUS_' || o_orderstatus FROM orders) GROUP BY reason")
def reason_code_counts(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.to_json(F.array("o_orderpriority", F.concat(F.lit("STATUS_"), "o_orderstatus"))).alias("reason_codes_json"))
    return store.reason_counts(o)


@R.query("SELECT event_id, event_type, value FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 100)")
def newest_events(spark, sf):
    return store.latest(tables.table(spark, sf, "events"), "ts", 100).select("event_id", "event_type", "value")


@R.query("SELECT event_type, CAST(greatest(least(floor(value / 10), 29), 0) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def value_histogram(spark, sf):
    """Thirty bins of ten, the last closed."""
    return tables.table(spark, sf, "events").groupBy("event_type", F.expr("CAST(greatest(least(floor(value / 10), 29), 0) AS INT)").alias("bin")).agg(F.count("*").alias("n"))


def _payload(spark, sf):
    """Bars as a provider would send them: one JSON text a symbol."""
    b = tables.bars(spark, sf).selectExpr("symbol", "unix_seconds(CAST(ts AS TIMESTAMP)) AS t", "open", "high", "low", "close", "CAST(volume AS BIGINT) AS v").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("t", "open", "high", "low", "close", "v"))).alias("x"))
    quote = F.array(F.struct(*[F.col(f"x.{c}").alias(n) for c, n in (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"), ("v", "volume"))]))
    result = F.array(F.struct(F.col("x.t").alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    return b.select("symbol", F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("payload"))


@R.query(with_("SELECT symbol, ts, open, high, low, close, close AS adjusted_close, CAST(volume AS BIGINT) AS volume FROM bars", "bars"))
def parse_chart_payloads(spark, sf):
    return payloads.chart_bars(_payload(spark, sf))


@R.query("SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, CAST(date_trunc('month', o_orderdate) + INTERVAL 7 DAY AS TIMESTAMP) AS published, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3")
def parse_series_csv(spark, sf):
    return payloads.series_csv(_csv(spark, sf))


def _csv(spark, sf):
    """Monthly counts of orders as series, with gaps."""
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    lines = o.groupBy("series").agg(F.concat_ws("\n", F.lit("DATE,VALUE"), F.concat_ws("\n", F.collect_list(F.concat_ws(",", F.date_format("m", "yyyy-MM-dd"), F.col("n").cast("string")))), F.lit("1990-01-01,."), F.lit("1990-02-01,")).alias("payload"))
    return lines


@R.query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'other' AS category, least(1.0, CAST(event_id % 12 AS DOUBLE) / 10) AS probability FROM events WHERE event_id % 3 = 0")
def parse_market_events(spark, sf):
    e = tables.table(spark, sf, "events")
    yes = F.when(F.col("event_id") % 3 == 0, F.lit('["Yes", "No"]')).otherwise(F.lit('["Up", "Down"]'))
    prices = F.concat(F.lit('["'), (F.col("event_id") % 12 / 10).cast("string"), F.lit('", "0"]'))
    market = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("question"), yes.alias("outcomes"), prices.alias("outcomePrices")))
    raw = e.select(F.col("ts").alias("observed"), F.to_json(F.array(F.struct(F.lit("t").alias("title"), market.alias("markets")))).alias("payload"))
    return payloads.market_events(raw).select("event_id", "category", "probability")


def _facts(spark, sf):
    f = tables.facts(spark, sf)
    tags = {"revenue": "revenue", "eps_diluted": "net / 1000", "gross_profit": "net", "operating_income": "net - cost", "operating_cash_flow": "net", "capex": "cost", "long_term_debt": "cost", "cash": "units", "stockholders_equity": "net", "shares_outstanding": "CAST(n AS DOUBLE)"}
    x = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.expr(e).alias("value")) for t, e in tags.items()]))
    return f.withColumn("x", x).selectExpr("symbol", "x.tag AS tag", "x.value AS value", "period_end - INTERVAL 91 DAYS AS period_start", "period_end", "published AS filed_date", "CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form_type")


@R.query(with_("SELECT f.symbol, f.published, f.period_end, f.revenue, f.net / 1000 AS eps, round((f.revenue - p.revenue) / abs(nullif(p.revenue, 0)), 6) AS revenue_growth, round((f.net - p.net) / abs(nullif(p.net, 0)), 6) AS eps_growth, round(f.net / nullif(f.revenue, 0), 6) AS gross_margin, round((f.net - f.cost) / nullif(f.revenue, 0), 6) AS operating_margin, round((f.net - f.cost) * 0.79 / (f.cost + f.net), 6) AS roic, round(f.cost, 4) AS debt FROM facts f LEFT JOIN facts p ON p.symbol = f.symbol AND p.period_end BETWEEN f.period_end - INTERVAL 400 DAY AND f.period_end - INTERVAL 330 DAY", "facts"))
def filing_observations(spark, sf):
    got = filings.observations(_facts(spark, sf))
    return got.select("symbol", "published", "period_end", "revenue", "eps", *[F.round(c, 6).alias(c) for c in ("revenue_growth", "eps_growth", "gross_margin", "operating_margin", "roic")], F.round("debt", 4).alias("debt"))


@R.query(with_("SELECT f.symbol, f.published, round(b.close / nullif(f.net / 1000, 0), 6) AS pe_ratio, round(b.close * f.n / nullif(f.net, 0), 6) AS price_to_book FROM facts f ASOF LEFT JOIN bars b ON b.symbol = f.symbol AND b.ts >= f.published", "facts", "bars"))
def valuation_ratios(spark, sf):
    got = filings.valuation_ratios(filings.observations(_facts(spark, sf)), tables.bars(spark, sf))
    return rounded(got.select("symbol", "published", "pe_ratio", "price_to_book"))


_SUFFIX = ["_percentile", "_regime_code", "_20d", ""]
_NAMES = ["news_count", "eventprob_oil", "macro_raw_cpi", "fund_raw_roic", "breadth_50", "agent_score", "rsi_14", "return", "dollar_volume", "event_uncertainty", "thing"]


@R.query(f"SELECT feature, CASE WHEN starts_with(feature, 'eventprob_') THEN 'eventprob' WHEN starts_with(feature, 'macro_raw_') THEN 'macro_raw' WHEN starts_with(feature, 'news_') THEN 'news' WHEN starts_with(feature, 'fund_raw_') THEN 'fundamental' WHEN starts_with(feature, 'breadth_') THEN 'market_breadth' WHEN starts_with(feature, 'agent_') THEN 'agent' WHEN ends_with(feature, '_regime_code') THEN 'macro_regime' WHEN ends_with(feature, '_percentile') THEN 'cross_sectional' WHEN feature = 'event_uncertainty' THEN 'news' WHEN feature IN ('rsi_14', 'return_20d', 'dollar_volume') THEN 'technical' ELSE 'other' END AS family, count(*) AS n FROM (SELECT ({_NAMES})[CAST(p_partkey % {len(_NAMES)} AS INT) + 1] || ({_SUFFIX})[CAST(p_size % {len(_SUFFIX)} AS INT) + 1] AS feature FROM part) GROUP BY 1, 2")
def feature_families(spark, sf):
    """Families of names that the parts make, by one column expression."""
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(by) % len(names) + 1).cast("int"))
    rows = tables.table(spark, sf, "part").select(F.concat(pick(_NAMES, "p_partkey"), pick(_SUFFIX, "p_size")).alias("feature"))
    return rows.withColumn("family", models.families(F.col("feature"))).groupBy("feature", "family").agg(F.count("*").alias("n"))


_RULES = [("price_positive", "l_extendedprice > 0", "ERROR"), ("discount_small", "l_discount < 0.1", "WARNING"), ("tax_small", "l_tax < 0.08", "WARNING")]


@R.query("SELECT l_orderkey, l_partkey, 'price_positive' AS rule, 'ERROR' AS severity FROM lineitem WHERE NOT l_extendedprice > 0 UNION ALL SELECT l_orderkey, l_partkey, 'discount_small', 'WARNING' FROM lineitem WHERE NOT l_discount < 0.1 UNION ALL SELECT l_orderkey, l_partkey, 'tax_small', 'WARNING' FROM lineitem WHERE NOT l_tax < 0.08")
def quality_flags(spark, sf):
    return monitoring.quality_flags(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], _RULES)


@R.query("SELECT rule, severity, count(*) AS n FROM (SELECT 'discount_small' AS rule, 'WARNING' AS severity FROM lineitem WHERE NOT l_discount < 0.1 UNION ALL SELECT 'tax_small', 'WARNING' FROM lineitem WHERE NOT l_tax < 0.08) GROUP BY 1, 2")
def severity_counts(spark, sf):
    return monitoring.severity_counts(quality_flags(spark, sf).where("severity = 'WARNING'"), ["rule", "severity"])


@R.query(with_("SELECT run_id, ts, round(CASE WHEN count(r) OVER w >= 63 THEN avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) * sqrt(252.0) END, 6) AS sharpe FROM (SELECT symbol AS run_id, ts, close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars) WINDOW w AS (PARTITION BY run_id ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "bars"))
def rolling_sharpe(spark, sf):
    return rounded(monitoring.rolling_sharpe(tables.bars(spark, sf).selectExpr("symbol AS run_id", "ts", "close AS equity")))


@R.query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '2000-01-01'")
def filtered_view(spark, sf):
    from datetime import datetime

    return monitoring.view(tables.table(spark, sf, "orders"), {"o_orderstatus": ["O", "P"]}, ("o_orderdate", datetime(2000, 1, 1))).select("o_orderkey", "o_orderstatus", "o_orderdate")


@R.query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 7 END AS records FROM events")
def ingestion_runs(spark, sf):
    """Events as runs; those of errors never finished."""
    e = tables.table(spark, sf, "events")
    runs = e.selectExpr("event_id AS run_id", "user_id", "'FAILED' AS status", "0 AS records")
    done = e.where("event_type <> 'error'").selectExpr("event_id AS run_id", "'SUCCESS' AS status", "event_id % 7 AS records")
    return monitoring.finished(runs, done).select(F.col("run_id").alias("event_id"), "user_id", "status", "records")


@R.query()
def synthetic_market(spark, sf):
    return synthetic.synthetic_bars(spark, 10, "2020-01-02", 500)


@R.query("SELECT * FROM (VALUES ('bars', 11 * 500, TRUE), ('filings', 10 * 8, TRUE), ('macro', 4 * 23, TRUE), ('news', 10 * 500, TRUE), ('regimes', 500, TRUE)) AS t(relation, n, holds)")
def synthetic_invariants(spark, sf):
    """Rows of each synthetic relation (10 symbols and the benchmark, 500 days, which have 8 quarters' and 23 months' ends), and whether all of
    them hold what they must."""
    of = (10, "2020-01-02", 500)
    tests = {
        "bars": (synthetic.synthetic_bars(spark, *of), "high >= greatest(open, close) AND low <= least(open, close) AND low > 0 AND volume >= 0"),
        "filings": (synthetic.synthetic_filings(spark, *of), "date_diff(published, period_end) BETWEEN 35 AND 54 AND revenue > 0 AND gross_margin BETWEEN 0.05 AND 0.85 AND operating_margin < gross_margin"),
        "macro": (synthetic.synthetic_macro(spark, *of[1:]), "date_diff(published, period) BETWEEN 3 AND 11 AND value > 0"),
        "news": (synthetic.synthetic_news(spark, *of), "abs(news_sentiment) <= 1 AND event_uncertainty BETWEEN 0 AND 1"),
        "regimes": (synthetic.synthetic_regimes(spark, *of[1:]), f"regime IN ({', '.join(repr(x) for x in synthetic.REGIMES)})"),
    }
    out = None
    for name, (df, test) in tests.items():
        one = df.agg(F.count("*").cast("int").alias("n"), F.expr(f"every({test})").alias("holds")).select(F.lit(name).alias("relation"), "n", "holds")
        out = one if out is None else out.union(one)
    return out
