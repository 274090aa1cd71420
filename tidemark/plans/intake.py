"""Queries: payload parsers, ingest programs, read views, registries. Payloads are built from the driver's tables, so that SQL over these tables says
what must come back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import ingest, labels, metrics, models, monitoring, scores, store, views
from tidemark.plans import evaluation, known, storage
from tidemark.plans.base import Registry, rounded, with_
from tidemark.sources import catalogue, feeds, payloads, tables

R = Registry()


def _history(spark, sf, shift: str = "0"):
    """Bars as another provider sends them, their prices moved by a share."""
    cols = {"t": "date_format(ts, 'yyyy-MM-dd')", "o": "open", "h": "high", "l": "low", "c": f"close * (1 + {shift})", "v": "CAST(volume AS BIGINT)"}
    rows = tables.bars(spark, sf).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*[F.expr(x).alias(k) for k, x in cols.items()]))).alias("data"))
    return rows.select("symbol", F.to_json(F.struct("data")).alias("payload"))


@R.query(with_("SELECT symbol, ts, open, high, low, close, close AS adjusted_close, CAST(volume AS BIGINT) AS volume FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'", "bars"))
def parse_history_payloads(spark, sf):
    return payloads.history_bars(_history(spark, sf), "1996-01-01", "1998-12-31")


@R.query(
    "SELECT CAST(p_partkey AS VARCHAR) AS symbol, CAST(TIMESTAMP '2000-01-03' + to_days(CAST(p_size AS INT)) AS TIMESTAMP) AS ts, 'DIVIDEND' AS action, p_retailprice AS value FROM part UNION ALL "
    "SELECT CAST(p_partkey AS VARCHAR), TIMESTAMP '2001-01-03', CASE WHEN p_size >= CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 10 END THEN 'SPLIT' ELSE 'REVERSE_SPLIT' END, p_size / CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 10.0 END FROM part"
)
def parse_chart_actions(spark, sf):
    """Parts as companies: a dividend and a split each; every third split has no denominator."""
    p = tables.table(spark, sf, "part")
    at = lambda x: f"unix_seconds(CAST(TIMESTAMP_NTZ {x} AS TIMESTAMP)) + 52000"
    dividend = F.create_map(F.lit("d"), F.struct(F.expr("unix_seconds(CAST(TIMESTAMP_NTZ '2000-01-03' + make_dt_interval(CAST(p_size AS INT)) AS TIMESTAMP)) + 52000").alias("date"), F.col("p_retailprice").cast("double").alias("amount")))
    split = F.create_map(F.lit("s"), F.struct(F.expr(at("'2001-01-03'")).alias("date"), F.col("p_size").cast("double").alias("numerator"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 0.0D ELSE 10.0D END").alias("denominator")))
    result = F.array(F.struct(F.struct(dividend.alias("dividends"), split.alias("splits")).alias("events")))
    raw = p.select(F.col("p_partkey").cast("string").alias("symbol"), F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("payload"))
    return payloads.chart_actions(raw)


_TAGS = {"Revenues": "revenue", "NetIncomeLoss": "net", "SalesRevenueNet": "revenue * 2"}


def _companies(spark, sf):
    """Quarterly facts as companies report them; a less preferred tag of revenue is there too, and a form that isn't periodic."""
    f = tables.facts(spark, sf)
    one = lambda v: F.struct(F.expr("date_format(period_end - INTERVAL 91 DAYS, 'yyyy-MM-dd')").alias("start"), F.expr("date_format(period_end, 'yyyy-MM-dd')").alias("end"), F.expr(v).alias("val"), F.lit("a").alias("accn"), F.year("period_end").alias("fy"), F.lit("Q").alias("fp"), F.expr("CASE WHEN month(period_end) = 12 THEN '10-K' WHEN month(period_end) = 3 THEN '8-K' ELSE '10-Q' END").alias("form"), F.expr("date_format(published, 'yyyy-MM-dd')").alias("filed"))
    g = f.groupBy("symbol").agg(*[F.collect_list(one(v)).alias(t) for t, v in _TAGS.items()])
    space = F.create_map(*[x for t in _TAGS for x in (F.lit(t), F.struct(F.create_map(F.lit("USD"), F.col(t)).alias("units")))])
    return g.select("symbol", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), space).alias("facts"))).alias("payload"))


_FACT = "SELECT symbol, {t} AS tag, 'USD' AS unit, CAST(date_trunc('day', period_end - INTERVAL 91 DAY) AS TIMESTAMP) AS period_start, period_end, {v} AS value, CASE WHEN month(period_end) = 12 THEN '10-K' ELSE '10-Q' END AS form_type, published AS filed_date FROM facts WHERE month(period_end) <> 3"


@R.query(with_(f"{_FACT.format(t=chr(39) + 'revenue' + chr(39), v='revenue')} UNION ALL {_FACT.format(t=chr(39) + 'net_income' + chr(39), v='net')}", "facts"))
def parse_filing_facts(spark, sf):
    got = payloads.filing_facts(_companies(spark, sf))
    return got.select("symbol", "tag", "unit", "period_start", "period_end", "value", "form_type", "filed_date")


@R.query("SELECT o_orderpriority AS series, CAST(last_day(o_orderdate) AS TIMESTAMP) AS period, CAST(last_day(o_orderdate) + INTERVAL 15 DAY AS TIMESTAMP) AS published, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3")
def parse_monthly_json(spark, sf):
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("seriesID"), F.date_format("o_orderdate", "yyyy").alias("year"), F.concat(F.lit("M"), F.date_format("o_orderdate", "MM")).alias("period")).agg(F.count("*").cast("string").alias("value"))
    odd = o.select("seriesID", "year").distinct().selectExpr("seriesID", "year", "'M13' AS period", "'1' AS value").union(o.select("seriesID", "year").distinct().selectExpr("seriesID", "year", "'M01' AS period", "'-' AS value"))
    s = o.unionByName(odd).groupBy("seriesID").agg(F.collect_list(F.struct("year", "period", "value")).alias("data"))
    one = s.agg(F.collect_list(F.struct("seriesID", "data")).alias("series")).select(F.to_json(F.struct(F.struct("series").alias("Results"))).alias("payload"))
    return payloads.monthly_json(one)


@R.query("SELECT o_orderpriority AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period, CAST(date_trunc('day', o_orderdate) + INTERVAL 20 DAY AS TIMESTAMP) AS published, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3")
def parse_records_json(spark, sf):
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("record_date")).agg(F.count("*").cast("string").alias("avg"))
    odd = o.select("series").distinct().selectExpr("series", "'1990-01-01' AS record_date", "'null' AS avg")
    return payloads.records_json(o.unionByName(odd).groupBy("series").agg(F.to_json(F.struct(F.collect_list(F.struct("record_date", "avg")).alias("data"))).alias("payload")), "record_date", "avg")


@R.query("SELECT CAST(user_id AS VARCHAR) AS symbol, CASE event_type WHEN 'purchase' THEN 'M&A' WHEN 'signup' THEN 'earnings' WHEN 'click' THEN 'management' ELSE 'other' END AS category, ts AS published, event_type = 'signup' AS uncertain FROM events")
def parse_filing_events(spark, sf):
    """Events as current reports; those of one type have no acceptance time."""
    e = tables.table(spark, sf, "events")
    items = F.expr("CASE event_type WHEN 'purchase' THEN '9.01, 1.01' WHEN 'signup' THEN '5.02,2.02' WHEN 'click' THEN '5.02' ELSE '9.01' END")
    return payloads.filing_events(e.select(F.col("user_id").cast("string").alias("symbol"), items.alias("items"), F.expr("CASE WHEN event_type <> 'signup' THEN ts END").alias("accepted"), F.col("ts").alias("filed")))


@R.query("SELECT CAST(user_id AS VARCHAR) AS symbol, 'Title ' || event_id AS headline, 'http://x/' || event_id AS url, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published, 'feed::http://x/' || event_id AS dedupe_key FROM events")
def parse_feed_items(spark, sf):
    item = F.concat(F.lit("<item><title>Title "), "event_id", F.lit("</title><link>http://x/"), "event_id", F.lit("</link><pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    raw = tables.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("symbol")).agg(F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.collect_list(item)), F.lit("</channel></rss>")).alias("payload"))
    return payloads.feed_items(raw)


_MEDIA = "SELECT 'Title ' || event_id AS headline, {t} AS published, event_type = 'error' AS uncertain, event_type AS publisher, 'TIER_2_FINANCIAL_MEDIA' AS tier, 'http://x/' || event_id AS url, '{s}::http://x/' || event_id AS dedupe_key FROM events"


def _media(spark, sf, date: str, form: str, publisher):
    e = tables.table(spark, sf, "events")
    x = F.struct(F.concat(F.lit("Title "), "event_id").alias("title"), F.when(F.col("event_type") != "error", F.date_format("ts", form)).alias(date), publisher, F.concat(F.lit("http://x/"), "event_id").alias("url"))
    return e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(x).alias("articles"))).alias("payload"))


@R.query(_MEDIA.format(t="CASE WHEN event_type <> 'error' THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END", s="gdelt"))
def parse_article_list(spark, sf):
    return feeds.article_list(_media(spark, sf, "seendate", "yyyyMMdd'T'HHmmss'Z'", F.col("event_type").alias("domain")))


@R.query(_MEDIA.format(t="CASE WHEN event_type <> 'error' THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END", s="news_api"))
def parse_article_search(spark, sf):
    return feeds.article_search(_media(spark, sf, "publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'", F.struct(F.col("event_type").alias("name")).alias("source")))


@R.query("SELECT o_orderpriority AS \"table\", o_orderstatus AS line, strftime(o_orderdate, '%Y') AS period, CAST(count(*) * 1000 AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3")
def parse_table_rows(spark, sf):
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("LineDescription"), F.date_format("o_orderdate", "yyyy").alias("TimePeriod")).agg(F.format_number(F.count("*") * 1000, 0).alias("DataValue"))
    raw = o.groupBy("table").agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(F.struct("LineDescription", "TimePeriod", "DataValue")).alias("Data")).alias("Results")).alias("BEAAPI"))).alias("payload"))
    return feeds.table_rows(raw)


# Ingest programs.


def _with_errors(raw, failing: str):
    return raw.withColumn("error", F.when(F.expr(failing), F.lit("HTTP 500")))


def _prices(spark, sf):
    """Two providers of all symbols: the second's prices are 1 % off, or 10 % for some; some payloads failed."""
    symbols = tables.table(spark, sf, "lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").cast("string").alias("symbol"))
    asked = symbols.union(spark.createDataFrame([("none",)], "symbol string"))
    two = _history(spark, sf, "CASE WHEN CAST(symbol AS INT) % 7 = 0 THEN 0.1 ELSE 0.01 END")
    return ingest.prices(asked, _with_errors(storage._payload(spark, sf), "CAST(symbol AS INT) % 5 = 0"), _with_errors(two, "CAST(symbol AS INT) % 3 = 0"))


def _stored(spark, done, keys: list[str]):
    """What the store holds after two runs of a program, and its log."""
    table, log = store.Table(spark, storage._folder(spark), keys), store.Table(spark, storage._folder(spark), [])
    for _ in range(2):
        ingest.save(done, table, log)
    return table.read(), log.read()


_K = "CAST(symbol AS INT)"


@R.query(with_(f"SELECT symbol, ts, open, high, low, CASE WHEN {_K} % 5 = 0 THEN close * 1.01 ELSE close END AS close, CASE WHEN {_K} % 5 = 0 THEN close * 1.01 ELSE close END AS adjusted_close, CAST(volume AS BIGINT) AS volume FROM bars WHERE NOT ({_K} % 5 = 0 AND {_K} % 3 = 0) AND NOT ({_K} % 7 = 0 AND {_K} % 5 <> 0 AND {_K} % 3 <> 0) AND {_K} % 35 <> 0 UNION ALL SELECT symbol, ts, open, high, low, close * 1.1, close * 1.1, CAST(volume AS BIGINT) FROM bars WHERE {_K} % 35 = 0 AND {_K} % 3 <> 0", "bars"))
def ingest_prices(spark, sf):
    """Bars that two runs of the price program leave in the store: reconciled, those that differ by much left out."""
    rows, _ = _stored(spark, _prices(spark, sf), ["symbol", "ts"])
    return rows.select("symbol", "ts", "open", "high", "low", F.round("close", 9).alias("close"), F.round("adjusted_close", 9).alias("adjusted_close"), "volume")


R.oracle["ingest_prices"] = f"SELECT symbol, ts, open, high, low, (round(close, 9) + 0) AS close, (round(adjusted_close, 9) + 0) AS adjusted_close, volume FROM ({R.oracle['ingest_prices']})"


@R.query(with_(f"SELECT 'yahoo_finance' AS source_id, symbol AS item, CASE WHEN {_K} % 15 = 0 THEN 'FAILED' WHEN {_K} % 5 = 0 OR {_K} % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN {_K} % 15 = 0 OR ({_K} % 7 = 0 AND {_K} % 5 <> 0 AND {_K} % 3 <> 0) THEN 0 ELSE n END AS records, CASE WHEN {_K} % 15 = 0 THEN 'primary=HTTP 500; secondary=HTTP 500' END AS error FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) UNION ALL SELECT 'yahoo_finance', 'none', 'FAILED', 0, 'primary=None; secondary=None'", "bars"))
def ingest_price_runs(spark, sf):
    return _prices(spark, sf).runs


@R.query(with_("SELECT 'sec_edgar' AS source_id, symbol AS item, CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN 0 ELSE 2 * count(*) END AS records, CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN 'HTTP 500' END AS error FROM facts WHERE month(period_end) <> 3 GROUP BY symbol UNION ALL SELECT 'sec_edgar', 'none', 'UNAVAILABLE', 0, NULL", "facts"))
def ingest_fundamental_runs(spark, sf):
    raw = _companies(spark, sf)
    asked = raw.select("symbol").union(spark.createDataFrame([("none",)], "symbol string"))
    return ingest.fundamentals(asked, _with_errors(raw, "CAST(symbol AS INT) % 4 = 0")).runs


@R.query("SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, CAST(date_trunc('month', o_orderdate) + INTERVAL 7 DAY AS TIMESTAMP) AS published, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2, 3")
def ingest_macro(spark, sf):
    raw = _with_errors(storage._csv(spark, sf), "series = '1-URGENT'")
    return _stored(spark, ingest.macro(raw.select("series"), raw), ["series", "period", "published"])[0]


@R.query("SELECT 'gdelt::http://x/' || k AS dedupe_key, min(headline) AS headline, min(published) AS published FROM (SELECT event_id % 500 AS k, 'Title ' || event_id AS headline, ts AS published, min(ts) OVER (PARTITION BY event_id % 500) AS first FROM events WHERE event_id % 500 >= 100) WHERE published = first GROUP BY k")
def ingest_news(spark, sf):
    """Articles under keys that come again and again; a hundred keys are known already."""
    e = tables.table(spark, sf, "events").select(F.concat(F.lit("gdelt::http://x/"), (F.col("event_id") % 500).cast("string")).alias("dedupe_key"), F.concat(F.lit("Title "), "event_id").alias("headline"), F.col("ts").alias("published"))
    known_keys = e.where("CAST(substr(dedupe_key, 17) AS INT) < 100").select("dedupe_key").distinct()
    return _stored(spark, ingest.news(e, known_keys, "gdelt"), ["dedupe_key"])[0]


@R.query(with_("SELECT symbol, event_id, category, round(relevance, 6) AS relevance, rationale FROM mapping", "sectors", **{**known._MAP, "ev": known._MAP["ev"]}))
def ingest_event_mappings(spark, sf):
    """Relevance of the events that have a category."""
    return rounded(ingest.events(known._mapping_events(spark, sf), known._sector(spark, sf))[1])


@R.query("SELECT source_id, 'fetch' AS status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'a' ELSE 'b' END AS source_id FROM events) GROUP BY 1")
def provider_failures(spark, sf):
    """Health of two sources, from events as runs; counted by source."""
    e = tables.table(spark, sf, "events").selectExpr("CASE WHEN event_type = 'error' THEN 'a' ELSE 'b' END AS source_id", "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status", "1 AS records", "'e' AS error", "ts AS started", "ts + INTERVAL 2 SECONDS AS finished")
    sources = spark.createDataFrame([("a", True, None), ("b", True, None)], "source_id string, enabled boolean, reason string")
    got = ingest.health(e, sources).where("mean_latency_ms = 2000 AND ((source_id = 'a' AND last_success IS NULL AND last_error = 'e') OR (source_id = 'b' AND last_failure IS NULL))")
    return got.select("source_id", F.lit("fetch").alias("status"), F.col("records").alias("n"))


@R.query("SELECT * FROM (VALUES ('bea', 'MACRO', FALSE, 'requires BEA_API_KEY'), ('bls', 'MACRO', FALSE, 'switched off'), ('fred', 'MACRO', TRUE, NULL), ('treasury', 'MACRO', TRUE, NULL), ('news_api', 'NEWS', TRUE, NULL), ('gdelt', 'NEWS', TRUE, NULL)) AS t(source_id, category, enabled, reason)")
def provider_catalogue(spark, sf):
    return catalogue.catalogue(spark, {"NEWS_API_KEY"}, {"bls"}).where("category IN ('MACRO', 'NEWS')")


@R.query("SELECT sha256('main|' || s || '|2000-01-01') AS membership_id, 'main' AS universe, s AS symbol, TIMESTAMP '2000-01-01' AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts FROM (SELECT CAST(s_suppkey AS VARCHAR) AS s FROM supplier UNION SELECT 'BENCH')")
def universe_seed(spark, sf):
    """The suppliers as a universe, seeded twice."""
    s = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    t = store.Table(spark, storage._folder(spark), ["membership_id"])
    for _ in range(2):
        t.upsert(catalogue.seed(s, "main", "2000-01-01", "BENCH"))
    return t.read()


@R.query(with_("SELECT symbol, ts, CAST(date_diff('day', CAST(f.published AS DATE), CAST(b.ts AS DATE)) AS INT) AS days_since_filing FROM bars b ASOF LEFT JOIN (SELECT symbol AS s, published FROM facts) f ON b.symbol = f.s AND b.ts >= f.published", "bars", "facts"))
def days_since_filing(spark, sf):
    return ingest.days_since(tables.bars(spark, sf), tables.facts(spark, sf).select("symbol", "published"))


_HIST = ["num_analogues", "avg_return_5d", "prob_positive_5d", "avg_return_20d", "p10_return_20d", "p90_return_20d"]


@R.query(f"SELECT symbol, ts, {', '.join(f'CAST({c} AS DOUBLE) AS hist_{c}' for c in _HIST)}, greatest(0.0, least(1.0, similarity_confidence)) AS confidence FROM ({evaluation.R.oracle['analogue_knn']})")
def historical_scores(spark, sf):
    return scores.historical(evaluation.analogue_knn(spark, sf), _HIST)


@R.query(with_("SELECT 'technical' AS agent, symbol, ts, CAST(floor(close) AS DOUBLE) AS score, CAST(0.5 AS DOUBLE) AS confidence FROM bars UNION ALL SELECT 'market', '_MARKET_', ts, CAST(floor(close) AS DOUBLE), 0.25 FROM bench", "bars", "bench"))
def report_rows(spark, sf):
    """Closes as scores: a report for each symbol, and one of the market for all of them, once a date."""
    v = tables.bars(spark, sf).select("symbol", "ts", F.floor("close").cast("double").alias("own")).join(tables.benchmark(spark, sf).select("ts", F.floor("close").cast("double").alias("all")), "ts").selectExpr("*", "0.5D AS c", "0.25D AS m")
    rows = ingest.reports(v, {"technical": (["own"], "c"), "market": (["all"], "m")})
    got = views.decoded_reports(rows).select("agent", "symbol", "ts", F.coalesce(F.col("features")["own"], F.col("features")["all"]).alias("score"), "confidence")
    return got


@R.query("SELECT year + 1 AS year, n, prior AS champion_ic, rank_ic AS challenger_ic, coalesce(rank_ic, 0) >= 0 AND (prior IS NULL OR coalesce(rank_ic, 0) >= prior - 0.01 AND coalesce(rank_ic, 0) >= prior - 0.05) AS promoted FROM (SELECT *, lag(rank_ic, 1) OVER (ORDER BY year) AS prior FROM (" + evaluation.R.oracle["ic_by_year"] + "))")
def yearly_promotions(spark, sf):
    """Each year's rank correlation as a challenger of the year before. A row a year reaches the driver, as decisions are few."""
    rows = evaluation.ic_by_year(spark, sf).orderBy("year").collect()
    out, before = [], None
    for x in rows:
        of = lambda v: {"excess_return_5d": {"information_coefficient": v}}
        out.append((x.year + 1, x.n, before, x.rank_ic, models.promote(of(x.rank_ic), of(before) if before is not None else None)[0]))
        before = x.rank_ic
    return spark.createDataFrame(out, "year int, n bigint, champion_ic double, challenger_ic double, promoted boolean")


@R.query("SELECT round(avg(rank_ic), 6) AS mean_ic, count(*) AS folds FROM (" + evaluation.R.oracle["ic_by_year"] + ")")
def mean_fold_ic(spark, sf):
    return rounded(evaluation.ic_by_year(spark, sf).where("rank_ic IS NOT NULL AND NOT isnan(rank_ic)").agg(F.avg("rank_ic").alias("mean_ic"), F.count("*").alias("folds")))


@R.query("SELECT CAST(y AS INT) AS last_train_year, CAST(y + 1 AS INT) AS validation_year FROM (SELECT unnest(generate_series(1996, (SELECT max(year(l_shipdate)) FROM lineitem) - 1)) AS y)")
def calendar_folds(spark, sf):
    ends = tables.table(spark, sf, "lineitem").agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    return spark.createDataFrame(labels.expanding_folds(ends[0], 1996, ends[1]), "last_train_year int, validation_year int")


@R.query(with_("SELECT CAST(k AS INT) AS fold, c0.ts AS train_start, c1.ts AS validation_start, c2.ts AS validation_end FROM (SELECT unnest(generate_series(0, 100)) AS k) JOIN cal c0 ON c0.day = greatest(0, 500 + 250 * k - 400) JOIN cal c1 ON c1.day = 500 + 250 * k JOIN cal c2 ON c2.day = 500 + 250 * k + 249", "bars", **evaluation.CAL))
def rolling_folds(spark, sf):
    cal = labels.trading_calendar(tables.bars(spark, sf))
    return labels.fold_table(cal, labels.purged_folds(cal.count(), 500, 250, rolling=400))


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1")
def insert_once(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    t = store.Table(spark, storage._folder(spark), ["o_orderkey"])
    for k in (0, 1):
        t.insert_once(o.where(f"o_orderkey % 2 = {k}"))
    return t.read()


@R.query("SELECT series, max_by(value, period) AS value FROM (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2) GROUP BY series")
def wide_macro(spark, sf):
    first = tables.macro(spark, sf).groupBy("series", "period").agg(F.min_by("value", "published").alias("value"))
    return monitoring.wide_macro(first).select(F.explode("values").alias("series", "value"))


@R.query("SELECT user_id, max_by(event_type = 'error', {'t': ts, 'e': event_id}) AS engaged FROM events GROUP BY user_id")
def kill_switches(spark, sf):
    """Users as accounts: the newest entry of each switch's log."""
    e = tables.table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("ts"), (F.col("event_type") == "error").alias("engaged"))
    return monitoring.engaged_by(e, "user_id")


@R.query(with_("SELECT run_id, round(sum(notional) / avg(equity) / greatest(count(*) / 252.0, 1e-9), 5) AS turnover, round(avg(gross), 5) AS exposure FROM (SELECT symbol AS run_id, volume * close / 1000 AS notional, close * 100 AS equity, low / high AS gross FROM bars) GROUP BY run_id", "bars"))
def turnover_exposure(spark, sf):
    d = tables.bars(spark, sf).selectExpr("symbol AS run_id", "volume * close / 1000 AS notional", "close * 100 AS equity", "low / high AS gross")
    return rounded(metrics.turnover(d), 5)


@R.query("SELECT event_id, event_type, ts FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2000-01-01' ORDER BY ts DESC, event_id LIMIT 500)")
def view_news(spark, sf):
    e = tables.table(spark, sf, "events").withColumnRenamed("event_type", "category")
    return views.read("news", e, since=datetime(2000, 1, 1), category=["purchase", "error"]).withColumnRenamed("category", "event_type").select("event_id", "event_type", "ts")


@R.query("SELECT o_orderkey, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT min(o_custkey) FROM orders)")
def view_rejected_orders(spark, sf):
    o = tables.table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS symbol", "o_orderdate AS ts", "CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'APPROVED' END AS status")
    first = o.agg(F.min("symbol")).first()[0]
    return views.read("rejected_orders", o, limit=10_000, symbol=first).select("o_orderkey", "ts")


@R.query("SELECT o_orderkey, o_orderstatus AS status, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-06-01'")
def view_runs(spark, sf):
    o = tables.table(spark, sf, "orders").selectExpr("o_orderkey", "'s' AS source_id", "o_orderstatus AS status", "o_orderdate AS ts")
    return views.read("runs", o, limit=1_000_000, since=datetime(2000, 6, 1), status="O", source_id="s").select("o_orderkey", "status", "ts")


@R.query("SELECT s_suppkey AS model_version, 'CHAMPION' AS role FROM supplier WHERE s_suppkey = 7 AND (SELECT count(*) FROM supplier) > 6")
def view_champion(spark, sf):
    """Suppliers as models: the seventh is crowned after the third."""
    s = tables.table(spark, sf, "supplier").selectExpr("s_suppkey AS model_version", "'CHALLENGER' AS role", "s_suppkey AS ts")
    return views.read("champion", models.crown(models.crown(s, 3), 7)).select("model_version", "role")
