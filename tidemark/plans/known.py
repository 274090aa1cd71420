"""Queries: what was known when; reconciliation, articles, events, fundamentals, macro series, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import crosssection as X
from tidemark.operators import scores as S
from tidemark.operators.labels import trading_calendar as calendar
from tidemark.plans import market as M
from tidemark.plans.base import Registry, r, rounded, with_
from tidemark.sources import tables

R = Registry()
AT = "1998-06-30"
_ts = f"TIMESTAMP '{AT}'"


def as_of():
    return F.lit(AT).cast("timestamp_ntz")


@R.query(with_(f"SELECT symbol, period_end, published, revenue, net, cost, units, n FROM facts WHERE published <= {_ts} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY published DESC) = 1", "facts"))
def fundamentals_asof(spark, sf):
    return A.latest_asof(tables.facts(spark, sf), ["symbol"], ["published"], as_of())


@R.query(with_("SELECT b.symbol, b.ts, b.close, f.revenue, f.period_end FROM bars b ASOF LEFT JOIN facts f ON b.symbol = f.symbol AND b.ts >= f.published", "bars", "facts"))
def fundamentals_asof_daily(spark, sf):
    b = tables.bars(spark, sf).select("symbol", "ts", "close")
    return A.asof_join(b, tables.facts(spark, sf), ["symbol"], "ts", "published", {"revenue": "revenue", "period_end": "period_end"})


@R.query(with_(f"SELECT series, period, published, value FROM macro WHERE published <= {_ts} QUALIFY row_number() OVER (PARTITION BY series ORDER BY published DESC, period DESC) = 1", "macro"))
def macro_latest_asof(spark, sf):
    return A.latest_asof(tables.macro(spark, sf), ["series"], ["published", "period"], as_of())


@R.query(with_(f"SELECT series, period, published, value FROM macro WHERE published <= {_ts} QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY published DESC) = 1", "macro"))
def macro_history_asof(spark, sf):
    return A.latest_asof(tables.macro(spark, sf), ["series", "period"], ["published"], as_of())


_HIST = f"SELECT * FROM macro WHERE published <= {_ts} QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY published DESC) = 1"


@R.query(with_("SELECT series, round(CASE WHEN stddev_pop(value) = 0 THEN 0 ELSE (max_by(value, period) - avg(value)) / stddev_pop(value) END, 6) AS zscore, round(max_by(value, period), 6) AS level FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY period DESC) <= 36) GROUP BY series HAVING count(*) >= 3", "macro", h=_HIST))
def macro_zscore(spark, sf):
    return rounded(X.trailing_zscores(A.latest_asof(tables.macro(spark, sf), ["series", "period"], ["published"], as_of())))


@R.query(with_("SELECT b.symbol, b.ts, b.close FROM bars b WHERE EXISTS (SELECT 1 FROM members m WHERE m.symbol = b.symbol AND m.start_ts <= b.ts AND (m.end_ts IS NULL OR m.end_ts > b.ts))", "bars", "members"))
def universe_asof(spark, sf):
    return A.members_at(tables.bars(spark, sf).select("symbol", "ts", "close"), tables.memberships(spark, sf))


def _points(spark, sf):
    """Each symbol of the articles at the start of each day that has any."""
    a = tables.articles(spark, sf)
    days = a.select(F.date_trunc("day", "published").cast("timestamp_ntz").alias("ts")).distinct()
    return a.select("symbol").distinct().crossJoin(F.broadcast(days))


_POINTS = "SELECT DISTINCT symbol, d.ts FROM articles CROSS JOIN (SELECT DISTINCT CAST(date_trunc('day', published) AS TIMESTAMP) AS ts FROM articles) d"
_PAIRS = "SELECT p.symbol, p.ts, (epoch_us(p.ts) - epoch_us(a.published)) / 3.6e9 AS h, CASE a.tier WHEN 'TIER_1_OFFICIAL' THEN 1.0 WHEN 'TIER_2_MAJOR' THEN 0.85 WHEN 'TIER_3_SECONDARY' THEN 0.6 WHEN 'TIER_4_SOCIAL' THEN 0.3 ELSE 0.1 END AS w, a.category, a.value FROM points p JOIN articles a ON a.symbol = p.symbol AND NOT a.uncertain AND a.published <= p.ts AND a.published >= p.ts - INTERVAL 7 DAY"


@R.query(with_("SELECT p.symbol, p.ts, " + ", ".join(f"CAST(count(CASE WHEN h <= {h} THEN 1 END) AS DOUBLE) AS n_articles_{k}" for k, h in A.WINDOWS.items()) + ", round(CAST(coalesce(sum(CASE WHEN h <= 168 THEN w END), 0) AS DOUBLE), 6) AS source_weighted_count_7d, round(min(h), 6) AS hours_since_last_article FROM points p LEFT JOIN pairs USING (symbol, ts) GROUP BY p.symbol, p.ts", "articles", points=_POINTS, pairs=_PAIRS))
def news_asof_counts(spark, sf):
    return rounded(A.news_counts(_points(spark, sf), tables.articles(spark, sf)))


@R.query(with_("SELECT symbol, ts, round(avg(CAST(CASE category WHEN 'earnings' THEN 0.1 WHEN 'guidance' THEN 0.05 ELSE 0.0 END AS DOUBLE)), 6) AS news_sentiment, bool_or(category = 'earnings') AS is_earnings_event, count(*) AS n FROM pairs GROUP BY symbol, ts", "articles", points=_POINTS, pairs=_PAIRS))
def news_row_reduce(spark, sf):
    return rounded(_news(spark, sf))


def _news(spark, sf):
    """Mean sentiment and whether there is an earnings event, over 7 days."""
    p = A.lookback_pairs(_points(spark, sf), tables.articles(spark, sf), 7)
    sentiment = "CASE category " + " ".join(f"WHEN '{c}' THEN {v[0]!r}" for c, v in S.CATEGORIES.items()) + " ELSE 0.0 END"
    return p.groupBy("symbol", "ts").agg(F.avg(F.expr(f"CAST({sentiment} AS DOUBLE)")).alias("news_sentiment"), F.bool_or(F.col("category") == "earnings").alias("is_earnings_event"), F.count("*").alias("n"))


_CAT = lambda i: "CASE category " + " ".join(f"WHEN '{c}' THEN {v[i]!r}" for c, v in S.CATEGORIES.items()) + " END"


@R.query(with_(f"SELECT article_id, symbol, category, CAST({_CAT(0)} AS DOUBLE) AS sentiment, CAST({_CAT(1)} AS DOUBLE) AS impact, {_CAT(2)} AS horizon, round(CAST(least(1.0, CASE WHEN tier = 'TIER_1_OFFICIAL' THEN 0.2 ELSE 0.4 END + CASE WHEN uncertain THEN 0.2 ELSE 0.0 END) AS DOUBLE), 6) AS uncertainty, CAST(CASE WHEN count(*) OVER (PARTITION BY symbol, headline ORDER BY published RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) > 1 THEN 0.1 ELSE 1.0 END AS DOUBLE) AS novelty FROM articles", "articles"))
def article_classify(spark, sf):
    return rounded(S.classify_articles(tables.articles(spark, sf)))


@R.query(with_("SELECT headline, article_id, published FROM articles WHERE published >= TIMESTAMP '2024-01-05' AND headline NOT IN (SELECT headline FROM articles WHERE published < TIMESTAMP '2024-01-05') QUALIFY row_number() OVER (PARTITION BY headline ORDER BY published, article_id) = 1", "articles"))
def dedupe_articles(spark, sf):
    a, cut = tables.articles(spark, sf), F.lit("2024-01-05").cast("timestamp_ntz")
    return A.new_articles(a.where(F.col("published") >= cut), a.where(F.col("published") < cut), "headline")


def _events(spark, sf):
    """Documents as event titles."""
    return tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("event_id"), F.expr(S.keyword_category("coalesce(text, '')")).alias("category"))


_KEYS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in ks) + f" THEN '{c}'" for c, ks in S.KEYWORDS.items()) + " ELSE 'other' END"


@R.query(f"SELECT CAST(doc_id AS VARCHAR) AS event_id, {_KEYS} AS category FROM documents")
def event_categories(spark, sf):
    return _events(spark, sf)


def _mapping_events(spark, sf):
    n = F.col("p_partkey") % 6
    return tables.table(spark, sf, "part").select(F.col("p_partkey").alias("event_id"), F.element_at(F.array(*[F.lit(c) for c in [*S.RELEVANCE, "other"]]), (n + 1).cast("int")).alias("category"))


def _sector(spark, sf):
    return tables.sectors(spark, sf).select("symbol", F.expr("CASE sector WHEN 'AFRICA' THEN 'ENERGY' WHEN 'AMERICA' THEN 'TECH' WHEN 'ASIA' THEN 'FINANCE' WHEN 'EUROPE' THEN 'HEALTH' ELSE 'OTHER' END").alias("sector"))


_MAP = {
    "ev": "SELECT p_partkey AS event_id, (['monetary_policy', 'economic_outcomes', 'elections_policy', 'geopolitical', 'regulatory', 'other'])[CAST(p_partkey % 6 AS INT) + 1] AS category FROM part",
    "sec": "SELECT symbol, CASE sector WHEN 'AFRICA' THEN 'ENERGY' WHEN 'AMERICA' THEN 'TECH' WHEN 'ASIA' THEN 'FINANCE' WHEN 'EUROPE' THEN 'HEALTH' ELSE 'OTHER' END AS sector FROM sectors",
    "mapping": "SELECT symbol, event_id, category, CAST(CASE category WHEN 'monetary_policy' THEN 0.4 WHEN 'economic_outcomes' THEN 0.3 WHEN 'elections_policy' THEN 0.2 WHEN 'geopolitical' THEN 0.25 ELSE 0.15 END + CASE WHEN category = 'elections_policy' AND sector IN ('ENERGY', 'FINANCE', 'HEALTH') THEN 0.2 WHEN category = 'geopolitical' AND sector = 'ENERGY' THEN 0.15 WHEN category = 'regulatory' AND sector IN ('FINANCE', 'TECH') THEN 0.3 ELSE 0 END AS DOUBLE) AS relevance, CASE category WHEN 'monetary_policy' THEN 'monetary_policy' WHEN 'economic_outcomes' THEN 'macro_economic_outcomes' WHEN 'elections_policy' THEN 'policy_uncertainty' WHEN 'geopolitical' THEN 'geopolitical_risk' ELSE 'regulatory_exposure' END AS rationale FROM ev CROSS JOIN sec WHERE category <> 'other'",
}


@R.query(with_("SELECT symbol, event_id, category, round(relevance, 6) AS relevance, rationale FROM mapping", "sectors", **_MAP))
def event_relevance(spark, sf):
    return rounded(S.event_relevance(_mapping_events(spark, sf), _sector(spark, sf)))


_OBS = "SELECT l_partkey AS event_id, l_shipdate AS observed, max(l_discount) * 10 AS probability FROM lineitem GROUP BY 1, 2"
_GRID = "SELECT sector, ts FROM (SELECT DISTINCT sector FROM sec) CROSS JOIN (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts FROM lineitem)"
_BY_SECTOR = {k: (v.replace("SELECT symbol, event_id", "SELECT sector, event_id").replace("CROSS JOIN sec", "CROSS JOIN (SELECT DISTINCT sector FROM sec)") if k == "mapping" else v) for k, v in _MAP.items()}


@R.query(with_(
    "SELECT symbol, category, ts, round(a / greatest(b, 1e-9), 9) AS probability FROM sec JOIN (SELECT g.sector, m.category, g.ts, sum(probability * relevance) AS a, sum(relevance) AS b "
    "FROM grid g JOIN mapping m USING (sector) ASOF JOIN obs o ON m.event_id = o.event_id AND g.ts >= o.observed GROUP BY 1, 2, 3) USING (sector)",
    "sectors", **_BY_SECTOR, obs=_OBS, grid=_GRID,
))
def event_prob_asof(spark, sf):
    """Each month's probability of each category of events for each symbol. An event concerns all symbols of a sector alike, and its relevance
    is its category's, so that events are summed once a category, and weighed once a sector."""
    li = tables.table(spark, sf, "lineitem")
    obs = li.select(F.col("l_partkey").alias("event_id"), F.col("l_shipdate").alias("observed"), (F.col("l_discount") * 10).alias("probability"))
    months = li.select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
    sums = A.observed_sums(_mapping_events(spark, sf), obs, months)
    weighed = sums.join(F.broadcast(S.sector_relevance(spark, _sector(spark, sf))), "category").select("sector", "category", "ts", (F.col("total") * F.col("relevance") / F.greatest(F.col("n") * F.col("relevance"), F.lit(1e-9))).alias("probability"))
    return rounded(_sector(spark, sf).join(F.broadcast(weighed), "sector").select("symbol", "category", "ts", "probability"), 9)


def _second_source(spark, sf):
    li = tables.table(spark, sf, "lineitem").where("l_partkey % 17 <> 0")
    return li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(F.expr("(min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2").alias("close"))


_SECOND = "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS close FROM lineitem WHERE l_partkey % 17 <> 0 GROUP BY 1, 2"
_RECON = "SELECT symbol, ts, p.close AS primary_close, s.close AS secondary_close, CASE WHEN p.close = 0 THEN 'infinity'::DOUBLE ELSE abs(s.close - p.close) / abs(p.close) END AS difference FROM bars p FULL JOIN second s USING (symbol, ts)"
_STATUS = "SELECT *, CASE WHEN primary_close IS NULL THEN 'PRIMARY_MISSING' WHEN secondary_close IS NULL THEN 'SECONDARY_MISSING' WHEN difference <= 0.005 THEN 'VALIDATED' WHEN difference <= 0.02 THEN 'MINOR_DIFFERENCE' ELSE 'MAJOR_DIFFERENCE' END AS status, coalesce(primary_close, secondary_close) AS canonical_close FROM recon"


@R.query(with_(f"SELECT symbol, ts, status, primary_close, secondary_close, {r('difference', digits=9)}, canonical_close FROM st", "bars", second=_SECOND, recon=_RECON, st=_STATUS))
def price_reconciliation(spark, sf):
    return A.reconcile(tables.bars(spark, sf), _second_source(spark, sf), ["symbol", "ts"]).withColumn("difference", F.round("difference", 9))


@R.query(with_("SELECT symbol, ts, canonical_close FROM st WHERE status <> 'MAJOR_DIFFERENCE'", "bars", second=_SECOND, recon=_RECON, st=_STATUS))
def tradable_bars(spark, sf):
    return A.tradable(A.reconcile(tables.bars(spark, sf), _second_source(spark, sf), ["symbol", "ts"])).select("symbol", "ts", "canonical_close")


#: Quarterly facts with the columns that scores want; deterministic ratios of what the facts hold.
_FUND_COLS = {
    "debt": "cost", "cash": "net / 10", "gross_margin": "net / nullif(revenue, 0)", "operating_margin": "(net - cost) / nullif(revenue, 0)", "fcf_margin": "(net - 2 * cost) / nullif(revenue, 0)", "roic": "(net - cost) / nullif(revenue + cost, 0)",
    "pe_ratio": "revenue / nullif(units, 0) / 100", "ev_to_ebitda": "revenue / nullif(net - cost, 0)", "price_to_book": "revenue / nullif(net, 0)", "price_to_sales": "units / nullif(revenue, 0)",
    "revenue_growth": "revenue / nullif(lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY published), 0) - 1", "eps_growth": "net / nullif(lag(net, 4) OVER (PARTITION BY symbol ORDER BY published), 0) - 1",
}


def _funds(spark, sf):
    f = tables.facts(spark, sf).selectExpr("symbol", "published AS ts", *[f"{x} AS {k}" for k, x in _FUND_COLS.items()])
    return X.fundamental_zscores(rounded(f, 9))


def _z(x: str) -> str:
    return f"CASE WHEN coalesce(stddev_pop({x}) OVER (PARTITION BY ts), 0) = 0 THEN 0 ELSE ({x} - avg({x}) OVER (PARTITION BY ts)) / stddev_pop({x}) OVER (PARTITION BY ts) END"


_mean = lambda xs: "(" + " + ".join(f"coalesce(z_{x}, 0)" for x in xs) + ") / nullif(" + " + ".join(f"CASE WHEN z_{x} IS NULL THEN 0 ELSE 1 END" for x in xs) + ", 0)"
FUNDS = {
    "fq": "SELECT symbol, published AS ts, " + ", ".join(f"round({x}, 9) AS {k}" for k, x in _FUND_COLS.items()) + " FROM facts",
    "fz": "SELECT *, debt / nullif(cash, 0) AS debt_to_cash, " + ", ".join(f"{_z(x)} AS z_{x}" for x in X.VALUATION + X.PROFITABILITY + X.GROWTH) + " FROM fq",
    "funds": f"SELECT *, -({_mean(X.VALUATION)}) AS valuation_zscore, {_mean(X.PROFITABILITY)} AS profitability_zscore, {_mean(X.GROWTH)} AS growth_zscore FROM fz",
}


@R.query(with_(f"SELECT symbol, ts, {r('debt_to_cash', 'valuation_zscore', 'profitability_zscore', 'growth_zscore')} FROM funds", "facts", **FUNDS))
def fundamental_zscores(spark, sf):
    return rounded(_funds(spark, sf).select("symbol", "ts", "debt_to_cash", "valuation_zscore", "profitability_zscore", "growth_zscore"))


_cl = lambda x, a, b: f"greatest({a}, least({b}, {x}))"
_th = lambda x: f"coalesce(tanh({x}), 0)"
TECH_SCORES = {
    "t1": f"SELECT *, {_th('8 * (0.5 * dist_sma_20 + 0.3 * dist_sma_50 + 0.2 * dist_sma_200)')} AS technical_trend_score, {_cl('0.4 * coalesce((rsi_14 - 50) / 50, 0) + 0.3 * ' + _th('4 * (macd - macd_signal)') + ' + 0.3 * ' + _th('4 * return_20d'), -1, 1)} AS technical_momentum_score, {_cl('realised_vol_20d / 0.6', 0, 1)} AS technical_volatility_risk FROM panel",
    "tech": f"SELECT *, {_cl(_th('2 * (coalesce(nullif(relative_volume_20d, 0), 1) - 1)') + ' * CASE WHEN technical_trend_score >= 0 THEN 1 ELSE -1 END', -1, 1)} AS technical_volume_confirmation, {_cl('0.3 + 0.4 * (' + ' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in ('dist_sma_20', 'dist_sma_50', 'rsi_14', 'macd', 'realised_vol_20d', 'relative_volume_20d')) + ') / 6 + 0.3 * (1 - abs(technical_trend_score - technical_momentum_score) / 2)', 0, 1)} AS technical_confidence FROM t1",
}
_T = ["technical_trend_score", "technical_momentum_score", "technical_volatility_risk", "technical_volume_confirmation", "technical_confidence"]


@R.query(with_(f"SELECT symbol, ts, {r(*_T)} FROM tech", "bars", **M.PANEL, **TECH_SCORES))
def technical_scores(spark, sf):
    return rounded(S.technical_scores(M.panel(spark, sf)).select("symbol", "ts", *_T))


_F = ["growth", "profitability", "valuation", "balance_sheet", "earnings_quality", "guidance"]
FUND_SCORES = {"fs": f"SELECT *, {_th('0.7 * growth_zscore')} AS fundamental_growth_score, {_th('0.7 * profitability_zscore')} AS fundamental_profitability_score, {_th('0.7 * valuation_zscore')} AS fundamental_valuation_score, {_th('-(coalesce(nullif(debt_to_cash, 0), 1) - 1)')} AS fundamental_balance_sheet_score, CASE WHEN fcf_margin IS NULL OR operating_margin IS NULL THEN 0 ELSE {_cl('1 - 4 * abs(operating_margin - fcf_margin)', -1, 1)} END AS fundamental_earnings_quality_score, CASE WHEN eps_growth IS NULL OR revenue_growth IS NULL THEN 0 ELSE {_cl('tanh(least(eps_growth, revenue_growth)) - ' + _cl('abs(eps_growth - revenue_growth)', 0, 1), -1, 1)} END AS fundamental_guidance_score, {_cl('0.3 + 0.7 * (' + ' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in ('revenue_growth', 'eps_growth', 'gross_margin', 'operating_margin', 'fcf_margin', 'roic')) + ') / 6', 0, 1)} AS fundamental_confidence FROM funds"}
_FS = [f"fundamental_{x}_score" for x in _F] + ["fundamental_confidence"]


@R.query(with_(f"SELECT symbol, ts, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _FS)} FROM fs", "facts", **FUNDS, **FUND_SCORES))
def fundamental_scores(spark, sf):
    got = S.fundamental_scores(_funds(spark, sf))
    return rounded(got.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in _FS]))


#: Z-scores of four series a month over their last 36 months, beside the month's breadth of orders.
_MACRO_Z = "SELECT period AS ts, series, (value - avg(value) {w}) / nullif(stddev_pop(value) {w}, 0) AS z FROM {t}"
_W36 = "OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"
_SERIES = {"vol_z": "1-URGENT", "growth_z": "2-HIGH", "inflation_z": "3-MEDIUM", "rates_z": "5-LOW"}


def _market(spark, sf):
    m = tables.macro(spark, sf)
    first = m.groupBy("series", "period").agg(F.min_by("value", "published").alias("value"))
    z = first.select(F.col("period").alias("ts"), "series", F.expr(f"round((value - avg(value) {_W36}) / nullif(stddev_pop(value) {_W36}, 0), 9)").alias("z"))
    return z.groupBy("ts").agg(*[F.max(F.when(F.col("series") == s, F.col("z"))).alias(k) for k, s in _SERIES.items()], F.avg(F.expr("CASE WHEN z > 0 THEN 1.0D ELSE 0.0D END")).alias("breadth_ratio"))


MARKET = {
    "mz": f"SELECT period AS ts, series, round((value - avg(value) {_W36}) / nullif(stddev_pop(value) {_W36}, 0), 9) AS z FROM macro1",
    "mk": "SELECT ts, " + ", ".join(f"max(CASE WHEN series = '{s}' THEN z END) AS {k}" for k, s in _SERIES.items()) + ", avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END) AS breadth_ratio FROM mz GROUP BY ts",
    "ms": "SELECT ts, tanh(0.5 * coalesce(growth_z, 0) - 0.5 * coalesce(vol_z, 0)) AS macro_risk_appetite_score, tanh(-0.6 * coalesce(rates_z, 0) - 0.2 * coalesce(vol_z, 0)) AS macro_liquidity_score, greatest(-1, least(1, (breadth_ratio - 0.5) * 2)) AS macro_market_breadth_score, 0.25 + 0.75 * (CASE WHEN vol_z IS NULL THEN 0 ELSE 1 END + CASE WHEN growth_z IS NULL THEN 0 ELSE 1 END + CASE WHEN inflation_z IS NULL THEN 0 ELSE 1 END + CASE WHEN rates_z IS NULL THEN 0 ELSE 1 END) / 4 AS macro_confidence, CASE WHEN coalesce(vol_z, 0) >= 2 THEN 'CRISIS' WHEN coalesce(vol_z, 0) >= 1 THEN 'ELEVATED' WHEN coalesce(vol_z, 0) <= -1 THEN 'LOW' ELSE 'NORMAL' END AS volatility_regime, CASE WHEN coalesce(growth_z, 0) >= 1.5 THEN 'OVERHEATING' WHEN coalesce(growth_z, 0) >= 0 THEN 'EXPANSION' WHEN coalesce(growth_z, 0) >= -1.5 THEN 'SLOWDOWN' ELSE 'CONTRACTION' END AS growth_regime, CASE WHEN coalesce(inflation_z, 0) >= 1.5 THEN 'HIGH' WHEN coalesce(inflation_z, 0) >= 0 THEN 'MODERATE' WHEN coalesce(inflation_z, 0) >= -1.5 THEN 'LOW' ELSE 'DEFLATIONARY' END AS inflation_regime, CASE WHEN coalesce(rates_z, 0) >= 0.5 THEN 'TIGHTENING' WHEN coalesce(rates_z, 0) <= -0.5 THEN 'EASING' ELSE 'NEUTRAL' END AS policy_regime FROM mk",
}
_REG = ["volatility_regime", "growth_regime", "inflation_regime", "policy_regime"]
_MS = ["macro_risk_appetite_score", "macro_liquidity_score", "macro_market_breadth_score", "macro_confidence"]


@R.query(with_(f"SELECT ts, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _MS)}, {', '.join(_REG)} FROM ms", "macro", **MARKET))
def market_regime(spark, sf):
    got = S.market_scores(_market(spark, sf))
    return rounded(got.select("ts", *[F.col(c).cast("double").alias(c) for c in _MS], *_REG))


EVENTS = {
    "nr": "SELECT symbol, ts, avg(CAST(CASE category WHEN 'earnings' THEN 0.1 WHEN 'guidance' THEN 0.05 ELSE 0.0 END AS DOUBLE)) AS s, bool_or(category = 'earnings') AS e, count(*) AS n FROM pairs GROUP BY symbol, ts",
    "es": "SELECT symbol, ts, s, least(1.0, n / 100.0) AS u, e, coalesce(tanh(n / 50.0), 0) AS em FROM nr",
}
_E = ["event_earnings_score", "event_macro_score", "event_confidence", "event_sentiment", "event_direction"]


@R.query(with_(f"SELECT symbol, ts, round(greatest(-1, least(1, greatest(-1, least(1, s)) * CASE WHEN e THEN 1.5 ELSE 0 END)), 10) AS event_earnings_score, round(em, 10) AS event_macro_score, round(CAST(1 - u AS DOUBLE), 10) AS event_confidence, round(greatest(-1, least(1, 0.7 * s + 0.3 * em)), 10) AS event_sentiment, round(greatest(-1, least(1, greatest(-1, least(1, 0.7 * s + 0.3 * em)) * (1 - 0.5 * u))), 10) AS event_direction FROM es", "articles", points=_POINTS, pairs=_PAIRS, **EVENTS))
def event_scores(spark, sf):
    n = _news(spark, sf)
    n = n.selectExpr("symbol", "ts", "news_sentiment", "is_earnings_event", "least(1.0D, n / 100.0D) AS event_uncertainty", "n / 50.0D AS macro_surprise")
    return rounded(S.event_scores(n).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in _E]), 10)


_SC = ["technical_trend_score", "fund_mean", "macro_risk_appetite_score"]
_CO = ["technical_confidence", "fundamental_confidence", "macro_confidence"]
ORCH = {
    "fm": "SELECT symbol AS s2, ts AS t2, (" + " + ".join(_FS[:-1]) + ") / 6 AS fund_mean, fundamental_confidence FROM fs",
    "oj": "SELECT t.symbol, t.ts, technical_trend_score, technical_confidence, coalesce(fund_mean, 0) AS fund_mean, coalesce(fundamental_confidence, 0.3) AS fundamental_confidence FROM tech t ASOF LEFT JOIN fm ON t.symbol = fm.s2 AND t.ts >= fm.t2",
    "ok": "SELECT o.*, coalesce(macro_risk_appetite_score, 0) AS macro_risk_appetite_score, coalesce(macro_confidence, 0.25) AS macro_confidence FROM oj o ASOF LEFT JOIN ms ON o.ts >= ms.ts",
    "oc": "SELECT symbol, ts, (" + " + ".join(_SC) + ") / 3.0 AS m, (" + " + ".join(_CO) + ") / 3.0 AS c, " + ", ".join(_SC) + " FROM ok",
}
_dis = "sqrt((" + " + ".join(f"pow({s} - m, 2)" for s in _SC) + ") / 3.0)"


@R.query(with_(f"SELECT symbol, ts, round(m, 4) AS agent_composite_score, round(c, 4) AS agent_mean_confidence, round({_dis}, 4) AS agent_disagreement, round(greatest(0.0, c * (1 - {_dis})), 4) AS agent_composite_confidence FROM oc", "bars", "facts", "macro", **M.PANEL, **TECH_SCORES, **FUNDS, **FUND_SCORES, **MARKET, **ORCH))
def orchestrated(spark, sf):
    """Technical, fundamental and market views of every bar, each as known then, combined."""
    t = S.technical_scores(M.panel(spark, sf)).select("symbol", "ts", "technical_trend_score", "technical_confidence")
    f = S.fundamental_scores(_funds(spark, sf)).selectExpr("symbol", "ts AS at", "(" + " + ".join(_FS[:-1]) + ") / 6 AS fund_mean", "CAST(fundamental_confidence AS DOUBLE) AS fundamental_confidence")
    m = S.market_scores(_market(spark, sf)).selectExpr("ts AS at", "CAST(macro_risk_appetite_score AS DOUBLE) AS appetite", "CAST(macro_confidence AS DOUBLE) AS confidence")
    both = A.asof_join(t, f, ["symbol"], "ts", "at", {"fund_mean": "fund_mean", "fundamental_confidence": "fundamental_confidence"})
    # The series have a row a month: they meet the distinct dates, and the dates meet the bars.
    dates = A.asof_join(t.select("ts").distinct().withColumn("one", F.lit(1)), m.withColumn("one", F.lit(1)), ["one"], "ts", "at", {"appetite": "macro_risk_appetite_score", "confidence": "macro_confidence"}).drop("one")
    got = both.join(dates, "ts").selectExpr("symbol", "ts", "technical_trend_score", "CAST(technical_confidence AS DOUBLE) AS technical_confidence", "coalesce(fund_mean, 0) AS fund_mean", "coalesce(fundamental_confidence, 0.3D) AS fundamental_confidence", "coalesce(macro_risk_appetite_score, 0) AS macro_risk_appetite_score", "coalesce(macro_confidence, 0.25D) AS macro_confidence")
    return rounded(S.combined(got, _SC, _CO).select("symbol", "ts", "agent_composite_score", "agent_mean_confidence", "agent_disagreement", "agent_composite_confidence"), 4)


@R.query(with_("SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS day FROM (SELECT DISTINCT ts FROM bars)", "bars"))
def trading_calendar(spark, sf):
    return calendar(tables.bars(spark, sf))
