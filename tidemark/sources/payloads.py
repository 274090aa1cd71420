"""Parsers of providers' payloads: a DataFrame of raw texts in, typed rows out. Fetching is the caller's; nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scores import keyword_category

CHART = "chart struct<result: array<struct<timestamp: array<bigint>, events: struct<dividends: map<string, struct<date: bigint, amount: double>>, splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
_day = "CAST(date_trunc('DAY', timestamp_seconds({})) AS TIMESTAMP_NTZ)"


def chart_bars(raw: DataFrame) -> DataFrame:
    """Daily bars of chart payloads (symbol, payload). Bars without a price are left out; no volume is 0; the adjusted close
    falls back on the close."""
    r = raw.select("symbol", F.from_json("payload", CHART).alias("p")).select("symbol", F.explode("p.chart.result").alias("r"))
    q = r.select("symbol", F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0].alias("q"), F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"].alias("adj"))
    x = q.select("symbol", "adj", F.posexplode(F.arrays_zip(F.col("t").alias("t"), F.col("q.open").alias("open"), F.col("q.high").alias("high"), F.col("q.low").alias("low"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"))).alias("i", "x"))
    got = x.selectExpr("symbol", f"{_day.format('x.t')} AS ts", "x.open", "x.high", "x.low", "x.close", "coalesce(get(adj, i), x.close) AS adjusted_close", "coalesce(x.volume, 0) AS volume")
    return got.dropna(subset=["open", "high", "low", "close"])


def chart_actions(raw: DataFrame) -> DataFrame:
    """symbol, ts, action, value: cash dividends, and splits (REVERSE_SPLIT below 1; no denominator is 1)."""
    r = raw.select("symbol", F.from_json("payload", CHART).alias("p")).select("symbol", F.explode("p.chart.result").alias("r"))
    d = r.select("symbol", F.explode(F.map_values("r.events.dividends")).alias("x")).selectExpr("symbol", f"{_day.format('x.date')} AS ts", "'DIVIDEND' AS action", "x.amount AS value")
    s = r.select("symbol", F.explode(F.map_values("r.events.splits")).alias("x")).selectExpr("symbol", f"{_day.format('x.date')} AS ts", "x.numerator / coalesce(nullif(x.denominator, 0), 1) AS value")
    return d.unionByName(s.selectExpr("symbol", "ts", "CASE WHEN value >= 1 THEN 'SPLIT' ELSE 'REVERSE_SPLIT' END AS action", "value"))


def history_bars(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars of history payloads: {"data": [{t, o, h, l, c, a, v}]}, between two dates, both included."""
    x = raw.select("symbol", F.explode(F.from_json("payload", "data array<struct<t: string, o: double, h: double, l: double, c: double, a: double, v: bigint>>")["data"]).alias("x"))
    got = x.selectExpr("symbol", "to_timestamp_ntz(x.t, 'yyyy-MM-dd') AS ts", "x.o AS open", "x.h AS high", "x.l AS low", "x.c AS close", "coalesce(x.a, x.c) AS adjusted_close", "coalesce(x.v, 0) AS volume")
    return got.where((F.lit(start).isNull() | (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))) & (F.lit(end).isNull() | (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))))


def series_csv(raw: DataFrame, lags: dict[str, int] | None = None, lag: int = 7) -> DataFrame:
    """Observations of CSV payloads (series, payload: a header, then date,value): '.' and blanks are left out; published a typical lag later."""
    days = F.coalesce(F.create_map(*[F.lit(x) for kv in (lags or {"": lag}).items() for x in kv])[F.col("series")], F.lit(lag))
    rows = raw.select("series", F.explode(F.slice(F.split("payload", "\r?\n"), 2, 2**30)).alias("line")).select("series", F.split("line", ",").alias("x"))
    got = rows.selectExpr("series", "to_timestamp_ntz(trim(get(x, 0)), 'yyyy-MM-dd') AS period", "try_cast(trim(get(x, 1)) AS DOUBLE) AS value").where("value IS NOT NULL AND NOT isnan(value)")
    return got.select("series", "period", (F.col("period") + F.make_dt_interval(days)).alias("published"), "value")


def monthly_json(raw: DataFrame, lags: dict[str, int] | None = None, lag: int = 15) -> DataFrame:
    """Observations of {"Results": {"series": [{seriesID, data: [{year, period: M01..M12, value}]}]}}: values that are no finite number are
    left out; the period is its month's end."""
    x = raw.select(F.explode(F.from_json("payload", "Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>")["Results"]["series"]).alias("s")).select(F.col("s.seriesID").alias("series"), F.explode("s.data").alias("x"))
    got = x.where(F.col("x.period").rlike("^M(0[1-9]|1[0-2])$")).selectExpr("series", "CAST(last_day(make_date(CAST(x.year AS INT), CAST(substr(x.period, 2) AS INT), 1)) AS TIMESTAMP_NTZ) AS period", "try_cast(trim(x.value) AS DOUBLE) AS value")
    days = F.coalesce(F.create_map(*[F.lit(v) for kv in (lags or {"": lag}).items() for v in kv])[F.col("series")], F.lit(lag))
    return got.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')").select("series", "period", (F.col("period") + F.make_dt_interval(days)).alias("published"), "value")


def records_json(raw: DataFrame, date: str, value: str, lag: int = 20) -> DataFrame:
    """Observations of {"data": [{<date>, <value>}]}."""
    x = raw.select("series", F.explode(F.from_json("payload", "data array<map<string, string>>")["data"]).alias("x"))
    got = x.select("series", F.to_timestamp_ntz(F.col("x")[date], F.lit("yyyy-MM-dd")).alias("period"), F.expr(f"try_cast(x['{value}'] AS DOUBLE)").alias("value")).where("value IS NOT NULL")
    return got.select("series", "period", (F.col("period") + F.expr(f"INTERVAL {lag} DAYS")).alias("published"), "value")


#: The tags of each concept, in order of preference.
CONCEPTS = {"revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"], "eps_diluted": ["EarningsPerShareDiluted"], "gross_profit": ["GrossProfit"], "operating_income": ["OperatingIncomeLoss"], "net_income": ["NetIncomeLoss"], "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"], "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"], "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt"], "cash": ["CashAndCashEquivalentsAtCarryingValue"], "stockholders_equity": ["StockholdersEquity"], "shares_outstanding": ["CommonStockSharesOutstanding"]}
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A"]


def filing_facts(raw: DataFrame) -> DataFrame:
    """Facts of company payloads (symbol, payload): of each concept the first tag that has data, periodic forms only."""
    unit = "array<struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>"
    j = raw.select("symbol", F.from_json("payload", f"facts map<string, map<string, struct<units: map<string, {unit}>>>>")["facts"].alias("f"))
    tags = j.select("symbol", F.explode("f").alias("space", "t")).select("symbol", F.explode("t").alias("source_tag", "v")).select("symbol", "source_tag", F.explode("v.units").alias("unit", "x")).select("symbol", "source_tag", "unit", F.explode("x").alias("x"))
    order = raw.sparkSession.createDataFrame([(t, c, i) for c, ts in CONCEPTS.items() for i, t in enumerate(ts)], "source_tag string, tag string, place int")
    rows = tags.join(F.broadcast(order), "source_tag").where(F.col("x.form").isin(FORMS))
    best = rows.groupBy("symbol", "tag").agg(F.min("place").alias("place"))
    rows = rows.join(best, ["symbol", "tag", "place"])
    return rows.selectExpr("symbol", "tag", "unit", "to_timestamp_ntz(x.start, 'yyyy-MM-dd') AS period_start", "to_timestamp_ntz(x.end, 'yyyy-MM-dd') AS period_end", "x.val AS value", "x.accn AS accession_number", "x.form AS form_type", "x.fy AS fiscal_year", "x.fp AS fiscal_period", "to_timestamp_ntz(x.filed, 'yyyy-MM-dd') AS filed_date")


def market_events(raw: DataFrame) -> DataFrame:
    """Probabilities of event payloads (observed, payload: [{title, markets: [...]}]): markets whose first outcome is yes, the category from keywords."""
    m = "array<struct<title: string, markets: array<struct<id: string, question: string, outcomes: string, outcomePrices: string, liquidityNum: double, volumeNum: double, volume24hr: double, endDateIso: string>>>>"
    x = raw.select("observed", F.explode(F.from_json("payload", m)).alias("e")).select("observed", F.col("e.title").alias("t"), F.explode("e.markets").alias("m"))
    x = x.select("observed", F.col("m.id").alias("event_id"), F.coalesce(F.expr("nullif(m.question, '')"), "t").alias("question"), F.from_json("m.outcomes", "array<string>").alias("o"), F.from_json("m.outcomePrices", "array<string>").alias("p"), F.expr("coalesce(m.liquidityNum, 0)").alias("liquidity"), F.expr("coalesce(m.volumeNum, 0)").alias("volume"), F.expr("coalesce(m.volume24hr, 0)").alias("volume_24hr"), F.expr("try_cast(m.endDateIso AS TIMESTAMP_NTZ)").alias("resolution"))
    got = x.where("lower(trim(get(o, 0))) = 'yes' AND get(p, 0) IS NOT NULL")
    return got.selectExpr("event_id", "question", f"{keyword_category('question')} AS category", "observed", "resolution", "greatest(0.0D, least(1.0D, CAST(get(p, 0) AS DOUBLE))) AS probability", "liquidity", "volume", "volume_24hr")


#: Categories of the item codes of current reports.
ITEMS = {"1.01": "M&A", "2.01": "M&A", "2.02": "earnings", "3.01": "regulation", "4.02": "regulation", "5.02": "management", "7.01": "guidance", "8.01": "other"}


def filing_events(filings: DataFrame) -> DataFrame:
    """Articles of current reports (symbol, items: codes with commas, accepted, filed): the category is the first, in order of the alphabet,
    of its items'; without an acceptance time the filing date stands in and is uncertain."""
    code = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    cats = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("items", ","), lambda x: code[F.trim(x)]), lambda x: x.isNotNull())))
    return filings.select("symbol", F.coalesce(F.get(cats, F.lit(0)), F.lit("other")).alias("category"), F.coalesce("accepted", "filed").alias("published"), F.col("accepted").isNull().alias("uncertain"))


def feed_items(raw: DataFrame) -> DataFrame:
    """Items of RSS payloads (symbol, payload): headline, url, published."""
    each = raw.select("symbol", F.posexplode(F.arrays_zip(F.expr("xpath(payload, '//item/title/text()')").alias("headline"), F.expr("xpath(payload, '//item/link/text()')").alias("url"), F.expr("xpath(payload, '//item/pubDate/text()')").alias("date"))).alias("i", "x"))
    return each.select("symbol", F.col("x.headline").alias("headline"), F.col("x.url").alias("url"), F.expr("try_to_timestamp(substr(x.date, 6, 20), 'dd MMM yyyy HH:mm:ss')").cast("timestamp_ntz").alias("published"), F.concat(F.lit("feed::"), F.col("x.url")).alias("dedupe_key"))
