"""Ingest programs, feeds, views, the catalogue, promotion cycles, the store's versions, the synthetic market."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, ingest, models, monitoring, store, views
from tidemark.sources import catalogue, feeds, synthetic


def test_feeds_with_missing_dates_and_fields(spark):
    raw = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    a = feeds.article_list(raw({"articles": [{"title": "x", "seendate": "20240102T030405Z", "domain": "d", "url": "u"}, {"url": None}, {"seendate": "never", "url": "v"}]})).collect()
    assert [(r.headline, r.published, r.uncertain, r.dedupe_key) for r in a] == [("x", datetime(2024, 1, 2, 3, 4, 5), False, "gdelt::u"), ("", None, True, "gdelt::None"), ("", None, True, "gdelt::v")]
    b = feeds.article_search(raw({"articles": [{"title": "x", "publishedAt": "2024-01-02T03:04:05Z", "source": {"name": "n"}, "url": "u"}, {"title": "y", "source": None, "url": "w"}]})).collect()
    assert [(r.published, r.publisher, r.uncertain) for r in b] == [(datetime(2024, 1, 2, 3, 4, 5), "n", False), (None, None, True)]
    assert feeds.article_list(raw({})).count() == 0
    t = feeds.table_rows(raw({"BEAAPI": {"Results": {"Data": [{"LineDescription": "GDP", "TimePeriod": "2024Q1", "DataValue": "1,234.5"}, {"LineDescription": "GDP", "TimePeriod": "2024Q2", "DataValue": "(NA)"}]}}}).withColumn("table", F.lit("T1"))).collect()
    assert [(r.period, r.value) for r in t] == [("2024Q1", 1234.5), ("2024Q2", None)]


def test_news_is_stored_once_however_often_it_comes(spark, tmp_path):
    articles = spark.createDataFrame([("a", "h1", datetime(2024, 1, 2)), ("a", "h0", datetime(2024, 1, 1)), ("b", "h", None), ("k", "known", datetime(2024, 1, 1))], "dedupe_key string, headline string, published timestamp_ntz")
    known = spark.createDataFrame([("k",)], "dedupe_key string")
    table, log = store.Table(spark, f"file://{tmp_path}/news", ["dedupe_key"]), store.Table(spark, f"file://{tmp_path}/log", [])
    for _ in range(2):
        ingest.save(ingest.news(articles, known, "gdelt"), table, log)
    assert sorted((r.dedupe_key, r.headline) for r in table.read().collect()) == [("a", "h0"), ("b", "h")]
    assert [(r.status, r.records) for r in log.read().collect()] == [("SUCCESS", 2)] * 2


def test_runs_of_prices_tell_failed_partial_and_empty_symbols(spark):
    bar = {"chart": {"result": [{"timestamp": [1704153600], "indicators": {"quote": [{"open": [1.0], "high": [2.0], "low": [1.0], "close": [1.5], "volume": [7]}]}}]}}
    other = {"data": [{"t": "2024-01-02", "o": 1.0, "h": 2.0, "l": 1.0, "c": 1.5, "v": 7}]}
    symbols = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "symbol string")
    one = spark.createDataFrame([("a", json.dumps(bar), None), ("b", json.dumps(bar), None), ("c", None, "timeout")], "symbol string, payload string, error string")
    two = spark.createDataFrame([("a", json.dumps(other), None), ("c", None, "gone")], "symbol string, payload string, error string")
    got = ingest.prices(symbols, one, two)
    assert {r.item: (r.status, r.records, r.error) for r in got.runs.collect()} == {"a": ("SUCCESS", 1, None), "b": ("PARTIAL", 1, None), "c": ("FAILED", 0, "primary=timeout; secondary=gone"), "d": ("FAILED", 0, "primary=None; secondary=None")}
    assert sorted((r.symbol, r.close, r.volume) for r in got.rows.collect()) == [("a", 1.5, 7), ("b", 1.5, 7)]


def test_store_appends_parts_and_sees_another_writers_version(spark, tmp_path):
    t, u = (store.Table(spark, f"file://{tmp_path}/t", ["k"]) for _ in range(2))
    df = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    t.append(df((1, "a")))
    first = t._current()[1]
    u.append(df((2, "b")))
    assert t._current()[1][:1] == first and t.read().count() == 2
    real, calls = t._current, []

    def stale():  # the first look comes before another writer's version
        calls.append(1)
        return (1, first) if len(calls) == 1 else real()

    t._current = stale
    t.append(df((3, "c")))
    t._current = real
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3] and len(calls) == 2
    t.upsert(df((2, "B"), (4, "d")))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and len(t._current()[1]) == 1
    with pytest.raises(store.DuplicateKey):
        t.insert_once(df((4, "again")))
    t.append(spark.createDataFrame([(5, 1.5)], "k int, w double"))
    assert t.read().where("k = 5 AND v IS NULL AND w = 1.5").count() == 1


def test_views_filter_order_and_refuse_what_they_do_not_have(spark):
    df = spark.createDataFrame([(i, "REJECTED" if i % 2 else "APPROVED", f"s{i % 3}") for i in range(20)], "ts int, status string, symbol string")
    assert [r.ts for r in views.read("rejected_orders", df, limit=3).collect()] == [19, 17, 15]
    assert [r.ts for r in views.read("risk_decisions", df, until=10, since=8, status=["APPROVED"]).collect()] == [10, 8]
    with pytest.raises(ValueError, match="no filter"):
        views.read("fills", df, symbol="s1")
    with pytest.raises(KeyError):
        views.read("nothing", df)
    assert len(views.VIEWS) == 20


def test_catalogue_and_universe(spark):
    got = {r.source_id: (r.enabled, r.reason) for r in catalogue.catalogue(spark, off={"fred"}).collect()}
    assert got["bea"] == (False, "requires BEA_API_KEY") and got["fred"] == (False, "switched off") and got["gdelt"] == (True, None)
    assert {r.source_id for r in catalogue.enabled(catalogue.catalogue(spark), "MACRO").collect()} == {"fred", "bls", "treasury"}
    s = spark.createDataFrame([("A",), ("A",), ("B",)], "symbol string")
    one, two = (sorted(map(tuple, catalogue.seed(s, "u", "2020-01-01", "B").collect())) for _ in range(2))
    assert one == two and len(one) == 2


def test_promotion_cycle_logs_every_decision(spark):
    good = {"excess_return_20d": {"information_coefficient": 0.05, "sharpe_ratio": 0.6}, "positive_20d": {"brier_score": 0.24}}
    registry = models.register(None, spark, json.dumps(good))
    same, log, ok = models.promotion_cycle(registry, None, "model_v0001", good, 400, 0.01, "2024-01-01")
    assert not ok and log.first().reason.startswith("400 observations") and same.first().role == "CHALLENGER"
    crowned, log, ok = models.promotion_cycle(registry, log, "model_v0001", good, 600, 0.01, "2024-01-02")
    assert ok and crowned.first().role == "CHAMPION"
    with pytest.raises(ValueError, match="not compared with itself"):
        models.promotion_cycle(crowned, log, "model_v0001", good, 600, 0.01, "2024-01-03")
    worse = {"excess_return_20d": {"information_coefficient": 0.01, "sharpe_ratio": 0.6}}
    two = models.register(crowned, spark, json.dumps(worse))
    kept, log, ok = models.promotion_cycle(two, log, "model_v0002", worse, 600, 0.5, "2024-01-04")
    assert not ok and log.count() == 3
    assert {r.model_version: r.role for r in kept.collect()} == {"model_v0001": "CHAMPION", "model_v0002": "CHALLENGER"}
    best = {"excess_return_20d": {"information_coefficient": 0.09, "sharpe_ratio": 0.9}}
    last, log, ok = models.promotion_cycle(kept, log, "model_v0002", best, 600, 0.5, "2024-01-05")
    assert ok and {r.model_version: r.role for r in last.collect()} == {"model_v0001": "ARCHIVED", "model_v0002": "CHAMPION"}
    assert [r.promoted for r in log.orderBy("decided").collect()] == [False, True, False, True]


def test_challenger_and_noise_control(spark):
    from datetime import timedelta

    rows = [(f"s{i % 5}", datetime(2020, 1, 1) + timedelta(days=i), float((i * 37) % 101), float((i * 53) % 89), ((i * 37) % 101) / 50 - 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, excess_return_5d double")
    heads, registry, version = models.train_challenger(df, ["a", "b"], ["excess_return_5d"], datetime(2021, 1, 1), None, trees=3)
    assert version == "model_v0001" and json.loads(registry.first().metrics_json)["excess_return_5d"]["information_coefficient"] > 0.9
    assert set(heads) == {"excess_return_5d"}
    rank, passed = models.noise_control(df, ["a", "b"], "excess_return_5d", trees=3)
    assert rank in (2, 3) and passed


def test_days_since_and_reports(spark):
    t = lambda d: datetime(2024, 1, d)
    panel = spark.createDataFrame([("a", t(1)), ("a", t(5)), ("b", t(9))], "symbol string, ts timestamp_ntz")
    filed = spark.createDataFrame([("a", t(2)), ("a", t(3))], "symbol string, published timestamp_ntz")
    assert sorted((r.symbol, r.ts.day, r.days_since_filing) for r in ingest.days_since(panel, filed).collect()) == [("a", 1, None), ("a", 5, 2), ("b", 9, None)]
    v = panel.selectExpr("symbol", "ts", "1.0D AS own", "2.0D AS every", "0.5D AS c")
    got = ingest.reports(v.union(v), {"technical": (["own"], "c"), "market": (["every"], "c")})
    assert got.count() == 6 and got.where("symbol = '_MARKET_'").count() == 3
    assert monitoring.engaged_by(panel.selectExpr("symbol", "ts", "ts > TIMESTAMP_NTZ '2024-01-03' AS engaged"), "symbol").where("engaged").count() == 2
    assert asof.tradable(spark.createDataFrame([("VALIDATED",), ("MAJOR_DIFFERENCE",)], "status string")).count() == 1


def test_synthetic_relations_are_the_same_for_any_number_of_tasks(spark):
    of = (4, "2020-01-02", 300)
    rows = lambda f: sorted(map(str, f(spark, *of).collect()))
    for f in (synthetic.synthetic_bars, synthetic.synthetic_filings, synthetic.synthetic_news):
        assert rows(f) == rows(f)
    news = synthetic.synthetic_news(spark, *of)
    filings = synthetic.synthetic_filings(spark, *of)
    assert news.where("is_earnings_event").groupBy("symbol").count().where("count BETWEEN 3 AND 8").count() == 4
    assert filings.where("abs(free_cash_flow - revenue * fcf_margin) > 1e-6").count() == 0
    assert synthetic.synthetic_macro(spark, *of[1:]).select("series").distinct().count() == 4
    assert synthetic.synthetic_regimes(spark, *of[1:]).count() == 300


def test_families_by_column_and_by_name_are_the_same(spark):
    names = ["news_x", "news_x_percentile", "rsi_14", "a_regime_code", "dollar_volume", "thing", "agent_percentile", "return_20d"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.f for r in df.select("n", models.families(F.col("n")).alias("f")).collect()} == {n: models.feature_family(n) for n in names}
    assert models.feature_family("news_x_percentile") == "news"
