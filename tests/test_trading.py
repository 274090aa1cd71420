"""Metrics, drift, scores, allocation, the gate, fills, the account, the store, parsers, promotion."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import broker, drift, filings, models, scores, store  # noqa: I001
from tidemark.operators import metrics as M
from tidemark.operators import portfolio as P
from tidemark.sources import payloads

rng = np.random.default_rng(0)


def ts(s):
    return pd.Timestamp(s).to_pydatetime()


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_equity_metrics_equal_pandas(spark):
    e = pd.Series(1e6 * np.exp(np.cumsum(rng.normal(0, 0.01, 300))))
    got = M.equity_metrics(frame(spark, run_id="r", ts=range(300), equity=e)).first()
    r = e.pct_change().dropna()
    assert got.sharpe_ratio == pytest.approx(r.mean() / r.std() * np.sqrt(252)) and got.max_drawdown == pytest.approx((e / e.cummax() - 1).min())
    assert got.sortino_ratio == pytest.approx(r.mean() / r[r < 0].std() * np.sqrt(252)) and got.cagr == pytest.approx((e.iloc[-1] / e[0]) ** (252 / 299) - 1)
    assert M.equity_metrics(frame(spark, run_id=["r"], ts=[1], equity=[5.0])).first().total_return is None
    t = M.trade_metrics(frame(spark, run_id="r", pnl=[2.0, 3.0])).first()
    assert t.profit_factor == float("inf") and t.hit_rate == 1 and t.avg_loss is None


def test_correlations_of_ranks_equal_pandas(spark):
    y, p = rng.integers(0, 40, 500).astype(float), rng.normal(0, 1, 500)
    df = frame(spark, y=y, p=p + y / 20, g=np.arange(500) % 3)
    a, b = pd.Series(y).rank(), pd.Series(p + y / 20).rank()
    assert M.rank_ic(df, "y", "p").first().rank_ic == pytest.approx(a.corr(b))
    for r in M.rank_ic(df, "y", "p", ["g"]).collect():
        k = np.arange(500) % 3 == r.g
        assert r.rank_ic == pytest.approx(pd.Series(y[k]).rank().corr(pd.Series((p + y / 20)[k]).rank()))
    assert M.rank_ic(df.limit(2), "y", "p").first().rank_ic is None
    for limit in (0, 10**6):
        got = {r.y: r.k for r in M.value_ranks(df.select("y"), "y", "k", limit, 8).collect()}
        assert got == dict(zip(y, a, strict=True))


def test_classification_by_hand(spark):
    got = M.classification_eval(frame(spark, y=[0.0, 0.0, 1.0, 1.0], p=[0.1, 0.4, 0.35, 0.8]), "y", "p").first()
    assert got.auc == 0.75 and got.accuracy == 0.75 and got.brier_score == pytest.approx((0.01 + 0.16 + 0.4225 + 0.04) / 4)
    assert M.classification_eval(frame(spark, y=[1.0, 1.0], p=[0.1, 0.4]), "y", "p").first().auc is None


def test_calibration_bins_equal_pandas(spark):
    p = np.round(rng.uniform(0, 1, 400), 2)
    y = (rng.uniform(0, 1, 400) < p).astype(float)
    got = M.calibration_curve(frame(spark, y=y, p=p), "y", "p").orderBy("mean_predicted").toPandas()
    want = pd.DataFrame({"y": y, "p": p, "b": pd.qcut(p, 10, duplicates="drop")}).groupby("b", observed=True).agg(m=("p", "mean"), r=("y", "mean"), n=("y", "size"))
    assert np.allclose(got.mean_predicted, want.m) and np.allclose(got.mean_realised, want.r) and got["count"].tolist() == want.n.tolist()


def test_factor_loadings_equal_least_squares(spark):
    x = rng.normal(0, 1, (300, 2))
    y = x @ [0.5, -0.2] + rng.normal(0, 0.1, 300)
    got = {r.factor: r.loading for r in M.factor_exposure(frame(spark, y=y, a=x[:, 0], b=x[:, 1]), "y", ["a", "b"]).collect()}
    z = lambda v: (v - v.mean(0)) / v.std(0)
    want = np.linalg.lstsq(np.c_[np.ones(300), z(x)], z(y), rcond=None)[0]
    assert got["a"] == pytest.approx(want[1]) and got["b"] == pytest.approx(want[2]) and got["intercept"] == 0


def test_drift_in_blocks_equals_drift_in_one_task(spark, monkeypatch):
    a, b = np.round(rng.normal(0, 1, 3000), 2), np.round(rng.normal(0.2, 1.1, 2000), 2)
    ref, cur = frame(spark, x=a, y=np.abs(a)), frame(spark, x=b, y=np.abs(b))
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    whole = rows(drift.drift_report(ref, cur, ["x", "y"]))
    table = rows(drift.cumulative(drift.steps(ref, cur, ["x", "y"])).select("feature", "x", "r", "c", "cr", "cc", F.coalesce("after", F.lit(-9.0))))
    monkeypatch.setattr(drift, "ONE_TASK", 50)
    assert rows(drift.drift_report(ref, cur, ["x", "y"], rows=900)) == whole
    assert rows(drift.cumulative(drift.steps(ref, cur, ["x", "y"]), 900).select("feature", "x", "r", "c", "cr", "cc", F.coalesce("after", F.lit(-9.0)))) == table


def test_the_book_gives_what_summing_all_positions_gives():
    for k in range(300):
        r = np.random.default_rng(k)
        names = [f"s{i}" for i in range(8)]
        quantity = {s: float(r.normal(0, 100)) for s in names if r.random() < 0.7}
        prices, vols = {s: float(r.uniform(1, 50)) for s in names if r.random() < 0.9}, {s: float(r.uniform(0.1, 0.6)) for s in names if r.random() < 0.6}
        sectors = {s: f"x{int(r.integers(3))}" for s in names if r.random() < 0.8}
        symbol, change = names[int(r.integers(8))], float(r.normal(0, 3000))
        values = {s: q * prices.get(s, 0.0) for s, q in quantity.items()}
        values[symbol] = values.get(symbol, 0.0) + change
        of = lambda s: sectors.get(s, "UNKNOWN")
        want = (abs(values[symbol]), sum(map(abs, values.values())), sum(values.values()), sum(abs(v) for s, v in values.items() if of(s) == of(symbol)), sum(abs(v) * vols.get(s, 0.2) for s, v in values.items()))
        assert broker.Book(quantity, prices, sectors, vols, 0.2).after(symbol, change) == pytest.approx(want, abs=1e-6)


def test_total_losses_end_a_portfolio(spark):
    from tidemark.operators import portfolio

    daily = spark.createDataFrame([(1, 0.5), (2, -1.5), (3, 0.2), (4, -1.0), (5, 0.3)], "ts int, r double")
    got = [(r.equity, r.log_growth) for r in portfolio.compounded(daily, 100.0).orderBy("ts").collect()]
    assert [x for x, _ in got] == pytest.approx([150, -75, -90, 0, 0])
    assert got[2][1] == pytest.approx(np.log(0.9)) and got[4][1] == pytest.approx(np.log(0.9 * 1.3))


def test_drift_statistics(spark):
    a, b = rng.normal(0, 1, 800), rng.normal(1, 1, 700)
    ref, cur = frame(spark, x=a, same=a), frame(spark, x=b, same=a[:700])
    got = {r.feature: r for r in drift.drift_report(ref, cur, ["x", "same"]).collect()}
    edges = np.quantile(a, np.linspace(0, 1, 11))
    p, q = (np.clip(h / h.sum(), 1e-6, None) for h in (np.histogram(a, edges)[0], np.histogram(b, edges)[0]))
    assert got["x"].psi == pytest.approx(np.sum((q - p) * np.log(q / p))) and got["x"].flagged and not got["same"].flagged
    grid = np.sort(np.r_[a, b])
    fa, fb = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    assert got["x"].ks_statistic == pytest.approx(np.abs(fa - fb).max()) and got["x"].wasserstein == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))
    assert drift.performance_drift(0.01, 0.1) and not drift.performance_drift(0.09, 0.1) and drift.performance_drift(-0.1, float("nan"))


def test_scores_follow_the_conventions_for_missing_inputs(spark):
    cols = ["dist_sma_20", "dist_sma_50", "dist_sma_200", "rsi_14", "macd", "macd_signal", "return_20d", "realised_vol_20d", "relative_volume_20d"]
    none = spark.createDataFrame([tuple([None] * 9)], ", ".join(f"{c} double" for c in cols))
    r = scores.technical_scores(none).first()
    assert r.technical_trend_score == 0 and r.technical_volatility_risk == 1 and r.technical_confidence == pytest.approx(0.6)
    f = ["growth_zscore", "profitability_zscore", "valuation_zscore", "debt_to_cash", "fcf_margin", "operating_margin", "eps_growth", "revenue_growth", "gross_margin", "roic"]
    r = scores.fundamental_scores(spark.createDataFrame([(1.0, None, 0.0, 0.0, 0.1, 0.2, 0.3, 0.1, None, None)], ", ".join(f"{c} double" for c in f))).first()
    assert r.fundamental_growth_score == pytest.approx(np.tanh(0.7)) and r.fundamental_balance_sheet_score == 0 and r.fundamental_earnings_quality_score == pytest.approx(0.6)
    assert r.fundamental_guidance_score == pytest.approx(np.tanh(0.1) - 0.2) and r.fundamental_confidence == pytest.approx(0.3 + 0.7 * 4 / 6)
    c = scores.combined(spark.createDataFrame([(1.0, -1.0, 0.5, 0.5)], "a double, b double, c double, d double"), ["a", "b"], ["c", "d"]).first()
    assert c.agent_disagreement == 1 and c.agent_composite_confidence == 0 and c.agent_composite_score == 0


def test_weights_are_clipped_and_scaled(spark):
    rows = [(f"S{i}", 1, 0.05, 0.9, 0.2, 0.9) for i in range(10)] + [("low", 1, 0.05, 0.9, 0.2, 0.01), ("neg", 2, -0.001, 0.9, 0.2, 0.5)]
    got = {r.symbol: r.weight for r in P.target_weights(spark.createDataFrame(rows, "symbol string, ts int, predicted_excess_return_5d double, probability_positive_5d double, predicted_volatility double, confidence double")).collect()}
    assert got["S0"] == pytest.approx(0.05) and "low" not in got
    assert got["neg"] == pytest.approx(-0.001 * 0.5 * 0.4 / (0.2 * np.sqrt(5 / 252)))


def test_gate_reasons(spark):
    day = ts("2024-01-02")
    pos = spark.createDataFrame([("a", "X", 10.0, 100.0, "T", 0.2), ("a", "Y", 300.0, 100.0, "T", 0.2), ("a", "Z", 0.0, None, "U", None), ("a", "V", 0.0, 100.0, "V", 0.2), ("k", "X", 0.0, 100.0, "T", 0.2), ("s", "X", 0.0, 100.0, "T", 0.2), ("d", "X", 0.0, 100.0, "T", 0.2)], "account string, symbol string, quantity double, price double, sector string, volatility double")
    acc = spark.createDataFrame([(x, 100_000.0, 100_000.0, 130_000.0 if x == "d" else 100_000.0, ts("2023-12-01") if x == "s" else day, x == "k") for x in "aksd"], "account string, equity double, peak_equity double, start_equity double, market_ts timestamp_ntz, engaged boolean")
    o = [(1, "a", "X", "BUY", 50.0), (2, "a", "X", "BUY", 50.0), (3, "a", "X", "SELL", 200.0), (4, "a", "Z", "BUY", 1.0), (5, "a", "V", "BUY", 50.0), (6, "k", "X", "BUY", 1.0), (7, "s", "X", "BUY", 1.0), (8, "d", "X", "BUY", 1.0), (9, "a", "Q", "BUY", 1.0)]
    orders = spark.createDataFrame([(*x, day) for x in o], "order_id int, account string, symbol string, side string, quantity double, ts timestamp_ntz")
    got = {r.order_id: r.reason for r in P.risk_gate(orders, pos, acc).collect()}
    assert got == {1: "RISK_SECTOR_CONCENTRATION", 2: "DUPLICATE_ORDER", 3: "RISK_POSITION_LIMIT", 4: "INVALID_PRICE", 5: "OK", 6: "KILL_SWITCH", 7: "STALE_DATA", 8: "RISK_DAILY_LOSS_LIMIT", 9: "INVALID_PRICE"}


def test_fills_by_hand(spark):
    o = [(1, "BUY", 10.0, "MARKET", None, 100.0, 1e6, None), (2, "SELL", 10.0, "LIMIT", 101.0, 100.0, 1e6, None), (3, "BUY", 10.0, "MARKET", None, 100.0, 0.0, None), (4, "BUY", 1000.0, "MARKET", None, 100.0, 100.0, None), (5, "BUY", 10.0, "MARKET", None, 100.0, 1e6, 0.5), (6, "BUY", 10.0, "MARKET", None, 100.0, 1e6, 501.0)]
    got = {r.i: r for r in P.simulate_fills(spark.createDataFrame(o, "i int, side string, quantity double, order_type string, limit_price double, price double, volume double, buying_power double")).collect()}
    assert got[1].fill_price == pytest.approx(100 * (1 + 0.0005 + 0.02 * 1e-5)) and got[1].commission == 1
    assert got[2].rejection == "NOT_MARKETABLE_LIMIT_PRICE" and got[3].rejection == "NO_VOLUME_AVAILABLE" and got[5].rejection == "INSUFFICIENT_BUYING_POWER"
    assert got[4].fill_quantity == 10 and got[4].fill_price == pytest.approx(100 * (1 + 0.0005 + 0.002))
    assert got[6].fill_quantity == pytest.approx(500 / got[6].fill_price)


def test_account_flips_and_keeps_its_books():
    a = broker.Account(1000.0)
    assert a.apply("X", 10, 10.0, 1.0) is None and a.cash == 899 and a.cost["X"] == 10
    assert a.apply("X", 10, 20.0, 0.0) is None and a.cost["X"] == 15
    assert a.apply("X", -30, 25.0, 0.0) == 200 and a.quantity["X"] == -10 and a.cost["X"] == 25
    assert a.apply("X", 10, 20.0, 0.0) == 50 and "X" not in a.quantity
    assert a.realised == 249 and a.equity() == pytest.approx(1249)


def test_backtest_runs_scenarios_apart_and_balances(spark):
    days = [t.to_pydatetime() for t in pd.bdate_range("2024-01-01", periods=30)]
    rows = [(run, d, s, 10.0 + i * g, 10.0 + i * g, 1e6, w, 0.2, s) for run, g in (("up", 0.1), ("flat", 0.0)) for i, d in enumerate(days) for s, w in (("A", 0.05), ("B", -0.02))]
    schema = "run_id string, ts timestamp_ntz, symbol string, open double, close double, volume double, weight double, volatility double, sector string"
    got = broker.backtest(spark.createDataFrame(rows, schema)).orderBy("run_id", "ts").toPandas()
    assert got.groupby("run_id").size().tolist() == [29, 29]
    assert np.allclose(got.equity, got.cash + got.net_exposure)
    assert got[got.run_id == "up"].equity.iloc[-1] > got[got.run_id == "flat"].equity.iloc[-1]
    alone = broker.backtest(spark.createDataFrame([r for r in rows if r[0] == "up"], schema)).orderBy("ts").toPandas()
    assert np.allclose(alone.equity, got[got.run_id == "up"].equity)


def test_benchmark_portfolios(spark):
    days = [t.to_pydatetime() for t in pd.bdate_range("2024-01-01", periods=60)]
    px = {"A": np.linspace(10, 20, 60), "B": np.full(60, 5.0), "C": np.linspace(8, 9, 60), "D": np.linspace(9, 3, 60)}
    b = spark.createDataFrame([(s, d, float(v[i])) for s, v in px.items() for i, d in enumerate(days)], "symbol string, ts timestamp_ntz, close double")
    hold = P.buy_and_hold(b, 400.0).orderBy("ts").toPandas().equity
    assert hold.iloc[-1] == pytest.approx(100 * (2 + 1 + 9 / 8 + 3 / 9))
    r = pd.DataFrame(px).pct_change().fillna(0).mean(axis=1)
    assert np.allclose(P.equal_weight(b, 1.0).orderBy("ts").toPandas().equity, (1 + r).cumprod())
    top = P.momentum_top(b, top=1, cash=1.0, cost_bps=0).orderBy("ts").toPandas().equity
    first = next(i for i, d in enumerate(days) if d.weekday() == 4 and i >= 20)
    assert np.allclose(top[: first + 1], 1) and top.iloc[-1] == pytest.approx(20 / px["A"][first])


def test_table_writes(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert t.read() is None
    row = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    t.upsert(row((1, "a"), (2, "b")))
    t.upsert(row((2, "c"), (3, "d")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    for bad in (lambda: t.insert_once(row((3, "x"))), lambda: t.upsert(row((9, "x"), (9, "y")))):
        with pytest.raises(store.DuplicateKey):
            bad()
    t.insert_once(row((4, "e")))
    t.append(row((4, "e")))
    assert t.read().count() == 5


def test_feature_store_keeps_versions_apart(spark, tmp_path):
    df = spark.createDataFrame([("A", ts("2024-01-01"), 1.5, None)], "symbol string, ts timestamp_ntz, a double, b double")
    path = f"file://{tmp_path}/f"
    store.write_features(df, path, "v1", ["a", "b"])
    store.write_features(df.withColumn("a", F.lit(9.0)), path, "v2", ["a", "b"])
    store.write_features(df.withColumn("a", F.lit(2.0)), path, "v1", ["a", "b"])
    got = {v: tuple(store.unpack_features(spark.read.parquet(path), ["a", "b"], v).first())[2:] for v in ("v1", "v2")}
    assert got == {"v1": (2.0, None), "v2": (9.0, None)}
    assert store.mostly_missing(df, ["a", "b"]) == ["b"]


def test_payloads_of_prices(spark):
    chart = {"chart": {"result": [{"timestamp": [1577975400, 1578061800], "events": {"dividends": {"1": {"date": 1577975400, "amount": 0.5}}, "splits": {"1": {"date": 1578061800, "numerator": 1, "denominator": 4}}}, "indicators": {"quote": [{"open": [1.0, None], "high": [2.0, 2.0], "low": [0.5, 0.5], "close": [1.5, 1.6], "volume": [None, 7]}], "adjclose": [{"adjclose": [None, 1.1]}]}}]}}
    raw = spark.createDataFrame([("A", json.dumps(chart))], "symbol string, payload string")
    (r,) = payloads.chart_bars(raw).collect()
    assert (r.ts, r.adjusted_close, r.volume) == (ts("2020-01-02"), 1.5, 0)
    assert sorted((x.action, x.value) for x in payloads.chart_actions(raw).collect()) == [("DIVIDEND", 0.5), ("REVERSE_SPLIT", 0.25)]
    h = spark.createDataFrame([("A", json.dumps({"data": [{"t": f"2020-01-0{d}", "o": 1, "h": 1, "l": 1, "c": 2, "a": None, "v": 3} for d in (1, 2, 3)]}))], "symbol string, payload string")
    assert [x.adjusted_close for x in payloads.history_bars(h, "2020-01-02", "2020-01-03").collect()] == [2, 2]


def test_payloads_of_series_filings_and_news(spark):
    bls = {"Results": {"series": [{"seriesID": "S", "data": [{"year": "2020", "period": "M01", "value": "1.5"}, {"year": "2020", "period": "M02", "value": "-"}, {"year": "2020", "period": "M13", "value": "3"}, {"year": "2020", "period": "M03", "value": "NaN"}]}]}}
    (r,) = payloads.monthly_json(spark.createDataFrame([(json.dumps(bls),)], "payload string")).collect()
    assert (r.series, r.period, r.value, r.published) == ("S", ts("2020-01-31"), 1.5, ts("2020-02-15"))
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 10, "accn": "1", "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}, {"start": "2020-01-01", "end": "2020-03-31", "val": 11, "accn": "2", "fy": 2020, "fp": "Q1", "form": "8-K", "filed": "2020-05-01"}]}}, "SalesRevenueNet": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 99, "accn": "1", "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}]}}}}}
    (r,) = payloads.filing_facts(spark.createDataFrame([("A", json.dumps(facts))], "symbol string, payload string")).collect()
    assert (r.tag, r.value, r.form_type) == ("revenue", 10, "10-Q")
    ev = [{"title": "t", "markets": [{"id": "1", "question": "Will the Fed cut?", "outcomes": '["Yes", "No"]', "outcomePrices": '["1.2", "0"]'}, {"id": "2", "question": "", "outcomes": '["Up"]', "outcomePrices": '["1"]'}]}]
    (r,) = payloads.market_events(spark.createDataFrame([(ts("2024-01-01"), json.dumps(ev))], "observed timestamp_ntz, payload string")).collect()
    assert (r.event_id, r.category, r.probability) == ("1", "monetary_policy", 1.0)
    rss = "<rss><channel><item><title>News</title><link>http://x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
    (r,) = payloads.feed_items(spark.createDataFrame([("A", rss)], "symbol string, payload string")).collect()
    assert (r.headline, r.published, r.dedupe_key) == ("News", ts("2024-01-02 10:00"), "feed::http://x")
    f = spark.createDataFrame([("A", "8.01, 2.02", ts("2024-01-01"), ts("2024-01-01")), ("B", "9.99", None, ts("2024-01-02"))], "symbol string, items string, accepted timestamp_ntz, filed timestamp_ntz")
    assert [(x.category, x.uncertain) for x in payloads.filing_events(f).orderBy("symbol").collect()] == [("earnings", False), ("other", True)]


def test_observations_prefer_the_quarter_and_know_the_year_before(spark):
    def fact(tag, start, end, value, filed, form):
        return ("A", tag, ts(start) if start else None, ts(end), float(value), ts(filed), form)

    rows = [fact(t, "2020-04-01", "2020-06-30", v, "2020-08-01", "10-Q") for t, v in (("revenue", 100), ("eps_diluted", 1))] + [fact("revenue", "2020-01-01", "2020-06-30", 210, "2020-08-01", "10-Q"), fact("cash", None, "2020-06-30", 5, "2020-08-01", "10-Q")]
    rows += [fact(t, "2021-04-01", "2021-06-30", v, "2021-08-01", "10-Q") for t, v in (("revenue", 120), ("eps_diluted", 2))]
    got = filings.observations(spark.createDataFrame(rows, "symbol string, tag string, period_start timestamp_ntz, period_end timestamp_ntz, value double, filed_date timestamp_ntz, form_type string")).orderBy("published").collect()
    assert [r.revenue for r in got] == [100, 120] and got[1].revenue_growth == pytest.approx(0.2) and got[1].eps_growth == 1 and got[1].cash == 5 and got[0].revenue_growth is None


def test_resampling_is_repeatable_and_tests_what_it_says(spark):
    x = rng.normal(0.5, 1, 400)
    a, b = (models.block_bootstrap(spark, x, n_boot=200).first() for _ in range(2))
    assert a == b and a.ci_low < x.mean() < a.ci_high and models.block_bootstrap(spark, x[:5]).first().ci_low is None
    assert models.block_bootstrap(spark, x, n_boot=100, stationary=True).first().ci_low < x.mean()
    y = rng.normal(0, 1, 300)
    assert models.permutation_ic(spark, y, y + rng.normal(0, 1, 300), 200).first().p_value == 0
    assert models.permutation_ic(spark, y, rng.normal(0, 1, 300), 200).first().p_value > 0.01


def test_permutation_takes_all_predictions_or_refuses(spark, monkeypatch):
    from tidemark.plans.evaluation import permutation_test, predictions

    sf = "/root/testdata/sf0.001"
    want = predictions(spark, sf).select("excess_return_5d", "predicted").toPandas().astype(float).dropna()
    got = permutation_test(spark, sf).first()
    assert got.n_permutations == 1000 and got.observed_ic == pytest.approx(want["excess_return_5d"].rank().corr(want["predicted"].rank()))
    monkeypatch.setattr(models, "RESAMPLED", 10)
    with pytest.raises(ValueError):
        models.permutation_ic(spark, np.arange(11.0), np.arange(11.0))


def test_promotion_and_qualification():
    m = lambda ic, brier=0.24, dd=0.1, sharpe=1.0: {"excess_return_5d": {"information_coefficient": ic, "sharpe_ratio": sharpe}, "positive_5d": {"brier_score": brier}, "backtest": {"max_drawdown": -dd}}
    assert models.promote(m(0.05), None)[0] and not models.promote(m(-0.01), None)[0] and models.promote(m(0.05), m(0.05))[0]
    for worse in (m(0.05, brier=0.3), m(0.05, dd=0.2), m(0.05, sharpe=0.5), m(0.03)):
        assert not models.promote(worse, m(0.05))[0]
    good = {"excess_return_20d": {"information_coefficient": 0.05, "sharpe_ratio": 1.0}}
    assert models.qualify(good, 600, 0.01) == [] and len(models.qualify({}, 10, None)) == 4
    assert models.negative_control([("a", 3.0), ("b", 2.0), ("noise", 1.0)], "noise") == (3, True)
    assert models.importance_stability([{"a": 2, "b": 1}, {"a": 3, "b": 2}]) == pytest.approx(1)


def test_heads_and_registry(spark):
    x = rng.normal(0, 1, (400, 2))
    df = frame(spark, symbol="A", ts=range(400), f1=x[:, 0], f2=x[:, 1], excess_return_5d=x[:, 0] * 0.1, positive_5d=(x[:, 0] > 0).astype(float))
    heads = {t: models.train(df, ["f1", "f2"], t, trees=8) for t in ("excess_return_5d", "positive_5d")}
    got = models.predict(heads, df, ["f1", "f2"]).toPandas()
    assert np.corrcoef(got.predicted_excess_return_5d, x[:, 0])[0, 1] > 0.8 and got.probability_positive_5d.between(0, 1).all() and got.confidence.between(0, 1).all()
    assert models.importances(heads["excess_return_5d"], ["f1", "f2"])[0][0] == "f1"
    reg = models.register(models.register(None, spark, "{}", "CHAMPION"), spark, "{}")
    assert {r.model_version: r.role for r in models.crown(reg, "model_v0002").collect()} == {"model_v0001": "ARCHIVED", "model_v0002": "CHAMPION"}


def test_nested_selection_and_ablation(spark):
    from tidemark.operators import labels

    days = [t.to_pydatetime() for t in pd.bdate_range("2020-01-01", periods=240)]
    x = rng.normal(0, 1, (240, 3))
    df = spark.createDataFrame([(s, d, float(x[i, 0]), float(x[i, 1]), float(x[i, 0] * 0.1 + x[i, 2] * 0.01)) for s in "AB" for i, d in enumerate(days)], "symbol string, ts timestamp_ntz, agent_a double, return_1d double, excess_return_5d double")
    cal = labels.trading_calendar(df)
    folds = labels.purged_folds(240, 160, 80)
    got = models.nested_walk_forward(df, cal, folds, ["agent_a", "return_1d"], "excess_return_5d", [{"trees": 1}, {"trees": 4}])
    assert got.count() == 160 and {r.chosen for r in got.select("chosen").distinct().collect()} <= {0, 1}
    lost = models.ablation(df, cal, folds, ["agent_a", "return_1d"], "excess_return_5d", trees=4)
    assert lost["agent"] > 0.3 > abs(lost["technical"])


def test_monitoring(spark):
    from tidemark.operators import monitoring
    from tidemark.sources import synthetic

    b = synthetic.synthetic_bars(spark, 3, "2020-01-02", 60)
    assert b.count() == 240 and monitoring.quality_flags(b, ["symbol", "ts"]).count() == 0
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, synthetic.synthetic_bars(spark, 3, "2020-01-02", 60).repartition(7).collect()))
    bad = spark.createDataFrame([(1, 1.0, 2.0, 3.0, None, -1.0)], "k int, open double, high double, low double, close double, volume double")
    assert {r.rule for r in monitoring.quality_flags(bad, ["k"]).collect()} == {"positive_prices", "high_not_below_low", "close_within_range", "open_within_range", "volume_not_negative"}
    log = spark.createDataFrame([(1, True), (2, False)], "ts int, engaged boolean")
    assert not monitoring.engaged(None) and not monitoring.engaged(log) and monitoring.engaged(log.where("ts = 1"))
    assert [monitoring.ingestion_status(*x) for x in ((0, 0), (1, 0), (1, 1))] == ["FAILED", "PARTIAL", "SUCCESS"]
    m = monitoring.wide_macro(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "series string, period int, value double")).first()[0]
    assert m == {"a": 2.0, "b": 3.0}
