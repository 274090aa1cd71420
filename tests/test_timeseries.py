"""Indicators by hand, against pandas, and without a look ahead; as-of joins at their edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analogue as N
from tidemark.operators import asof as A
from tidemark.operators import crosssection as X
from tidemark.operators import labels as L
from tidemark.operators import technical as T

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="A", volume=1e6):
    days = pd.bdate_range("2020-01-01", periods=len(closes)).to_pydatetime()
    return spark.createDataFrame([(symbol, t, c, c * 1.001, c * 0.999, c, volume) for t, c in zip(days, map(float, closes), strict=True)], BARS)


def walk(n, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n)))


def by_time(df):
    return df.orderBy("ts").toPandas()


def test_returns_and_means_by_hand(spark):
    got = by_time(T.add(bars(spark, range(1, 31)), T.RETURN_SET, T.SMA_SET))
    assert got.return_1d[1] == 1.0 and got.return_5d[9] == 1.0 and pd.isna(got.return_1d[0])
    assert got.sma_10[9] == 5.5 and pd.isna(got.sma_10[8]) and got.sma_20[29] == 20.5


def test_rsi_at_its_ends(spark):
    assert by_time(T.rsi(bars(spark, range(1, 40)))).rsi_14[38] == 100
    assert by_time(T.rsi(bars(spark, range(40, 1, -1)))).rsi_14[38] == 0
    assert by_time(T.rsi(bars(spark, [5] * 30))).rsi_14[29] == 100


@pytest.mark.parametrize("longest", [None, 10**9])
def test_recursive_means_equal_pandas_by_either_way(spark, longest):
    c = pd.Series(walk(300))
    got = by_time(T.macd(bars(spark, c), longest=longest))
    for n, alpha in ((12, 2 / 13), (26, 2 / 27)):
        want = c.ewm(alpha=alpha, adjust=False, min_periods=n).mean()
        assert np.allclose(got[f"ema_{n}"], want, equal_nan=True, rtol=1e-10)
    macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(got.macd_signal, macd.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True, rtol=1e-9)
    gain, loss = c.diff().clip(lower=0), -c.diff().clip(upper=0)
    rs = gain.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() / loss.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert np.allclose(by_time(T.rsi(bars(spark, c), longest=longest)).rsi_14, 100 - 100 / (1 + rs), equal_nan=True)


def test_windows_equal_pandas(spark):
    c = pd.Series(walk(300, 3))
    got, r = by_time(T.technical_features(bars(spark, c))), c.pct_change()
    root = np.sqrt(252)
    assert np.allclose(got.realised_vol_20d, r.rolling(20).std() * root, equal_nan=True)
    assert np.allclose(got.downside_vol_20d, r.where(r < 0, 0.0).rolling(20).std() * root, equal_nan=True)
    sd, m = c.rolling(20).std(), c.rolling(20).mean()
    assert np.allclose(got.bollinger_position, (c - (m - 2 * sd)) / (4 * sd), equal_nan=True)
    assert np.allclose(got.dist_52w_high, c / c.rolling(252, min_periods=20).max() - 1, equal_nan=True)
    warm = {"rsi_14": 14, "macd": 25, "macd_signal": 33, "downside_vol_20d": 19, "realised_vol_20d": 20, "atr_14": 13}
    assert {k: int(got[k].first_valid_index()) for k in warm} == warm


def test_features_do_not_look_ahead(spark):
    c = walk(150, 5)
    whole, part = by_time(T.technical_features(bars(spark, c))), by_time(T.technical_features(bars(spark, c[:120])))
    for k in part.columns[7:]:
        assert np.allclose(whole[k][:120].astype(float), part[k].astype(float), equal_nan=True, rtol=1e-9), k


def test_beta_of_a_multiple(spark):
    c = walk(100, 7)
    twice = 100 * np.cumprod(np.r_[1, 1 + 2 * (c[1:] / c[:-1] - 1)])
    got = by_time(T.rolling_beta(bars(spark, twice), bars(spark, c).select("ts", "close")))
    assert got.beta_60d.iloc[-1] == pytest.approx(2) and got.corr_60d.iloc[-1] == pytest.approx(1) and got.beta_60d.notna().sum() == 40


def test_constant_prices_have_no_beta_and_raise_nothing(spark):
    got = by_time(T.rolling_beta(bars(spark, [5.0] * 80), bars(spark, [7.0] * 80).select("ts", "close")))
    assert got.beta_60d.isna().all() and got.corr_60d.isna().all()
    assert by_time(T.technical_features(bars(spark, [5.0] * 80))).bollinger_position.isna().all()


def ts(s):
    return pd.Timestamp(s).to_pydatetime()


def test_a_fact_is_seen_from_its_publication_on(spark):
    facts = spark.createDataFrame([("A", ts("2020-05-01"), 100.0), ("A", ts("2020-08-01"), 200.0), ("B", ts("2020-01-01"), 7.0)], "symbol string, published timestamp_ntz, revenue double")
    days = spark.createDataFrame([("A", ts(d)) for d in ("2020-04-30", "2020-05-01", "2020-06-15", "2020-07-31", "2020-08-01")] + [("C", ts("2020-06-01"))], "symbol string, ts timestamp_ntz")
    got = A.asof_join(days, facts, ["symbol"], "ts", "published", {"revenue": "revenue"}).orderBy("symbol", "ts").collect()
    assert [r.revenue for r in got] == [None, 100, 100, 100, 200, None]
    assert A.latest_asof(facts, ["symbol"], ["published"], F.lit("2020-07-31").cast("timestamp_ntz")).where("symbol = 'A'").first().revenue == 100


def test_memberships_include_their_start_and_not_their_end(spark):
    m = spark.createDataFrame([("A", ts("2020-01-10"), ts("2020-01-20")), ("A", ts("2020-01-15"), None), ("B", ts("2020-01-10"), ts("2020-01-12"))], "symbol string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    p = spark.createDataFrame([(s, ts(f"2020-01-{d:02}")) for s in "AB" for d in (9, 10, 12, 20)], "symbol string, ts timestamp_ntz")
    assert sorted((r.symbol, r.ts.day) for r in A.members_at(p, m).collect()) == [("A", 10), ("A", 12), ("A", 20), ("B", 10)]


def test_news_counts_by_hand(spark):
    now = pd.Timestamp("2024-01-31 12:00")
    ages = [pd.Timedelta(minutes=30), pd.Timedelta(hours=3), pd.Timedelta(days=2), pd.Timedelta(days=6), pd.Timedelta(days=30), pd.Timedelta(minutes=-5)]
    a = spark.createDataFrame([("A", (now - x).to_pydatetime(), "TIER_1_OFFICIAL", False) for x in ages] + [("A", now.to_pydatetime(), "odd", True)], "symbol string, published timestamp_ntz, tier string, uncertain boolean")
    p = spark.createDataFrame([("A", now.to_pydatetime()), ("B", now.to_pydatetime())], "symbol string, ts timestamp_ntz")
    got = {r.symbol: r for r in A.news_counts(p, a).collect()}
    assert [got["A"][f"n_articles_{k}"] for k in ("1h", "6h", "24h", "3d", "7d")] == [1, 2, 2, 3, 4]
    assert got["A"].source_weighted_count_7d == 4 and got["A"].hours_since_last_article == 0.5
    assert got["B"].n_articles_7d == 0 and got["B"].hours_since_last_article is None


def test_reconciliation_by_hand(spark):
    rows = [(1, 100.0, 100.05), (2, 100.0, 101.0), (3, 100.0, 110.0), (4, 100.0, None), (5, None, 9.0), (6, 0.0, 1.0)]
    p = spark.createDataFrame([(k, a) for k, a, _ in rows if a is not None], "k int, close double")
    s = spark.createDataFrame([(k, b) for k, _, b in rows if b is not None], "k int, close double")
    got = {r.k: (r.status, r.canonical_close) for r in A.reconcile(p, s, ["k"]).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["VALIDATED", "MINOR_DIFFERENCE", "MAJOR_DIFFERENCE", "SECONDARY_MISSING", "PRIMARY_MISSING", "MAJOR_DIFFERENCE"]
    assert got[5][1] == 9.0


def test_ranks_share_ties_and_skip_missing(spark):
    df = spark.createDataFrame([("A", 1, 0.1), ("B", 1, 0.2), ("C", 2, 0.05), ("D", 2, 0.15), ("E", 2, 0.15), ("F", 2, None)], "symbol string, ts int, return_60d double")
    got = {r.symbol: r.momentum_percentile for r in X.percentile_ranks(df).collect()}
    assert got == {"A": 0.5, "B": 1.0, "C": pytest.approx(1 / 3), "D": pytest.approx(2.5 / 3), "E": pytest.approx(2.5 / 3), "F": None}
    assert "value_percentile" not in X.percentile_ranks(df).columns


def test_zscores_by_hand(spark):
    df = spark.createDataFrame([("CHEAP", 1, 5.0, 1.0), ("DEAR", 1, 15.0, 1.0)], "symbol string, ts int, pe double, flat double")
    got = {r.symbol: (r.z, r.f) for r in X.mean_zscore(X.mean_zscore(df, ["pe"], "z", sign=-1), ["flat"], "f").collect()}
    assert got == {"CHEAP": (1, 0), "DEAR": (-1, 0)}


def test_breadth_counts_what_is_there(spark):
    df = spark.createDataFrame([("A", 1, 0.1, 0.02, 10.0), ("B", 1, -0.1, -0.01, 30.0), ("C", 1, None, None, 5.0)], "symbol string, ts int, dist_sma_20 double, return_1d double, dollar_volume double")
    r = X.market_breadth(df).first()
    assert r.pct_above_sma20 == 0.5 and r.advance_decline_proxy == 0 and r.median_stock_return == pytest.approx(0.005)
    assert r.dollar_volume_weighted_return == pytest.approx((0.2 - 0.3) / 40)


def test_purging_at_its_boundary(spark):
    days = pd.bdate_range("2020-01-01", periods=300)
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "ts timestamp_ntz")
    got = by_time(L.purge_mask(df, days[100].to_pydatetime(), days[104].to_pydatetime()))
    ok = got.eligible.tolist()
    assert ok[79] and not ok[80] and not ok[104] and not ok[109] and ok[110]
    region = by_time(L.partition(df, days[100].to_pydatetime(), days[104].to_pydatetime())).region
    assert region[79] == "development" and region[80] == "purged" and region[100] == "holdout" and region[105] == "post"


def test_folds_and_their_guard(spark):
    folds = L.purged_folds(300, 100, 50)
    assert [(f.validation_start, f.validation_end) for f in folds] == [(100, 149), (150, 199), (200, 249), (250, 299)]
    assert L.purged_folds(300, 100, 50, rolling=60)[2].train_start == 140
    cal = L.trading_calendar(spark.range(300).selectExpr("timestamp_ntz'2020-01-01' + make_dt_interval(id) AS ts"))
    table = L.fold_table(cal, folds)
    L.assert_clear(table, ts("2021-01-01"))
    with pytest.raises(ValueError):
        L.assert_clear(table, ts("2020-10-01"))


def test_targets_are_forward_and_relative(spark):
    c, b = walk(60, 1), walk(60, 2)
    got = by_time(L.forward_targets(bars(spark, c), bars(spark, b).select("ts", "close")))
    assert got.excess_return_5d[3] == pytest.approx(c[8] / c[3] - b[8] / b[3]) and pd.isna(got.excess_return_20d[40])
    assert got.positive_5d[3] == float(got.excess_return_5d[3] > 0) and pd.isna(got.positive_20d[59])


def test_analogues_in_blocks_equal_those_in_one(spark):
    r = np.random.default_rng(5)
    n = 150
    panel = spark.createDataFrame([(f"s{k}", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(50 + r.normal()), float(round(r.normal(), 1)), float(r.normal()) if i % 9 else None) for k in range(2) for i in range(n)], "symbol string, ts timestamp_ntz, close double, f double, g double")
    rows = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())
    whole = rows(N.all_analogues(panel, ["f", "g"], k=7))
    assert len(whole) > 100 and rows(N.all_analogues(panel, ["f", "g"], k=7, block=16)) == whole
    assert rows(N.all_analogues(panel, ["f", "g"], k=7, strict=False, block=16)) == rows(N.all_analogues(panel, ["f", "g"], k=7, strict=False))


def test_analogues_know_only_what_was_known(spark):
    c = walk(200, 9)
    panel = bars(spark, c).select("symbol", "ts", "close").withColumn("f", F.expr("close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts)"))
    got = by_time(N.all_analogues(panel, ["f"], k=5))
    part = by_time(N.all_analogues(panel.where("ts < TIMESTAMP '2020-08-01'"), ["f"], k=5))
    both = got.merge(part, on="ts")
    assert len(part) > 50 and np.allclose(both.avg_return_20d_x, both.avg_return_20d_y) and np.allclose(both.similarity_confidence_x, both.similarity_confidence_y)
    latest = N.latest_analogues(panel, ["f"], k=5).first()
    f = pd.Series(c) / pd.Series(c).shift(3)
    z = (f - f.mean()) / f.std(ddof=0)
    near = (z[:180].dropna() - z.iloc[-1]).abs().nsmallest(5)
    ahead = [c[i + 20] / c[i] - 1 for i in near.index]
    assert latest.num_analogues == 5 and latest.avg_return_20d == pytest.approx(np.mean(ahead)) and latest.p10_return_20d == pytest.approx(np.quantile(ahead, 0.1))
    assert N.latest_analogues(panel, ["f"], min_history=1000).count() == 0
