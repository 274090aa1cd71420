"""Queries: bars and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import technical as T
from tidemark.operators.crosssection import market_breadth as breadth
from tidemark.operators.crosssection import percentile_ranks as ranks
from tidemark.operators.crosssection import positive_fraction
from tidemark.operators.labels import forward_targets as targets
from tidemark.plans.base import Registry, r, rounded, with_
from tidemark.sources import tables

R = Registry()
W = "OVER (PARTITION BY symbol ORDER BY ts)"


def _over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {_over(n)} >= {least or n} THEN {agg}({x}) {_over(n)} END"


def _ret(n: int) -> str:
    return f"close / nullif(lag(close, {n}) {W}, 0) - 1"


def _ewm(src: str, x: str, out: str, alpha: float, least: int) -> dict[str, str]:
    """Relations that add `out`, the exponentially weighted mean of x, to `src`: powers of the row number among values, and a running sum."""
    keep = 1 - alpha
    return {
        f"{out}_n": f"SELECT *, count({x}) {W} - 1 AS tt FROM {src}",
        f"{out}_s": f"SELECT *, CASE WHEN {x} IS NULL THEN NULL WHEN tt = 0 THEN {x} ELSE {alpha} * {x} * pow({keep}, -tt) END AS term FROM {out}_n",
        f"{out}_x": f"SELECT * EXCLUDE (tt, term), CASE WHEN tt + 1 >= {least} THEN pow({keep}, tt) * sum(term) {W} END AS {out} FROM {out}_s",
    }


def _macd(src: str) -> dict[str, str]:
    a = _ewm(src, "close", "ema_12", 2 / 13, 12)
    b = _ewm("ema_12_x", "close", "ema_26", 2 / 27, 26)
    return {**a, **b, "m": "SELECT *, ema_12 - ema_26 AS macd FROM ema_26_x", **_ewm("m", "macd", "macd_signal", 2 / 10, 9)}


def _rsi(src: str) -> dict[str, str]:
    d = {"rd": f"SELECT *, close - lag(close, 1) {W} AS dd FROM {src}", "rg": "SELECT *, CASE WHEN dd IS NULL THEN NULL WHEN dd > 0 THEN dd ELSE 0.0 END AS gg, CASE WHEN dd IS NULL THEN NULL WHEN dd < 0 THEN -dd ELSE 0.0 END AS ll FROM rd"}
    out = {**d, **_ewm("rg", "gg", "ag", 1 / 14, 14), **_ewm("ag_x", "ll", "al", 1 / 14, 14)}
    return {**out, "rsi": "SELECT *, CASE WHEN al IS NULL THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM al_x"}


FEATURES = {
    "f1": "SELECT *, " + ", ".join(f"{_ret(n)} AS return_{n}d" for n in T.RETURNS) + ", " + ", ".join(f"{_roll('avg', 'close', n)} AS sma_{n}" for n in (10, 20, 50, 100, 200)) + f", {_roll('stddev_samp', 'close', 20)} AS sd20, volume / nullif({_roll('avg', 'volume', 20)}, 0) AS relative_volume_20d, (volume - ({_roll('avg', 'volume', 20)})) / nullif({_roll('stddev_samp', 'volume', 20)}, 0) AS volume_zscore_20d, close / nullif({_roll('max', 'close', 252, 20)}, 0) - 1 AS dist_52w_high, close / nullif({_roll('min', 'close', 252, 20)}, 0) - 1 AS dist_52w_low, close / max(close) {_over(252)} - 1 AS drawdown_from_high, open / nullif(lag(close, 1) {W}, 0) - 1 AS gap_return, open / nullif(lag(close, 1) {W}, 0) - 1 AS overnight_return FROM bars",
    "f2": "SELECT *, " + ", ".join(f"close / nullif(sma_{n}, 0) - 1 AS dist_sma_{n}" for n in (20, 50, 200)) + ", " + ", ".join(f"({_roll('stddev_samp', 'return_1d', n)}) * sqrt(252.0) AS realised_vol_{n}d" for n in (10, 20, 60, 120)) + ", (close - (sma_20 - 2 * sd20)) / nullif(4 * sd20, 0) AS bollinger_position, 4 * sd20 / nullif(sma_20, 0) AS bollinger_bandwidth, CASE WHEN return_1d < 0 THEN return_1d ELSE 0.0 END AS down FROM f1",
    "f3": f"SELECT *, ({_roll('stddev_samp', 'down', 20)}) * sqrt(252.0) AS downside_vol_20d FROM f2",
}
#: Volumes are whole and prices are rounded, so these sums agree to the last digit that is compared.
PANEL = {**FEATURES, **_rsi("f3"), **_macd("rsi"), "panel": "SELECT *, macd - macd_signal AS macd_histogram, close * volume AS dollar_volume FROM macd_signal_x"}


def panel(spark, sf):
    """Every indicator, with the traded value."""
    return T.technical_features(tables.bars(spark, sf)).withColumn("dollar_volume", F.expr("close * volume"))


@R.query(with_("SELECT symbol, ts, open, high, low, close, volume FROM bars", "bars"))
def bars_daily(spark, sf):
    return tables.bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")


@R.query(with_("SELECT ts, close FROM bench", "bench"))
def benchmark_daily(spark, sf):
    return tables.benchmark(spark, sf)


@R.query(with_("SELECT symbol, ts, " + ", ".join(f"round({_ret(n)}, 6) AS return_{n}d" for n in T.RETURNS) + " FROM bars", "bars"))
def returns_multi(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), T.RETURN_SET).select("symbol", "ts", *T.RETURN_SET))


@R.query(with_(f"SELECT symbol, ts, {r('sma_10', 'sma_20', 'sma_50', 'sma_100', 'sma_200', 'dist_sma_20', 'dist_sma_50', 'dist_sma_200', digits=4)} FROM f2", "bars", **FEATURES))
def sma_distance(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), T.SMA_SET, T.DIST_SET).select("symbol", "ts", *T.SMA_SET, *T.DIST_SET), 4)


@R.query(with_(f"SELECT symbol, ts, {r('realised_vol_10d', 'realised_vol_20d', 'realised_vol_60d', 'realised_vol_120d')} FROM f2", "bars", **FEATURES))
def realised_vol(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), {"return_1d": T.RETURN_SET["return_1d"]}, T.VOL_SET).select("symbol", "ts", *T.VOL_SET))


@R.query(with_(f"SELECT symbol, ts, {r('bollinger_position', 'bollinger_bandwidth')} FROM f2", "bars", **FEATURES))
def bollinger(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), {**T.BAND_SET, "sma_20": T.SMA_SET["sma_20"]}, T.BAND_AFTER).select("symbol", "ts", *T.BAND_AFTER))


@R.query(with_(f"SELECT symbol, ts, {r('downside_vol_20d')} FROM f3", "bars", **FEATURES))
def downside_vol(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), {"return_1d": T.RETURN_SET["return_1d"]}, T.DOWNSIDE_SET, T.DOWNSIDE_AFTER).select("symbol", "ts", *T.DOWNSIDE_AFTER))


@R.query(with_(f"SELECT symbol, ts, {r('volume_zscore_20d', 'relative_volume_20d')} FROM f1", "bars", **FEATURES))
def volume_stats(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), T.VOLUME_SET).select("symbol", "ts", *T.VOLUME_SET))


@R.query(with_(f"SELECT symbol, ts, {r('dist_52w_high', 'dist_52w_low', 'drawdown_from_high')} FROM f1", "bars", **FEATURES))
def high_low_52w(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), T.RANGE_SET).select("symbol", "ts", *T.RANGE_SET))


@R.query(with_(f"SELECT symbol, ts, {r('gap_return', 'overnight_return')} FROM f1", "bars", **FEATURES))
def gap_return(spark, sf):
    return rounded(T.add(tables.bars(spark, sf), T.GAP_SET).select("symbol", "ts", *T.GAP_SET))


@R.query(with_(f"SELECT symbol, ts, {r('ema_12', 'ema_26', 'macd', 'macd_signal', macd_histogram='macd - macd_signal', digits=3)} FROM macd_signal_x", "bars", **_macd("bars")))
def ema_macd(spark, sf):
    return rounded(T.macd(tables.bars(spark, sf)).select("symbol", "ts", "ema_12", "ema_26", "macd", "macd_signal", "macd_histogram"), 3)


@R.query(with_(f"SELECT symbol, ts, {r('rsi_14', digits=5)} FROM rsi", "bars", **_rsi("bars")))
def rsi_wilder(spark, sf):
    return rounded(T.rsi(tables.bars(spark, sf)).select("symbol", "ts", "rsi_14"), 5)


@R.query(with_(f"SELECT symbol, ts, {r('atr_14', digits=5)} FROM atr_14_x", "bars", tr=f"SELECT *, greatest(high - low, abs(high - lag(close, 1) {W}), abs(low - lag(close, 1) {W})) AS tr FROM bars", **_ewm("tr", "tr", "atr_14", 1 / 14, 14)))
def atr_wilder(spark, sf):
    return rounded(T.atr(tables.bars(spark, sf)).select("symbol", "ts", "atr_14"), 5)


_TECH = ["return_1d", "return_252d", "sma_200", "dist_sma_20", "realised_vol_20d", "downside_vol_20d", "bollinger_position", "volume_zscore_20d", "dist_52w_high", "rsi_14", "macd", "macd_signal"]


@R.query(with_(f"SELECT symbol, ts, {r(*_TECH, digits=3)} FROM panel", "bars", **PANEL))
def technical_feature_set(spark, sf):
    return rounded(panel(spark, sf).select("symbol", "ts", *_TECH), 3)


_OWN = f"SELECT symbol, ts, {_ret(1)} AS r1, {_ret(20)} AS r20 FROM bars"
_BENCH = "SELECT ts, close / nullif(lag(close, 1) OVER (ORDER BY ts), 0) - 1 AS b1, close / nullif(lag(close, 20) OVER (ORDER BY ts), 0) - 1 AS b20 FROM bench"


@R.query(with_(f"SELECT symbol, ts, round(CASE WHEN count(*) {_over(60)} >= 60 THEN covar_samp(r1, b1) {_over(60)} / nullif(var_samp(b1) {_over(60)}, 0) END, 6) AS beta_60d, round(CASE WHEN count(*) {_over(60)} >= 60 THEN corr(r1, b1) {_over(60)} END, 6) AS corr_60d, round(r20 - b20, 6) AS relative_return_20d FROM own JOIN other USING (ts) WHERE r1 IS NOT NULL AND b1 IS NOT NULL", "bars", "bench", own=_OWN, other=_BENCH))
def rolling_beta_corr(spark, sf):
    return rounded(T.rolling_beta(tables.bars(spark, sf), tables.benchmark(spark, sf)))


TARGETS = {
    "fwd": f"SELECT symbol, ts, lead(close, 5) {W} / nullif(close, 0) - 1 AS f5, lead(close, 20) {W} / nullif(close, 0) - 1 AS f20 FROM bars",
    "bfwd": "SELECT ts, lead(close, 5) OVER (ORDER BY ts) / nullif(close, 0) - 1 AS b5, lead(close, 20) OVER (ORDER BY ts) / nullif(close, 0) - 1 AS b20 FROM bench",
    "targets": "SELECT symbol, ts, f5 - b5 AS excess_return_5d, f20 - b20 AS excess_return_20d, CASE WHEN f5 - b5 > 0 THEN 1.0 WHEN f5 - b5 IS NOT NULL THEN 0.0 END AS positive_5d, CASE WHEN f20 - b20 > 0 THEN 1.0 WHEN f20 - b20 IS NOT NULL THEN 0.0 END AS positive_20d FROM fwd LEFT JOIN bfwd USING (ts)",
}


@R.query(with_(f"SELECT symbol, ts, {r('excess_return_5d', 'excess_return_20d')}, CAST(positive_5d AS DOUBLE) AS positive_5d, CAST(positive_20d AS DOUBLE) AS positive_20d FROM targets", "bars", "bench", **TARGETS))
def forward_targets(spark, sf):
    return rounded(targets(tables.bars(spark, sf), tables.benchmark(spark, sf)))


_SPEC = {"momentum_percentile": ("return_60d", True), "volatility_percentile": ("realised_vol_20d", False), "liquidity_percentile": ("dollar_volume", True)}
_rank = lambda x, o: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {x} {o} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY ts) END"
#: Inputs are rounded, so that both engines see the same ties.
_ROUNDED = f"SELECT symbol, ts, {r('return_60d', 'realised_vol_20d', digits=9)}, dollar_volume FROM (SELECT *, close * volume AS dollar_volume FROM f2)"


@R.query(with_(f"SELECT symbol, ts, round({_rank('return_60d', 'ASC')}, 6) AS momentum_percentile, round({_rank('realised_vol_20d', 'DESC')}, 6) AS volatility_percentile, round({_rank('dollar_volume', 'ASC')}, 6) AS liquidity_percentile FROM p", "bars", **FEATURES, p=_ROUNDED))
def percentile_ranks(spark, sf):
    p = T.add(tables.bars(spark, sf), {k: T.RETURN_SET[k] for k in ("return_1d", "return_60d")}, {"realised_vol_20d": T.VOL_SET["realised_vol_20d"], "dollar_volume": "close * volume"})
    return rounded(ranks(p.select("symbol", "ts", F.round("return_60d", 9).alias("return_60d"), F.round("realised_vol_20d", 9).alias("realised_vol_20d"), "dollar_volume"), _SPEC))


@R.query(with_(
    "SELECT ts, " + ", ".join(f"round(avg(CASE WHEN dist_sma_{n} IS NOT NULL THEN CASE WHEN dist_sma_{n} > 0 THEN 1.0 ELSE 0.0 END END), 6) AS pct_above_sma{n}" for n in (20, 50, 200))
    + ", round(avg(sign(return_1d)), 6) AS advance_decline_proxy, round(stddev_pop(return_1d), 6) AS cross_sectional_return_dispersion, round(quantile_cont(return_1d, 0.5), 6) AS median_stock_return, round(avg(return_1d), 6) AS equal_weight_return, round(sum(return_1d * dv) / nullif(sum(CASE WHEN return_1d IS NOT NULL THEN dv END), 0), 6) AS dollar_volume_weighted_return, round(avg(CASE WHEN dist_52w_high IS NOT NULL THEN CASE WHEN dist_52w_high >= -0.001 THEN 1.0 ELSE 0.0 END END), 6) AS pct_new_52w_highs, round(avg(CASE WHEN dist_52w_low IS NOT NULL THEN CASE WHEN dist_52w_low <= 0.001 THEN 1.0 ELSE 0.0 END END), 6) AS pct_new_52w_lows, round(avg(return_1d) - sum(return_1d * dv) / nullif(sum(CASE WHEN return_1d IS NOT NULL THEN dv END), 0), 6) AS equal_vs_volume_weighted_spread FROM (SELECT *, greatest(close * volume, 0) AS dv FROM f2) GROUP BY ts", "bars", **FEATURES))
def market_breadth(spark, sf):
    p = T.add(tables.bars(spark, sf), {**{"return_1d": T.RETURN_SET["return_1d"]}, **T.SMA_SET, **T.RANGE_SET, "dollar_volume": "close * volume"}, T.DIST_SET)
    return rounded(breadth(p))


@R.query(with_("SELECT ts, round(avg(CASE WHEN return_20d > 0 THEN 1.0 ELSE 0.0 END), 6) AS breadth_ratio FROM f1 GROUP BY ts", "bars", **FEATURES))
def breadth_ratio(spark, sf):
    return rounded(positive_fraction(T.add(tables.bars(spark, sf), {"return_20d": T.RETURN_SET["return_20d"]})))
