"""Technical indicators of bars (symbol, ts, open, high, low, close, volume): per symbol, in time order, NULL until warmed up.

All indicators of a step share one window specification, so bars are shuffled and sorted once by symbol. Recursive
(exponentially weighted) means have a closed form as one running sum, which stays in generated code; series too long for
it take a grouped pandas function instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.expr import E, ewm_rows, framed, over

RETURNS = (1, 2, 5, 10, 20, 60, 120, 252)
W = over()
ROOT_YEAR = "sqrt(252.0)"

#: Indicators by name, over columns of bars and of those before them.
RETURN_SET = {f"return_{n}d": f"close / nullif(lag(close, {n}) {W}, 0) - 1" for n in RETURNS}
SMA_SET = {f"sma_{n}": framed("avg", "close", n) for n in (10, 20, 50, 100, 200)}
DIST_SET = {f"dist_sma_{n}": f"close / nullif(sma_{n}, 0) - 1" for n in (20, 50, 200)}
VOL_SET = {f"realised_vol_{n}d": f"({framed('stddev_samp', 'return_1d', n)}) * {ROOT_YEAR}" for n in (10, 20, 60, 120)}
BAND_SET = {"__sd20": framed("stddev_samp", "close", 20)}
BAND_AFTER = {
    "bollinger_position": "(close - (sma_20 - 2 * __sd20)) / nullif(4 * __sd20, 0)",
    "bollinger_bandwidth": "4 * __sd20 / nullif(sma_20, 0)",
}
#: The first row's missing return counts as 0, so this warms up a row earlier than realised volatility.
DOWNSIDE_SET = {"__down": "CASE WHEN return_1d < 0 THEN return_1d ELSE 0.0 END"}
DOWNSIDE_AFTER = {"downside_vol_20d": f"({framed('stddev_samp', '__down', 20)}) * {ROOT_YEAR}"}
VOLUME_SET = {
    "volume_zscore_20d": f"(volume - ({framed('avg', 'volume', 20)})) / nullif({framed('stddev_samp', 'volume', 20)}, 0)",
    "relative_volume_20d": f"volume / nullif({framed('avg', 'volume', 20)}, 0)",
}
RANGE_SET = {
    "dist_52w_high": f"close / nullif({framed('max', 'close', 252, 20)}, 0) - 1",
    "dist_52w_low": f"close / nullif({framed('min', 'close', 252, 20)}, 0) - 1",
    "drawdown_from_high": f"close / nullif({framed('max', 'close', 252, 1)}, 0) - 1",
}
GAP_SET = {"gap_return": f"open / nullif(lag(close, 1) {W}, 0) - 1", "overnight_return": f"open / nullif(lag(close, 1) {W}, 0) - 1"}


def add(df: DataFrame, *sets: dict[str, str]) -> DataFrame:
    """Columns of each set, one set after another, computed together within a set."""
    for s in sets:
        df = df.select("*", *[E(x).alias(k) for k, x in s.items()])
    return df


def _closed(df: DataFrame, col: str, out: str, alpha: float, least: int, key: str, ts: str) -> DataFrame:
    w, keep = over(key, ts), 1 - alpha
    df = df.withColumn("__t", E(f"count({col}) {w} - 1"))
    term = f"CASE WHEN {col} IS NULL THEN NULL WHEN __t = 0 THEN {col} ELSE {alpha} * {col} * pow({keep}, -__t) END"
    df = df.withColumn("__term", E(term))
    return df.withColumn(out, E(f"CASE WHEN __t + 1 >= {least} THEN pow({keep}, __t) * sum(__term) {w} END")).drop("__t", "__term")


def ewm_mean(df: DataFrame, col: str, out: str, alpha: float, least: int, key: str = "symbol", ts: str = "ts", longest: int | None = None) -> DataFrame:
    """Exponentially weighted mean of `col` (m = x_0, then m + alpha (x - m)), from its `least`-th value on; NULLs keep the mean.

    longest: rows of the longest key, counted if not given; beyond `ewm_rows(alpha)` keys are taken one at a time in pandas."""
    longest = longest if longest is not None else df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest <= ewm_rows(alpha):
        return _closed(df, col, out, alpha, least, key, ts)
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema), StructField(out, DoubleType())])

    def means(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ts)
        return g.assign(**{out: g[col].ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean()})

    return df.groupBy(key).applyInPandas(means, schema)


def rsi(df: DataFrame, n: int = 14, longest: int | None = None) -> DataFrame:
    """rsi_<n>: Wilder's; 100 where the average loss is 0."""
    df = df.withColumn("__d", E(f"close - lag(close, 1) {W}")).withColumn("__g", E("greatest(__d, 0.0) + 0 * __d")).withColumn("__l", E("greatest(-__d, 0.0) + 0 * __d"))
    df = ewm_mean(ewm_mean(df, "__g", "__ag", 1 / n, n, longest=longest), "__l", "__al", 1 / n, n, longest=longest)
    return df.withColumn(f"rsi_{n}", E("CASE WHEN __al IS NULL THEN NULL WHEN __al = 0 THEN 100.0 ELSE 100 - 100 / (1 + __ag / __al) END")).drop("__d", "__g", "__l", "__ag", "__al")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, longest: int | None = None) -> DataFrame:
    """ema_<fast>, ema_<slow>, macd, macd_signal, macd_histogram."""
    for n in (fast, slow):
        df = ewm_mean(df, "close", f"ema_{n}", 2 / (n + 1), n, longest=longest)
    df = df.withColumn("macd", E(f"ema_{fast} - ema_{slow}"))
    df = ewm_mean(df, "macd", "macd_signal", 2 / (signal + 1), signal, longest=longest)
    return df.withColumn("macd_histogram", E("macd - macd_signal"))


def atr(df: DataFrame, n: int = 14, longest: int | None = None) -> DataFrame:
    """atr_<n>: Wilder's mean of the true range, whose first row is high - low."""
    df = df.withColumn("__pc", E(f"lag(close, 1) {W}")).withColumn("__tr", E("greatest(high - low, abs(high - __pc), abs(low - __pc))"))
    return ewm_mean(df, "__tr", f"atr_{n}", 1 / n, n, longest=longest).drop("__pc", "__tr")


def technical_features(bars: DataFrame) -> DataFrame:
    """All indicators, a row a bar."""
    longest = bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    df = add(bars, {**RETURN_SET, **SMA_SET, **BAND_SET, **VOLUME_SET, **RANGE_SET, **GAP_SET})
    df = add(df, {**DIST_SET, **VOL_SET, **BAND_AFTER, **DOWNSIDE_SET})
    df = add(df, DOWNSIDE_AFTER)
    return atr(macd(rsi(df, longest=longest), longest=longest), longest=longest).drop("__sd20", "__down")


def rolling_beta(bars: DataFrame, benchmark: DataFrame, n: int = 60) -> DataFrame:
    """symbol, ts, beta_<n>d, corr_<n>d and relative_return_20d against benchmark (ts, close). Both sides' returns are their own
    rows'; rows pair up on ts. The benchmark is a row a date, and broadcast: bars stay where their symbol is."""
    own = add(bars.select("symbol", "ts", "close"), {k: RETURN_SET[k] for k in ("return_1d", "return_20d")}).select("symbol", "ts", "return_1d", "return_20d")
    other = benchmark.withColumn("symbol", F.lit("")).select("ts", E(RETURN_SET["return_1d"]).alias("b1"), E(RETURN_SET["return_20d"]).alias("b20"))
    both = own.join(F.broadcast(other), "ts").where("return_1d IS NOT NULL AND b1 IS NOT NULL")
    f, warm = over(back=n - 1), f"row_number() {over()} >= {n}"
    return both.select(
        "symbol", "ts", E(f"CASE WHEN {warm} THEN covar_samp(return_1d, b1) {f} / nullif(var_samp(b1) {f}, 0) END").alias(f"beta_{n}d"),
        E(f"CASE WHEN {warm} THEN covar_samp(return_1d, b1) {f} / nullif(sqrt(var_samp(return_1d) {f}) * sqrt(var_samp(b1) {f}), 0) END").alias(f"corr_{n}d"), E("return_20d - b20").alias("relative_return_20d"),
    )
