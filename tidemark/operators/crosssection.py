"""Operators across the symbols of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import E

#: Each metric's name, its column, whether more is better.
METRICS = {"momentum_percentile": ("return_60d", True), "value_percentile": ("valuation_zscore", True), "quality_percentile": ("profitability_zscore", True), "growth_percentile": ("growth_zscore", True), "volatility_percentile": ("realised_vol_20d", False), "liquidity_percentile": ("dollar_volume", True), "earnings_quality_percentile": ("fundamental_earnings_quality_score", True)}


def percentile_ranks(panel: DataFrame, metrics: dict[str, tuple[str, bool]] = METRICS, ts: str = "ts") -> DataFrame:
    """symbol, ts and each metric's rank among the date's symbols that have one, over their number; ties share their mean rank.
    Metrics whose column is absent are absent."""
    def rank(x: str, up: bool) -> str:
        # Rank, ties and number share a window specification, so that a date's symbols are sorted once a metric.
        w = f"PARTITION BY {ts} ORDER BY {x} {'ASC' if up else 'DESC'} NULLS LAST"
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({w}) + (count(*) OVER ({w} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0D) / count({x}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END"

    return panel.select("symbol", ts, *[E(rank(x, up)).alias(k) for k, (x, up) in metrics.items() if x in panel.columns])


def zscore(x: str, ts: str = "ts") -> str:
    """Standard score within a date, with the population's deviation; 0 where that is 0 or missing, NULL where x is."""
    w = f"OVER (PARTITION BY {ts})"
    sd = f"stddev_pop({x}) {w}"
    return f"CASE WHEN coalesce({sd}, 0) = 0 THEN 0.0D ELSE ({x} - avg({x}) {w}) / ({sd}) END"


def mean_zscore(df: DataFrame, cols: list[str], out: str, ts: str = "ts", sign: int = 1) -> DataFrame:
    """`out`: the mean of the columns' z-scores, missing ones left out."""
    zs = [f"__z{i}" for i in range(len(cols))]
    df = df.select("*", *[E(zscore(c, ts)).alias(z) for c, z in zip(cols, zs, strict=True)])
    total, n = " + ".join(f"coalesce({z}, 0)" for z in zs), " + ".join(f"CASE WHEN {z} IS NULL THEN 0 ELSE 1 END" for z in zs)
    return df.withColumn(out, E(f"{sign} * ({total}) / nullif({n}, 0)")).drop(*zs)


VALUATION, PROFITABILITY, GROWTH = ["pe_ratio", "ev_to_ebitda", "price_to_book", "price_to_sales"], ["gross_margin", "operating_margin", "fcf_margin", "roic"], ["revenue_growth", "eps_growth"]


def fundamental_zscores(df: DataFrame, ts: str = "ts") -> DataFrame:
    """debt_to_cash and the three mean z-scores; cheap is high in valuation."""
    df = df.withColumn("debt_to_cash", E("debt / nullif(cash, 0)"))
    df = mean_zscore(df, VALUATION, "valuation_zscore", ts, -1)
    return mean_zscore(mean_zscore(df, PROFITABILITY, "profitability_zscore", ts), GROWTH, "growth_zscore", ts)


def market_breadth(panel: DataFrame, ts: str = "ts") -> DataFrame:
    """A row a date; each statistic over the symbols that have its input, absent inputs give no column. One aggregation."""
    have, out = set(panel.columns), []
    share = lambda test, x: F.avg(F.when(F.col(x).isNotNull(), E(f"CASE WHEN {test} THEN 1.0D ELSE 0.0D END")))
    out += [share(f"dist_sma_{n} > 0", f"dist_sma_{n}").alias(f"pct_above_sma{n}") for n in (20, 50, 200) if f"dist_sma_{n}" in have]
    if "return_1d" in have:
        out += [F.avg(F.signum("return_1d")).alias("advance_decline_proxy"), F.stddev_pop("return_1d").alias("cross_sectional_return_dispersion"), E("percentile(return_1d, 0.5)").alias("median_stock_return"), F.avg("return_1d").alias("equal_weight_return")]
        if "dollar_volume" in have:
            w = "CASE WHEN return_1d IS NOT NULL THEN greatest(dollar_volume, 0) END"
            out.append(E(f"sum(return_1d * {w}) / nullif(sum({w}), 0)").alias("dollar_volume_weighted_return"))
    if "dist_52w_high" in have:
        out.append(share("dist_52w_high >= -0.001", "dist_52w_high").alias("pct_new_52w_highs"))
    if "dist_52w_low" in have:
        out.append(share("dist_52w_low <= 0.001", "dist_52w_low").alias("pct_new_52w_lows"))
    got = panel.groupBy(ts).agg(*out)
    if "dollar_volume_weighted_return" in got.columns:
        got = got.withColumn("equal_vs_volume_weighted_spread", E("equal_weight_return - dollar_volume_weighted_return"))
    return got


def positive_fraction(panel: DataFrame, x: str = "return_20d", ts: str = "ts") -> DataFrame:
    """The share of a date's symbols with x > 0; missing ones count as not."""
    return panel.groupBy(ts).agg(F.avg(E(f"CASE WHEN {x} > 0 THEN 1.0D ELSE 0.0D END")).alias("breadth_ratio"))


def trailing_zscores(history: DataFrame, back: int = 36, least: int = 3) -> DataFrame:
    """series, zscore and level of the latest of each series' last `back` periods (series, period, value)."""
    recent = history.withColumn("__rn", E("row_number() OVER (PARTITION BY series ORDER BY period DESC)")).where(F.col("__rn") <= back)
    got = recent.groupBy("series").agg(F.count("*").alias("n"), F.max_by("value", "period").alias("level"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return got.where(F.col("n") >= least).select("series", E("CASE WHEN s = 0 THEN 0.0D ELSE (level - m) / s END").alias("zscore"), "level")
