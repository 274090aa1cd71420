"""Performance and prediction metrics. Time enters through windows; everything else is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions.expr import E

YEAR = 252


def equity_metrics(equity: DataFrame, key: str = "run_id") -> DataFrame:
    """A row a run, from (run, ts, equity): return, growth, volatility, Sharpe, Sortino, drawdown and Calmar; NULL where undefined."""
    w = f"PARTITION BY {key} ORDER BY ts"
    e = equity.select(key, "ts", "equity", E(f"equity / nullif(lag(equity, 1) OVER ({w}), 0) - 1").alias("r"), E(f"equity / max(equity) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1").alias("dd"))
    g = e.groupBy(key).agg(F.count("*").alias("n"), F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("z"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), E("stddev_samp(CASE WHEN r < 0 THEN r END)").alias("d"), F.min("dd").alias("max_drawdown"))
    g = g.withColumn("cagr", E(f"CASE WHEN n < 2 OR a <= 0 THEN NULL WHEN z / a <= 0 THEN -1.0D ELSE pow(z / a, {YEAR}.0D / (n - 1)) - 1 END"))
    return g.selectExpr(key, "CASE WHEN n >= 2 THEN z / nullif(a, 0) - 1 END AS total_return", "cagr", f"s * sqrt({YEAR}.0D) AS annualized_volatility", f"m / nullif(s, 0) * sqrt({YEAR}.0D) AS sharpe_ratio", f"m / nullif(d, 0) * sqrt({YEAR}.0D) AS sortino_ratio", "max_drawdown", "cagr / nullif(abs(max_drawdown), 0) AS calmar_ratio")


def benchmark_metrics(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """beta, alpha (a year) and information ratio from (run, r, b)."""
    g = returns.where("r IS NOT NULL AND b IS NOT NULL").groupBy(key).agg(F.covar_samp("r", "b").alias("c"), F.var_samp("b").alias("v"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), F.avg(E("r - b")).alias("ma"), F.stddev_samp(E("r - b")).alias("sa"))
    return g.selectExpr(key, "c / nullif(v, 0) AS beta", f"(mr - c / nullif(v, 0) * mb) * {YEAR} AS alpha", f"ma / nullif(sa, 0) * sqrt({YEAR}.0D) AS information_ratio")


def trade_metrics(trades: DataFrame, key: str = "run_id") -> DataFrame:
    """hit_rate, profit_factor (infinite without losses), avg_win, avg_loss from (run, pnl)."""
    g = trades.groupBy(key).agg(F.avg(E("CASE WHEN pnl > 0 THEN 1.0D ELSE 0.0D END")).alias("hit_rate"), E("coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0)").alias("w"), E("coalesce(-sum(CASE WHEN pnl < 0 THEN pnl END), 0)").alias("l"), E("avg(CASE WHEN pnl > 0 THEN pnl END)").alias("avg_win"), E("avg(CASE WHEN pnl < 0 THEN pnl END)").alias("avg_loss"))
    return g.selectExpr(key, "hit_rate", "CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN double('infinity') END AS profit_factor", "avg_win", "avg_loss")


def turnover(daily: DataFrame, key: str = "run_id") -> DataFrame:
    """Traded notional over mean equity a year, and mean gross exposure, from (run, notional, equity, gross)."""
    return daily.groupBy(key).agg(E(f"CASE WHEN avg(equity) > 0 THEN sum(notional) / avg(equity) / greatest(count(*) / {YEAR}.0D, 1e-9) END").alias("turnover"), F.avg("gross").alias("exposure"))


def average_ranks(df: DataFrame, cols: dict[str, str], by: list[str]) -> DataFrame:
    """Ranks with ties at their mean, within `by` (all rows if empty), by blocks of values: no task sorts a group."""
    df = df.select(*by, *[F.col(c) for c in df.columns if c not in by]).persist()  # read for the blocks, their totals and the ranks; lost parts are computed again
    cut = blocks.cuts(df, list(cols))
    for x, out in cols.items():
        df = blocks.ranks(df, x, {out: "true"}, by, cut[x])
    return df


#: Most distinct values whose counts are summed by one task.
ONE_TASK = 1_000_000


def value_ranks(df: DataFrame, x: str, out: str, one_task: int = ONE_TASK, blocks: int = 64) -> DataFrame:
    """(x, out): the mean rank of each distinct value among all rows. Counts of up to `one_task` values are summed in value order by one
    task; of more, by blocks between quantiles, after the blocks' totals, so that no task sorts all values. There are as many blocks as
    it takes for each to hold half of `one_task` values."""
    counts = df.groupBy(x).agg(F.count("*").alias("__n")).persist()  # read several times; lost parts are computed again
    distinct = counts.count()
    blocks = max(blocks, -(-2 * distinct // max(1, one_task)))
    if distinct <= one_task:
        return counts.select(x, (F.sum("__n").over(Window.orderBy(x)) - (F.col("__n") - 1) / F.lit(2.0)).alias(out))
    edges = sorted(set(counts.approxQuantile(x, [i / blocks for i in range(1, blocks)], min(0.005, 0.1 / blocks))))

    def block(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col(x) <= F.lit(float(edges[mid])), block(lo, mid)).otherwise(block(mid + 1, hi))

    counts = counts.withColumn("__b", block(0, len(edges)))
    before = counts.groupBy("__b").agg(F.sum("__n").alias("__t")).withColumn("__before", E("coalesce(sum(__t) OVER (ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    got = counts.join(F.broadcast(before.select("__b", "__before")), "__b").withColumn("__run", E(f"sum(__n) OVER (PARTITION BY __b ORDER BY {x})"))
    return got.select(x, (F.col("__before") + F.col("__run") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))


_CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


def rank_ic(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """by..., n, rank_ic: Spearman's correlation over rows that have both; NULL below 3 rows or where a side is constant. Pooled if `by` is empty."""
    by = by or []
    rows = df.where(f"{truth} IS NOT NULL AND {pred} IS NOT NULL").select(*by, F.col(truth).cast("double").alias("__y"), F.col(pred).cast("double").alias("__p"))
    ranked = average_ranks(rows, {"__y": "__ry", "__p": "__rp"}, by)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), E(_CORR.format("__ry", "__rp")).alias("__c")).select(*by, "n", E("CASE WHEN n >= 3 THEN __c END").alias("rank_ic"))


def regression_eval(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """n, rmse, mae, r2."""
    by = by or []
    rows = df.where(f"{truth} IS NOT NULL AND {pred} IS NOT NULL").selectExpr(*by, f"{truth} AS y", f"{pred} AS p")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(E("pow(y - p, 2)")).alias("mse"), F.avg(E("abs(y - p)")).alias("mae"), F.var_pop("y").alias("v"))
    return g.selectExpr(*by, "n", "sqrt(mse) AS rmse", "mae", "CASE WHEN n > 1 THEN 1 - mse / nullif(v, 0) END AS r2")


def classification_eval(df: DataFrame, truth: str, prob: str) -> DataFrame:
    """n, auc (from mean ranks; NULL for one class), accuracy, log_loss, brier_score."""
    rows = df.where(f"{truth} IS NOT NULL AND {prob} IS NOT NULL").selectExpr(f"{truth} AS y", f"greatest(1e-6, least(1 - 1e-6, {prob})) AS p")
    ranked = average_ranks(rows, {"p": "__r"}, [])
    g = ranked.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum(E("CASE WHEN y = 1 THEN __r END")).alias("rs"), F.avg(E("CASE WHEN (p > 0.5) = (y = 1) THEN 1.0D ELSE 0.0D END")).alias("accuracy"), F.avg(E("-(y * ln(p) + (1 - y) * ln(1 - p))")).alias("log_loss"), F.avg(E("pow(p - y, 2)")).alias("brier_score"))
    return g.selectExpr("n", "(rs - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0) AS auc", "accuracy", "log_loss", "brier_score")


def calibration_curve(df: DataFrame, truth: str, prob: str, bins: int = 10, rows: int | None = None) -> DataFrame:
    """bin, mean_predicted, mean_realised, count over exact quantile bins, closed to the right, equal edges merged. Edges come from blocks of
    probabilities, of which only those that hold an edge are sorted; bins are one aggregation. rows: how many rows there are, counted if not given."""
    got = df.where(f"{truth} IS NOT NULL AND {prob} IS NOT NULL").select(F.col(prob).cast("double").alias("x"), F.col(truth).cast("double").alias("y")).persist()
    edges = blocks.quantiles(got, ["x"], [i / bins for i in range(bins + 1)], blocks.cuts(got, ["x"], rows))["x"]
    e = F.array(*[F.lit(v) for v in sorted(set(edges))]).cast("array<double>")
    binned = got.withColumn("bin", F.greatest(F.size(F.filter(e, lambda v: v < F.col("x"))), F.lit(1)))
    return binned.groupBy("bin").agg(F.avg("x").alias("mean_predicted"), F.avg("y").alias("mean_realised"), F.count("*").alias("count"))


def quantile_portfolio(df: DataFrame, truth: str, pred: str, share: float = 0.2) -> DataFrame:
    """ts, gross_return, turnover of a long-short book of each date's top and bottom shares; dates too thin for both are left out."""
    rows = df.where(f"{truth} IS NOT NULL AND {pred} IS NOT NULL").selectExpr("symbol", "ts", f"{truth} AS y", f"{pred} AS p")
    rows = rows.selectExpr("*", "count(*) OVER (PARTITION BY ts) AS n", "row_number() OVER (PARTITION BY ts ORDER BY p DESC, symbol) AS hi", "row_number() OVER (PARTITION BY ts ORDER BY p, symbol DESC) AS lo")
    rows = rows.withColumn("k", E(f"greatest(1, CAST(floor(n * {share}) AS INT))")).where("n >= 2 * k AND (hi <= k OR lo <= k)")
    book = rows.groupBy("ts").agg(F.first("k").alias("k"), E("avg(CASE WHEN hi <= k THEN y END)").alias("l"), E("avg(CASE WHEN lo <= k THEN y END)").alias("s"), E("collect_set(CASE WHEN hi <= k THEN symbol END)").alias("longs"), E("collect_set(CASE WHEN lo <= k THEN symbol END)").alias("shorts"))
    w = "OVER (ORDER BY ts)"  # one row a date
    changed = lambda c: f"size(array_except({c}, lag({c}, 1) {w})) + size(array_except(lag({c}, 1) {w}, {c}))"
    return book.selectExpr("ts", "0.5 * l - 0.5 * s AS gross_return", f"CASE WHEN lag(ts, 1) {w} IS NULL THEN 1.0D ELSE ({changed('longs')} + {changed('shorts')}) / (2.0D * k) END AS turnover")


def cost_stress(returns: DataFrame, grid: tuple[float, ...] = (0, 5, 10, 20, 30, 50)) -> DataFrame:
    """cost_bps, net_sharpe, mean_net_return of (gross_return, turnover) at each cost."""
    got = returns.select(F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("cost_bps"), "gross_return", "turnover").withColumn("net", E("gross_return - turnover * cost_bps / 10000"))
    return got.groupBy("cost_bps").agg(E(f"avg(net) / nullif(stddev_samp(net), 0) * sqrt({YEAR}.0D)").alias("net_sharpe"), F.avg("net").alias("mean_net_return"))


def delay_stress(df: DataFrame, truth: str, pred: str, delays: tuple[int, ...] = (0, 1, 2, 3, 5, 10)) -> DataFrame:
    """delay_days, rank_ic, n with predictions that come each number of a symbol's rows late. Truths are ranked for all delays at once, before
    rows are multiplied by the delays."""
    w = "OVER (PARTITION BY symbol ORDER BY ts)"
    late = df.select(F.col(truth).alias("y"), *[E(f"lag({pred}, {d}) {w}").alias(f"d{d}") for d in delays])
    late = late.where("y IS NOT NULL AND coalesce(" + ", ".join(f"d{d}" for d in delays) + ") IS NOT NULL").persist()
    names = [f"d{d}" for d in delays]
    cut = blocks.cuts(late, ["y", names[0]])
    ranked = blocks.ranks(late, "y", {f"r{d}": f"d{d} IS NOT NULL" for d in delays}, [], cut["y"])
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("delay_days"), F.col(f"d{d}").alias("p"), F.col(f"r{d}").alias("ry")) for d in delays])).alias("x")
    long = ranked.select(each).select("x.*").where("p IS NOT NULL")
    # The late predictions are all one series, but for its ends: its blocks serve all delays.
    ranked = blocks.ranks(long, "p", {"rp": "true"}, ["delay_days"], cut[names[0]])
    got = ranked.groupBy("delay_days").agg(E(_CORR.format("ry", "rp")).alias("__c"), F.count("*").alias("n"))
    return got.select("delay_days", E("CASE WHEN n >= 3 THEN __c END").alias("rank_ic"), "n")


def factor_exposure(df: DataFrame, pred: str, factors: list[str]) -> DataFrame:
    """factor, loading, r_squared of the least-squares fit of the standardised prediction on standardised factors. The products'
    sums are one aggregation; the small system is solved on the driver."""
    import numpy as np

    cols = [pred, *factors]
    rows = df.dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = rows.agg(F.count("*").alias("n"), *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    spark = df.sparkSession
    schema = "factor string, loading double, r_squared double"
    if got["n"] < len(factors) + 2:
        return spark.createDataFrame([], schema)
    c = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        c[i, j] = c[j, i] = got[f"c{i}_{j}"]
    s = np.sqrt(np.diag(c))
    s[s == 0] = 1
    c = c / np.outer(s, s)
    b = np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=None)[0]
    r2 = float(b @ c[1:, 0] / c[0, 0]) if c[0, 0] else None
    return spark.createDataFrame([("intercept", 0.0, r2), *[(f, float(x), r2) for f, x in zip(factors, b, strict=True)]], schema)
