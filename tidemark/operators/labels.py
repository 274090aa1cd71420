"""Targets, the trading calendar, and what keeps training rows clear of the rows they are tested on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import E

HORIZON, EMBARGO = 20, 5


def with_targets(df: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """`df` (symbol, ts, close, ...) with excess_return_<n>d and positive_<n>d: forward returns in each side's own rows, less the benchmark's
    of the date. The benchmark is one row a date: its window is over dates, and it is broadcast, so that rows stay where their symbol is."""
    lead = lambda n, w: f"lead(close, {n}) OVER ({w}) / nullif(close, 0) - 1"
    own = df.select("*", *[E(lead(n, "PARTITION BY symbol ORDER BY ts")).alias(f"__f{n}") for n in horizons])
    other = benchmark.select("ts", *[E(lead(n, "ORDER BY ts")).alias(f"__b{n}") for n in horizons])
    both = own.join(F.broadcast(other), "ts", "left").select(*df.columns, *[E(f"__f{n} - __b{n}").alias(f"excess_return_{n}d") for n in horizons])
    return both.select("*", *[E(f"CASE WHEN excess_return_{n}d > 0 THEN 1.0D WHEN excess_return_{n}d IS NOT NULL THEN 0.0D END").alias(f"positive_{n}d") for n in horizons])


def forward_targets(bars: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """symbol, ts and the targets of `with_targets`."""
    return with_targets(bars.select("symbol", "ts", "close"), benchmark, horizons).drop("close")


def trading_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts, day: the distinct times, numbered from 0."""
    return df.select(ts).distinct().withColumn("day", E(f"row_number() OVER (ORDER BY {ts}) - 1"))


def eligible(days: DataFrame, start: int, end: int, last: int, horizon: int = HORIZON, embargo: int = EMBARGO) -> Column:
    """Whether a row may train when days start..end are evaluated: its target must end before them, and it must not lie in the
    embargo after them. In ordinals of the calendar, whose last day is `last`."""
    d = days["day"]
    overlaps = (F.least(d + horizon, F.lit(last)) >= start) & (d <= end)
    return ~(overlaps | ((d > end) & (d <= min(end + embargo, last))))


def purge_mask(df: DataFrame, start, end, horizon: int = HORIZON, embargo: int = EMBARGO, ts: str = "ts") -> DataFrame:
    """`df` with eligible, for an evaluation window from `start` to `end` (times). The calendar is distinct dates."""
    cal = trading_calendar(df, ts)
    a, b, last = cal.agg(F.min(F.when(F.col(ts) >= start, F.col("day"))), F.min(F.when(F.col(ts) >= end, F.col("day"))), F.max("day")).first()
    a, b = (last if x is None else x for x in (a, b))
    got = df.join(F.broadcast(cal), ts)  # a row a date
    return got.withColumn("eligible", ~(((F.least(F.col("day") + horizon, F.lit(last)) >= a) & (F.col(ts) <= end)) | ((F.col(ts) > end) & (F.col("day") <= min(b + embargo, last))))).drop("day")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: int
    validation_start: int
    validation_end: int


def purged_folds(days: int, initial: int, validation: int, step: int | None = None, rolling: int | None = None) -> list[Fold]:
    """Folds over a calendar of `days`, in ordinals: training grows from the start, or rolls over the last `rolling` days."""
    out, end = [], initial - 1
    while end + validation < days:
        out.append(Fold(len(out), 0 if rolling is None else max(0, end - rolling + 1), end + 1, end + validation))
        end += step or validation
    return out


def expanding_folds(first: int, last_train: int, last: int) -> list[tuple[int, int]]:
    """(last year of training, year of validation), a year at a time."""
    return [(y, y + 1) for y in range(max(first, last_train), last)]


def fold_table(calendar: DataFrame, folds: list[Fold]) -> DataFrame:
    """Folds with their dates."""
    spark = calendar.sparkSession
    rows = spark.createDataFrame([(f.fold, f.train_start, f.validation_start, f.validation_end) for f in folds], "fold int, a int, b int, c int")
    names = {"a": "train_start", "b": "validation_start", "c": "validation_end"}
    for k, name in names.items():
        day = calendar.select(F.col("day").alias(k), F.col("ts").alias(name))
        rows = rows.join(day, k).drop(k)
    return rows.select("fold", *names.values())


def partition(df: DataFrame, start, end, horizon: int = HORIZON, embargo: int = EMBARGO, ts: str = "ts") -> DataFrame:
    """`df` with region: development (before, and eligible), purged (before, but not), holdout, or post."""
    got = purge_mask(df, start, end, horizon, embargo, ts)
    region = F.when(F.col(ts).between(start, end), "holdout").when(F.col(ts) > end, "post").when(F.col("eligible"), "development").otherwise("purged")
    return got.withColumn("region", region).drop("eligible")


def assert_clear(folds: DataFrame, holdout_start) -> None:
    """No fold may reach the holdout, or validate before it has trained."""
    bad = folds.where((F.col("validation_end") >= holdout_start) | (F.col("train_start") >= F.col("validation_start")))
    if bad.limit(1).count():
        raise ValueError("a fold reaches into the holdout or overlaps itself")


def outcomes(predictions: DataFrame, bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Realised excess returns, volatility of the 20 returns ahead and the time of completion, for predictions whose symbol has 20 more bars."""
    w = "OVER (PARTITION BY symbol ORDER BY ts)"
    r = bars.select("*", E(f"close / nullif(lag(close, 1) {w}, 0) - 1").alias("__r"))
    ahead = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
    path = r.selectExpr("symbol", "ts", f"stddev_samp(__r) {ahead} * sqrt(252.0D) AS realised_volatility", f"lead(ts, 20) {w} AS completed")
    got = predictions.join(forward_targets(bars, benchmark), ["symbol", "ts"]).join(path, ["symbol", "ts"])
    return got.where("excess_return_20d IS NOT NULL").select("prediction_id", F.col("excess_return_5d").alias("realised_excess_return_5d"), F.col("excess_return_20d").alias("realised_excess_return_20d"), "realised_volatility", "completed")
