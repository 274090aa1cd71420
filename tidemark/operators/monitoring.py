"""Operations of a running service: validation flags, ingestion runs, the kill switch, rolling statistics, read views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import E, framed

#: What must hold of a bar: name, test, severity.
BAR_RULES = [
    ("positive_prices", "open > 0 AND high > 0 AND low > 0 AND close > 0", "ERROR"), ("high_not_below_low", "high >= low", "ERROR"), ("close_within_range", "close BETWEEN low AND high", "WARNING"),
    ("open_within_range", "open BETWEEN low AND high", "WARNING"), ("volume_not_negative", "volume >= 0", "ERROR"),
]


def quality_flags(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str]] = BAR_RULES) -> DataFrame:
    """A row for each rule that a row breaks: keys, rule, severity. A test of missing values is broken. One pass over the rows."""
    broken = F.array(*[F.when(~F.coalesce(E(test), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, test, severity in rules])
    return df.select(*keys, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def severity_counts(flags: DataFrame, by: list[str]) -> DataFrame:
    return flags.groupBy(*by).agg(F.count("*").alias("n"))


def finished(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs (started as FAILED) with the status, records and error of their results, where there are any."""
    got = runs.drop("status", "records", "error").join(results, "run_id", "left")
    return got.withColumn("status", F.coalesce("status", F.lit("FAILED"))).withColumn("records", F.coalesce("records", F.lit(0)))


def ingestion_status(primary_rows: int, secondary_rows: int) -> str:
    """FAILED if both sources are empty, PARTIAL if one is."""
    return "FAILED" if not primary_rows and not secondary_rows else "SUCCESS" if primary_rows and secondary_rows else "PARTIAL"


def engaged(switch: DataFrame | None) -> bool:
    """Whether the kill switch is on, from its log (ts, engaged); off before its first entry."""
    rows = switch.orderBy(F.desc("ts")).limit(1).collect() if switch is not None else []
    return bool(rows and rows[0]["engaged"])


def engaged_by(log: DataFrame, key: str) -> DataFrame:
    """key, engaged: the newest entry of each key's log (key, ts, engaged)."""
    return log.groupBy(key).agg(F.max_by("engaged", "ts").alias("engaged"))


def rolling_sharpe(equity: DataFrame, n: int = 63, key: str = "run_id") -> DataFrame:
    """run, ts, sharpe over the last n returns, once there are n."""
    w = f"OVER (PARTITION BY {key} ORDER BY ts)"
    e = equity.select(key, "ts", E(f"equity / nullif(lag(equity, 1) {w}, 0) - 1").alias("r"))
    return e.select(key, "ts", E(f"({framed('avg', 'r', n, key=key)}) / nullif({framed('stddev_samp', 'r', n, key=key)}, 0) * sqrt(252.0)").alias("sharpe"))


def view(df: DataFrame, equal: dict | None = None, since: tuple[str, object] | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """A read view: rows with given values, from a time on, the newest first."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).isin(list(v) if isinstance(v, (list, tuple, set)) else [v]))
    if since:
        df = df.where(F.col(since[0]) >= F.lit(since[1]))
    df = df.orderBy(F.desc(order)) if order else df
    return df.limit(limit) if limit else df


def wide_macro(history: DataFrame) -> DataFrame:
    """series -> value of the latest period, as one map."""
    last = history.groupBy("series").agg(F.max_by("value", "period").alias("value"))
    return last.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series", "value")))).alias("values"))
