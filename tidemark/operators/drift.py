"""How far the distribution of features has moved from a reference, for any number of features at once.

Both sides are read once and held in the executors' memory or on their disks; what is lost is computed again. Of up to ONE_TASK rows, the counts
of each distinct value of each feature (`steps`) and their running sums give quantile edges, bins, distribution functions and spread. Of more, rows
go by blocks of values (`functions.blocks`), so that no task holds all values of a feature: edges sort only the blocks that they lie in, bins are one
aggregation, and distribution functions one shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions.expr import E

#: Most rows whose counts are summed by one task a feature.
ONE_TASK = 1_000_000


def long(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, x: the values that are there."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    return df.select(F.explode(pairs).alias("__p")).select("__p.*").where("x IS NOT NULL")


def steps(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """feature, x, r, c: how often each value occurs on either side."""
    both = long(reference, features).withColumn("ref", F.lit(1)).union(long(current, features).withColumn("ref", F.lit(0)))
    return both.groupBy("feature", "x").agg(F.sum("ref").alias("r"), F.sum(E("1 - ref")).alias("c")).persist()


def cumulative(counts: DataFrame, rows: int | None = None) -> DataFrame:
    """`counts` (feature, x, r, c) with sums up to each value, cr and cc, and the next value, after. rows: how many values there
    are at most, if it is known; beyond ONE_TASK sums go by blocks."""
    if rows is None or rows <= ONE_TASK:
        w = "OVER (PARTITION BY feature ORDER BY x)"
        return counts.selectExpr("*", f"sum(r) {w} AS cr", f"sum(c) {w} AS cc", f"lead(x, 1) {w} AS after")
    blocks = max(2, -(-rows // ONE_TASK) * 4)
    cuts = counts.groupBy("feature").agg(E(f"array_distinct(approx_percentile(x, array({', '.join(f'{i / blocks}D' for i in range(1, blocks))}), 10000))").alias("cuts"))
    dealt = counts.join(F.broadcast(cuts), "feature").withColumn("b", E("size(filter(cuts, v -> v < x))")).drop("cuts")
    totals = dealt.groupBy("feature", "b").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"), F.min("x").alias("first"))
    before = "OVER (PARTITION BY feature ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = totals.selectExpr("feature", "b", f"coalesce(sum(tr) {before}, 0) AS br", f"coalesce(sum(tc) {before}, 0) AS bc", "lead(first, 1) OVER (PARTITION BY feature ORDER BY b) AS following")
    w = "OVER (PARTITION BY feature, b ORDER BY x)"
    got = dealt.join(F.broadcast(totals), ["feature", "b"])
    return got.selectExpr("feature", "x", "r", "c", f"br + sum(r) {w} AS cr", f"bc + sum(c) {w} AS cc", f"coalesce(lead(x, 1) {w}, following) AS after")


def edges_of(counts: DataFrame, bins: int, rows: int | None = None) -> DataFrame:
    """feature, n, m, e: the exact quantiles of the reference at 0, 1/bins, ..., 1, distinct ones. rows: as in cumulative(); of few values
    the quantiles are an aggregation, of many they are looked up in the running sums."""
    if rows is None or rows <= ONE_TASK:
        at = ", ".join(f"{i / bins}D" for i in range(bins + 1))
        few = counts.groupBy("feature").agg(F.sum("r").alias("n"), F.sum("c").alias("m"), E(f"coalesce(array_distinct(percentile(x, array({at}), r)), CAST(array() AS ARRAY<DOUBLE>))").alias("e"))
        return few.sparkSession.createDataFrame(few.collect(), few.schema)  # a row a feature
    cum = cumulative(counts, rows)
    totals = cum.groupBy("feature").agg(F.max("cr").alias("n"), F.max("cc").alias("m"))
    asked = totals.select("feature", "n", "m", F.explode(E(f"transform(sequence(0, {bins}), i -> struct(i AS i, (greatest(n, 1) - 1) * (i / {bins}.0D) AS at))")).alias("q"))
    asked = asked.selectExpr("feature", "n", "m", "q.i AS i", "q.at - floor(q.at) AS share", "floor(q.at) AS lo", "ceil(q.at) AS hi")
    near = cum.where("r > 0").join(F.broadcast(asked), "feature").where("cr > lo AND cr - r <= hi")
    ends = near.groupBy("feature", "n", "m", "i", "share").agg(F.min("x").alias("a"), F.max("x").alias("z"))
    got = ends.groupBy("feature").agg(F.array_sort(F.collect_set(E("a + (z - a) * share"))).alias("e"))
    few = totals.join(got, "feature", "left").selectExpr("feature", "n", "m", "CAST(coalesce(e, array()) AS ARRAY<DOUBLE>) AS e")
    return few.sparkSession.createDataFrame(few.collect(), few.schema)  # a row a feature


def _psi(counts: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    inside = counts.join(F.broadcast(edges), "feature").where("size(e) >= 3 AND x >= e[0] AND x <= element_at(e, -1)")
    binned = inside.groupBy("feature", E("least(size(filter(e, v -> v <= x)), size(e) - 1)").alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    total = "OVER (PARTITION BY feature)"
    grid = edges.select("feature", F.explode(E("sequence(1, greatest(size(e) - 1, 1))")).alias("bin")).join(binned, ["feature", "bin"], "left")
    share = lambda k: f"greatest(coalesce({k}, 0) / greatest(sum(coalesce({k}, 0)) {total}, 1), 1e-6)"
    terms = grid.select("feature", E(share("r")).alias("p"), E(share("c")).alias("q"))
    got = terms.groupBy("feature").agg(F.sum(E("(q - p) * ln(q / p)")).alias("psi"))
    return edges.join(got, "feature", "left").select("feature", E(f"CASE WHEN n < {bins} OR m < 1 OR size(e) < 3 THEN 0.0D ELSE psi END").alias("psi"))


def _held(reference: DataFrame, current: DataFrame, features: list[str], rows: int | None) -> tuple[DataFrame, bool]:
    """(the features of both sides with ref, whether they are more than one task may hold)."""
    side = lambda df, ref: df.select(*[F.col(c).cast("double").alias(c) for c in features], F.lit(ref).alias("ref"))
    both = side(reference, 1).union(side(current, 0)).persist()
    return both, (both.count() if rows is None else rows) > ONE_TASK


def _steps(both: DataFrame, features: list[str]) -> DataFrame:
    return steps(both.where("ref = 1"), both.where("ref = 0"), features)


def _edges(both: DataFrame, features: list[str], bins: int, cut: dict[str, blocks.Cut]) -> DataFrame:
    """As edges_of(), of rows by blocks."""
    n = both.groupBy().agg(*[F.count(F.when(F.col("ref") == ref, F.col(c))).alias(f"{k}{i}") for i, c in enumerate(features) for ref, k in ((1, "n"), (0, "m"))]).first()
    got = blocks.quantiles(both.where("ref = 1"), features, [i / bins for i in range(bins + 1)], cut)
    return both.sparkSession.createDataFrame([(c, n[f"n{i}"], n[f"m{i}"], sorted(set(got[c]))) for i, c in enumerate(features) if n[f"n{i}"] or n[f"m{i}"]], "feature string, n bigint, m bigint, e array<double>")


def _each(both: DataFrame, features: list[str]) -> DataFrame:
    """feature, x, r, c, a row a value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features])
    return both.select(F.explode(pairs).alias("p"), "ref").where("p.x IS NOT NULL").selectExpr("p.feature AS feature", "p.x AS x", "CAST(ref AS BIGINT) AS r", "CAST(1 - ref AS BIGINT) AS c")


def psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10, rows: int | None = None) -> DataFrame:
    """feature, psi over the reference's quantile bins; current values outside them don't count; 0 if there are too few values."""
    both, many = _held(reference, current, features, rows)
    if many:
        return _psi(_each(both, features), _edges(both, features, bins, blocks.cuts(both, features)), bins)
    counts = _steps(both, features)
    return _psi(counts, edges_of(counts, bins), bins)


def _p_value(d: str) -> str:
    """The asymptotic two-sided p-value of the Kolmogorov-Smirnov distance."""
    s = f"({d} * sqrt(n * m / CAST(n + m AS DOUBLE)))"
    terms = " + ".join(f"{'-' if k % 2 == 0 else ''}2 * exp(-2 * {k * k} * {s} * {s})" for k in range(1, 21))
    return f"CASE WHEN {s} < 0.2 THEN 1.0D ELSE greatest(0.0D, least(1.0D, {terms})) END"


def _distances(cum: DataFrame, totals: DataFrame) -> DataFrame:
    g = cum.join(F.broadcast(totals.select("feature", "n", "m")), "feature").withColumn("gap", E("abs(cr / CAST(nullif(n, 0) AS DOUBLE) - cc / CAST(nullif(m, 0) AS DOUBLE))"))
    g = g.groupBy("feature").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("gap").alias("d"), F.sum(E("gap * (after - x)")).alias("w"))
    ok = "n >= 2 AND m >= 2"
    return g.selectExpr("feature", f"CASE WHEN {ok} THEN d ELSE 0.0D END AS ks_statistic", f"CASE WHEN {ok} THEN {_p_value('d')} ELSE 1.0D END AS ks_p_value", "coalesce(w, 0.0D) AS wasserstein")


def ks_wasserstein(reference: DataFrame, current: DataFrame, features: list[str], rows: int | None = None) -> DataFrame:
    """feature, ks_statistic, ks_p_value (asymptotic), wasserstein; 0, 1 and 0 where a side is missing."""
    both, many = _held(reference, current, features, rows)
    counts = _each(both, features) if many else _steps(both, features)
    totals = counts.groupBy("feature").agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    return _distances(blocks.running(both, features, "ref", blocks.cuts(both, features)) if many else cumulative(counts), totals)


def drift_report(reference: DataFrame, current: DataFrame, features: list[str], psi_limit: float = 0.25, p_limit: float = 0.01, distance_limit: float = 2.0, rows: int | None = None) -> DataFrame:
    """All statistics, whether a feature is flagged, and why."""
    both, many = _held(reference, current, features, rows)
    if many:
        cut = blocks.cuts(both, features)
        counts, cum, edges = _each(both, features), blocks.running(both, features, "ref", cut), _edges(both, features, 10, cut)
    else:
        counts = _steps(both, features)
        cum, edges = cumulative(counts), edges_of(counts, 10)
    means = counts.groupBy("feature").agg(E("sum(r * x) / nullif(sum(r), 0)").alias("mean"), F.sum("r").alias("k"))
    spread = counts.join(F.broadcast(means), "feature").groupBy("feature").agg(E("sqrt(sum(r * (x - mean) * (x - mean)) / nullif(max(k) - 1, 0))").alias("sd"))
    got = _psi(counts, edges, 10).join(_distances(cum, edges), "feature").join(spread, "feature", "left")
    reasons = E(f"filter(array(CASE WHEN psi > {psi_limit} THEN 'psi' END, CASE WHEN ks_p_value < {p_limit} THEN 'ks' END, CASE WHEN sd > 0 AND wasserstein > {distance_limit} * sd THEN 'wasserstein' END), x -> x IS NOT NULL)")
    return got.withColumn("reasons", F.array_join(reasons, ",")).drop("sd").withColumn("flagged", F.col("reasons") != "")


def performance_drift(recent: float, reference: float, limit: float = 0.5) -> bool:
    """Whether an information coefficient has dropped by more than a share of its reference; without one, whether it is negative."""
    if not reference or math.isnan(reference):
        return recent < 0
    return (reference - recent) / abs(reference) > limit
