"""Point-in-time joins: what was known at a time, by publication, never by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import E


def latest_asof(df: DataFrame, keys: list[str], order: list[str], as_of: Column | None = None, published: str = "published") -> DataFrame:
    """The last row of each key, by `order` descending, among those published at or before `as_of` (all, if not given).

    An aggregate of a struct rather than a sort: it is combined before the shuffle, so a key of any size is one row by then."""
    known = df if as_of is None else df.where(F.col(published) <= as_of)
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = known.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*keys, "__top.*").select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, published: str, cols: dict[str, str]) -> DataFrame:
    """Each row of `left` with `cols` (name in right: name in the result) of the last row of `right` with equal `by` that was
    published at or before `ts`; NULL if there is none. Both sides go through one shuffle by key and one sort; rows of
    `right` come before those of `left` of the same time. The right side's columns are carried along as one struct."""
    payload = F.struct(*[F.col(a).alias(b) for a, b in cols.items()])
    names = left.columns
    one = left.select(F.struct(*names).alias("__row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(ts).alias("__ts"), F.lit(1).alias("__side"))
    two = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(published).alias("__ts"), F.lit(0).alias("__side"), payload.alias("__value"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = one.unionByName(two, allowMissingColumns=True).withColumn("__seen", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return got.select(*[F.col(f"__row.{c}").alias(c) for c in names], *[F.col(f"__seen.{b}").alias(b) for b in cols.values()])


def members_at(panel: DataFrame, membership: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of `panel` (symbol, ts) that belong to the universe then: start_ts <= ts < end_ts, or no end. Overlapping
    memberships don't repeat a row."""
    m = membership.select(F.col("symbol").alias("__s"), "start_ts", "end_ts")
    inside = (panel.symbol == m["__s"]) & (m.start_ts <= panel[ts]) & (m.end_ts.isNull() | (m.end_ts > panel[ts]))
    return panel.join(m, inside, "left_semi")


#: Hours of the look-back windows, weights of source tiers.
WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "3d": 72, "7d": 168}
TIERS = {"TIER_1_OFFICIAL": 1.0, "TIER_2_MAJOR": 0.85, "TIER_3_SECONDARY": 0.6, "TIER_4_SOCIAL": 0.3}
UNKNOWN_TIER = 0.1


def lookback_pairs(points: DataFrame, articles: DataFrame, days: int, ts: str = "ts", with_uncertain: bool = False) -> DataFrame:
    """(point, article) pairs with t - days <= published <= t. A range join by day: a point goes to the days that it looks
    back on, so that the equality on symbol and day does the work, whatever the number of articles of a symbol."""
    known = articles if with_uncertain else articles.where("published is not null and not uncertain")
    p = points.withColumn("__day", F.explode(F.sequence(F.to_date(ts) - E(f"INTERVAL {days} DAYS"), F.to_date(ts), E("INTERVAL 1 DAY"))))
    a = known.withColumn("__day", F.to_date("published"))
    return p.join(a, ["symbol", "__day"]).where((F.col("published") <= F.col(ts)) & (F.col("published") >= F.col(ts) - E(f"INTERVAL {days} DAYS"))).drop("__day")


def news_counts(points: DataFrame, articles: DataFrame, ts: str = "ts") -> DataFrame:
    """Numbers of articles within each window, their weighted number within 7 days and hours since the last one; a point
    without articles has zeros and NULL.

    Points and articles go through one shuffle and one sort by symbol and week, where range windows count; there are no pairs. An
    article is in the week that it was published in and in the next, as far as the longest window reaches back, so a symbol with
    much news is as many groups as it has weeks."""
    week, most = 7 * 86_400_000_000, max(WINDOWS.values())
    if most * 3_600_000_000 > week:
        raise ValueError("a window is longer than a week")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("tier")], F.lit(UNKNOWN_TIER))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.floor(F.col("__t") / week)
    a = articles.where("published is not null and not uncertain").select("symbol", micros("published").alias("__t"), weight.alias("__w"), F.lit(1).alias("__n"))
    a = a.withColumn("__week", F.explode(F.array(own, own + 1)))
    p = points.select("symbol", F.col(ts), micros(ts).alias("__t"), F.lit(0).alias("__n")).withColumn("__week", own)
    both = p.unionByName(a, allowMissingColumns=True)
    over = Window.partitionBy("symbol", "__week").orderBy("__t")
    back = lambda h: over.rangeBetween(-h * 3_600_000_000, 0)
    counts = [F.sum("__n").over(back(h)).cast("double").alias(f"n_articles_{k}") for k, h in WINDOWS.items()]
    last = F.max(F.when(F.col("__n") == 1, F.col("__t"))).over(back(most))
    got = both.select("symbol", ts, "__n", *counts, F.coalesce(F.sum("__w").over(back(168)), F.lit(0.0)).alias("source_weighted_count_7d"), ((F.col("__t") - last) / 3.6e9).alias("hours_since_last_article"))
    return got.where("__n = 0").drop("__n")


def reconcile(primary: DataFrame, secondary: DataFrame, keys: list[str], minor: float = 0.005, major: float = 0.02, carry: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """keys, both closes, their relative difference, the status and the canonical close (the primary's, else the secondary's). carry: columns
    of either side that come along."""
    p, s = primary.select(*keys, F.col("close").alias("primary_close"), *carry[0]), secondary.select(*keys, F.col("close").alias("secondary_close"), *carry[1])
    got = p.join(s, keys, "full_outer").withColumn("difference", E("CASE WHEN primary_close = 0 THEN double('infinity') ELSE abs(secondary_close - primary_close) / abs(nullif(primary_close, 0)) END"))
    status = E(f"CASE WHEN primary_close IS NULL THEN 'PRIMARY_MISSING' WHEN secondary_close IS NULL THEN 'SECONDARY_MISSING' WHEN difference <= {minor} THEN 'VALIDATED' WHEN difference <= {major} THEN 'MINOR_DIFFERENCE' ELSE 'MAJOR_DIFFERENCE' END")
    return got.withColumn("status", status).withColumn("canonical_close", F.coalesce("primary_close", "secondary_close"))


def tradable(reconciled: DataFrame, allow_major: bool = False) -> DataFrame:
    return reconciled if allow_major else reconciled.where("status <> 'MAJOR_DIFFERENCE'")


def pending(predictions: DataFrame, outcomes: DataFrame, as_of: Column, horizon_days: int) -> DataFrame:
    """Predictions without an outcome that are at least `horizon_days` calendar days old."""
    old = predictions.where(F.col("ts") <= as_of - E(f"INTERVAL {horizon_days} DAYS"))
    return old.join(outcomes, "prediction_id", "left_anti")


def new_articles(articles: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Articles whose key isn't known yet, the first of each key."""
    fresh = articles.join(known.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct("published", "article_id")).alias("__x")).select(key, F.col("__x.article_id").alias("article_id"), F.col("__x.published").alias("published"))


def observed_sums(events: DataFrame, observations: DataFrame, times: DataFrame) -> DataFrame:
    """category, ts, total, n: the sum of the probabilities of a category's events, each as last observed at ts, and how many there are, from
    events (event_id, category), observations (event_id, observed, probability; of one time the greatest) and times (ts), which are few.

    An observation goes to the first time at or after it, and the last of an event there stands until the event's next: events are shuffled as
    often as they are observed, not once a time, and times meet them after that, within one task and summed there."""
    grid = sorted(x[0] for x in times.select("ts").distinct().where("ts IS NOT NULL").collect())
    days = observations.select("observed").distinct()
    at = F.array(*[F.lit(t.isoformat(sep=" ")) for t in grid]).cast("array<timestamp_ntz>")
    place = days.select("observed", F.size(F.filter(at, lambda t: t < F.col("observed"))).alias("__i")).where(F.col("__i") < len(grid))
    known = observations.join(F.broadcast(place) if place.count() <= 1_000_000 else place, "observed").repartition("event_id")
    last = known.groupBy("event_id", "__i", "observed").agg(F.max("probability").alias("p")).groupBy("event_id", "__i").agg(F.max_by("p", "observed").alias("p"))
    held = last.selectExpr("event_id", "__i", "p", f"lead(__i, 1, {len(grid)}) OVER (PARTITION BY event_id ORDER BY __i) - 1 AS __z").where("p IS NOT NULL")
    sums = held.join(events.select("event_id", "category"), "event_id").select("category", "p", F.explode(F.sequence("__i", "__z")).alias("__i")).groupBy("category", "__i").agg(F.sum("p").alias("total"), F.count("*").alias("n"))
    return sums.select("category", F.element_at(at, F.col("__i") + 1).alias("ts"), "total", "n")


