"""The providers that payloads may come from, which of them may be asked, and who belongs to the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source, category, the key that it needs.
PROVIDERS = [
    ("yahoo_finance", "PRICE", None), ("stockanalysis", "PRICE", None), ("sec_edgar", "FUNDAMENTAL", None), ("fred", "MACRO", None), ("bls", "MACRO", None),
    ("treasury", "MACRO", None), ("bea", "MACRO", "BEA_API_KEY"), ("gdelt", "NEWS", None), ("news_api", "NEWS", "NEWS_API_KEY"), ("polymarket_readonly", "EVENT_PROBABILITY", None),
]


def catalogue(spark: SparkSession, keys: set[str] = frozenset(), off: set[str] = frozenset()) -> DataFrame:
    """source_id, category, enabled, reason: a source is enabled unless it is switched off or lacks its key."""
    rows = [(s, c, s not in off and (k is None or k in keys), "switched off" if s in off else None if k is None or k in keys else f"requires {k}") for s, c, k in PROVIDERS]
    return spark.createDataFrame(rows, "source_id string, category string, enabled boolean, reason string")


def enabled(sources: DataFrame, category: str | None = None) -> DataFrame:
    """The sources that may be asked, of one category if it is given."""
    got = sources.where("enabled")
    return got.where(F.col("category") == category) if category else got


def seed(symbols: DataFrame, universe: str, start: str, benchmark: str | None = None) -> DataFrame:
    """membership_id, universe, symbol, start_ts, end_ts: open memberships from a date on, the benchmark's too. An id follows from what it names,
    so that seeding twice gives the same rows."""
    names = symbols.select("symbol").distinct()
    if benchmark is not None:
        names = names.union(symbols.sparkSession.createDataFrame([(benchmark,)], "symbol string")).distinct()
    key = F.sha2(F.concat_ws("|", F.lit(universe), "symbol", F.lit(start)), 256)
    return names.select(key.alias("membership_id"), F.lit(universe).alias("universe"), "symbol", F.lit(start).cast("timestamp_ntz").alias("start_ts"), F.lit(None).cast("timestamp_ntz").alias("end_ts"))
