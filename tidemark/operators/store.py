"""Stored tables: upserts, insert-once and append-only writes as new snapshots of a Parquet table, and the feature store.

A table is a folder of parts and, for each version, a pointer: a one-row table with the names of the parts that make up the version. A
reader sees a whole version or the one before. Appending writes one more part and rewrites nothing; replacing rows writes a new first part. A
pointer is written only if there is none of its version yet: of two writers one finds the other's pointer and starts over from it. (That check
and the write are two steps of Spark's writer; a store whose writers race within them needs a lock outside.)"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """A key comes twice where it may come once."""


class Table:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _current(self) -> tuple[int, list[str]]:
        try:
            rows = self.spark.read.parquet(f"{self.path}/pointer/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return (rows[0]["version"], list(rows[0]["parts"])) if rows else (0, [])

    def _rows(self, parts: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{x}" for x in parts)) if parts else None

    def read(self) -> DataFrame | None:
        """The table's rows; None before the first write."""
        return self._rows(self._current()[1])

    def _part(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, change: Callable[[list[str]], list[str]]) -> list[str]:
        """Make the next version of the parts of the present one, and give its parts; again, if another writer was first."""
        while True:
            version, parts = self._current()
            row = self.spark.createDataFrame([(version + 1, now := change(parts))], "version bigint, parts array<string>")
            try:
                row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/pointer/v{version + 1:012d}")
                return now
            except AnalysisException as e:
                if "PATH_ALREADY_EXISTS" not in str(e):
                    raise

    def _unique(self, df: DataFrame) -> None:
        if df.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise DuplicateKey(f"rows of one batch share a key of {self.keys}")

    def _staged(self, df: DataFrame) -> tuple[str, DataFrame]:
        """A part of the batch, and its rows as read from there: what a batch is computed from is read once. No version names the part yet."""
        name = self._part(df)
        rows = self._rows([name])
        try:
            self._unique(rows)
        except DuplicateKey:
            self._drop(name)
            raise
        return name, rows

    def _drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, df: DataFrame) -> int:
        """Rows replace those of equal keys; a key twice in the batch is an error. Gives the number of rows."""
        name, new = self._staged(df)

        def change(parts: list[str]) -> list[str]:
            old = self._rows(parts)
            if old is None or not old.join(new.select(*self.keys), self.keys, "left_semi").limit(1).count():
                return [*parts, name]  # all keys are new: nothing is rewritten
            return [self._part(merged(old, new, self.keys))]

        now, n = self._commit(change), new.count()
        if name not in now:  # it went into a part of old and new rows
            self._drop(name)
        return n

    def insert_once(self, df: DataFrame) -> None:
        """Add rows whose keys aren't there; a key that is there is an error."""
        name, new = self._staged(df)

        def change(parts: list[str]) -> list[str]:
            old = self._rows(parts)
            if old is not None and old.join(new.select(*self.keys), self.keys, "left_semi").limit(1).count():
                self._drop(name)
                raise DuplicateKey(f"rows with these {self.keys} are stored already")
            return [*parts, name]

        self._commit(change)

    def append(self, df: DataFrame) -> None:
        self._commit(lambda parts: [*parts, self._part(df)])


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), *rest)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*df.columns)


def pack_features(df: DataFrame, version: str, features: list[str]) -> DataFrame:
    """feature_version, symbol, ts, features_json: missing features are null in it."""
    return df.select(F.lit(version).alias("feature_version"), "symbol", "ts", F.to_json(F.struct(*features), {"ignoreNullFields": "false"}).alias("features_json"))


def unpack_features(stored: DataFrame, features: list[str], version: str | None = None) -> DataFrame:
    """symbol, ts and the features of a version, as columns."""
    rows = stored if version is None else stored.where(F.col("feature_version") == version)
    return rows.withColumn("__m", F.from_json("features_json", "map<string,double>")).select("symbol", "ts", *[F.col("__m")[c].alias(c) for c in features])


def write_features(df: DataFrame, path: str, version: str, features: list[str]) -> None:
    """Replace a version in the feature store; the others stay."""
    out = pack_features(df, version, features)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_version").parquet(path)


def mostly_missing(df: DataFrame, features: list[str], limit: float = 0.99) -> list[str]:
    """Features of which more than a share is missing, by one aggregation."""
    got = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features]).first()
    return [c for c in features if got[c] is None or got[c] > limit]


def provider_health(runs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each source with its number of runs, records, last status and last time; sources without runs too."""
    got = runs.groupBy("source_id").agg(F.count("*").alias("n_runs"), F.sum("records").alias("records"), F.max_by("status", "started").alias("status"), F.max("started").alias("last_started"))
    return catalogue.join(got, "source_id", "left").select("source_id", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("status", F.lit("NEVER_RUN")).alias("status"), "last_started")


def reason_counts(decisions: DataFrame, col: str = "reason_codes_json") -> DataFrame:
    """reason, n over the reasons in each row's JSON list."""
    return decisions.select(F.explode(F.from_json(col, "array<string>")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def latest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows, in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)
