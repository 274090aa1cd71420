"""What the operators of this subpackage share: staged tables, let-bindings, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Largest size, as estimated from its values, of a table that is broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 64_000_000
#: Parts that a key's rows are dealt to in attach(), where the table is too large to broadcast.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where the setting is absent a local session gets a folder of its own; on a
    cluster that would be another disk for each executor, so there it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: What this driver has written and persisted on the way to results.
_made: list[tuple[str, object]] = []


def temporary(spark: SparkSession, path: str) -> str:
    """Note that `path`, which is written by now, is of no use once results are written: release() deletes it, the session's end does too."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(name)
    _made.append(("path", path))
    return path


def release(spark: SparkSession) -> None:
    """Delete all temporary tables and let go of all frames that kept() holds. For when every result that builds on them is written."""
    while _made:
        kind, x = _made.pop()
        if kind == "path":
            name = spark._jvm.org.apache.hadoop.fs.Path(x)
            name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
        else:
            x.unpersist()


def staged(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(temporary(df.sparkSession, path))


def kept(df: DataFrame) -> DataFrame:
    """`df`, computed once and held in the executors' memory, on their disks where that is short. What a lost executor held is computed
    again from what it was made of. For frames near the input: plans that nest several grow too long. release() lets go of it."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _made.append(("frame", out))
    return out


def held(df: DataFrame) -> int:
    """About the bytes that `df` takes in an executor's memory: 16 for each value and row, and the contents of strings, arrays and maps."""

    def size(name: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.octet_length(name)
        if isinstance(kind, ArrayType):
            deep = isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType)
            return F.greatest(F.size(name), F.lit(0)) * (64 if deep else 8)
        return F.lit(0)

    each = sum((F.coalesce(size(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema.fields), F.lit(16 * (1 + len(df.columns))))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it takes BROADCAST_BYTES at most, as it is if not (then Spark shuffles both sides)."""
    return F.broadcast(df) if held(df) <= BROADCAST_BYTES else df


def attach(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """`left` with the other columns of `right`, null where it has no row; `right` has one row for each value of `on` at most. Where
    `right` is too large to broadcast, each of its rows goes out SALTS times and the rows of a key of `left` are dealt to
    SALTS parts, by the partition that they come from, so that a key may hold any share of them. Neither has a column __salt."""
    if held(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(on), "left")
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(many, [*on, "__salt"], "left").drop("__salt")


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """The states after each of `values` (an array), each made by `step` of the one before and a value. States go to the next in blocks, so
    that arrays grow by short pieces only: time is in proportion to the length, but for arrays of many thousand values."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1)
    part = lambda k: F.slice(values, k * block + 1, block)
    own = lambda x: F.array(x)

    def ends(out: Column, k: Column) -> Column:
        return F.concat(out, own(F.aggregate(part(k), F.element_at(out, -1), step)))

    def states(first: Column, k: Column) -> Column:
        grown = lambda out, x: F.concat(out, own(step(F.element_at(out, -1), x)))
        got = F.aggregate(part(k), own(first), grown)
        return F.slice(got, F.lit(2), F.size(got) - 1)

    firsts = F.aggregate(blocks, own(start), ends)
    got = let(firsts, lambda f: F.flatten(F.transform(blocks, lambda k: states(F.get(f, k), k))))
    return F.when(F.size(values) > 0, got).otherwise(F.slice(own(start), F.lit(1), F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once for a row however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): the smallest id each id of `edges` reaches. Minimum labels spread over edges, then labels jump to
    their labels' labels, until nothing changes; every round is a staged table and nothing but one count is collected."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(both.union(both.select("v", "u")).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "id"), "labels")
    while True:
        heard = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("comp").alias("heard"))
        mixed = labels.join(heard, F.col("id") == F.col("u")).select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("jump"))
        after = mixed.join(up, mixed.comp == up.up, "left").select("id", "was", F.least(F.col("comp"), F.coalesce("jump", "comp")).alias("comp"))
        after = staged(after, "labels")
        if not after.where("was <> comp").limit(1).count():
            return after.select("id", "comp")
        labels = after.select("id", "comp")


def blocked(rows: DataFrame, key: list[str], block: int) -> DataFrame:
    """`rows` (key columns, id, ...) for comparing within each key: a key of more than `block` rows is split into blocks, and each
    row goes to every pair of blocks (lo, hi) that its own is part of. side: 0 within a block, else 1 or 2, by block.
    Rows lie together and sorted by key, lo and hi."""
    blocks = F.ceil(F.col("__size") / block).cast("int")
    sizes = kept(rows.groupBy(*key).agg(F.count("*").alias("__size")))
    got = attach(rows, sizes, *key).withColumn("__own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("__with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("__own") == F.col("__with"), 0).when(F.col("__own") < F.col("__with"), 1).otherwise(2)
    got = got.withColumns({"lo": F.least("__own", "__with"), "hi": F.greatest("__own", "__with"), "side": side}).drop("__size", "__own", "__with")
    return got.repartition(*key, "lo", "hi").sortWithinPartitions(*key, "lo", "hi")


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted rows in tables of some thousand rows that cut no group apart, each with where its groups start and end."""

    def placed(table: pa.Table) -> np.ndarray:
        g = np.stack([table.column(c).to_numpy() for c in group], axis=1)
        return np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(axis=1)])

    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) < rows:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        starts = placed(table)
        if starts[-1]:  # the last group may go on
            yield table.slice(0, starts[-1]), starts[:-1], starts[1:]
        kept = table.slice(starts[-1]).to_batches()
    if sum(x.num_rows for x in kept):
        table = pa.Table.from_batches(kept).combine_chunks()
        starts = placed(table)
        yield table, starts, np.r_[starts[1:], table.num_rows]
