"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on random Gaussian directions; a projection is shifted, divided by WIDTH and rounded down. K such
numbers make a bucket key, in TABLES independent tables. Two unit vectors of cosine c lie sqrt(2 - 2c) apart, which gives
the chance p that they agree in one projection; K follows from the number of vectors (so that a bucket holds few vectors
by chance), and TABLES from the recall wanted at the threshold itself. Vectors that share a bucket are compared by their
cosine in double precision, each pair in the first table that brings it together.

Equal vectors are one vector with a multiplicity. A bucket of more than BLOCK vectors is split into blocks, and pairs of blocks
are compared, so a task holds two blocks of one bucket at a time, never a whole bucket. Of a block's links only the numbers for
each vector and a spanning forest leave the task. Vectors are broadcast to their keys only up to common.BROADCAST_BYTES. At the
threshold of 0.95 n vectors take about n^0.2 times a constant of tables (87 at 51,000, 175 at a million, 398 at 10^8), so keys grow as n^1.2.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
different lengths neither. Rows that share a vec_id: equal vectors among them are copies of one another, each counted.
A null vec_id is a vector that others may link with, but that is no component's name. Empty tables give empty tables. Only
vec_id and embedding are read, so other columns (labels too) can't clash or matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, blocked, components, kept, small, staged, whole_groups

WIDTH, RECALL, BLOCK = 2.0, 0.9999, 1024
#: Groups of so many rows at most are compared together, not each on its own.
FEW = 16
THRESHOLD = 0.95


def agreement(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at a distance agree in one quantised projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for n vectors: by chance, one bucket in four brings orthogonal vectors together."""
    near, far = agreement(math.sqrt(2 - 2 * threshold)), agreement(math.sqrt(2))
    k = max(4, math.ceil(math.log(4 * max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


def keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket key of each row of x (unit vectors) in each table."""
    rng = np.random.default_rng([7, x.shape[1], k, tables])
    a, b = rng.standard_normal((x.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    mul = np.random.default_rng(11).integers(1, 2**62, k, dtype=np.int64) | 1
    out = np.empty((len(x), tables), dtype=np.int64)
    step = max(1, 2_000_000 // (k * tables))
    with np.errstate(over="ignore"):
        for at in range(0, len(x), step):
            q = np.floor((x[at : at + step] @ a + b) / WIDTH).astype(np.int64).reshape(-1, tables, k)
            h = (q * mul).sum(axis=2) + np.arange(tables, dtype=np.int64) * np.int64(0x632BE59BD9B4E019)
            out[at : at + step] = (h ^ (h >> 29)) * np.int64(0x1E3779B97F4A7C15)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow list column whose lists have one length and are valid."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Whether an embedding has a direction.
VALID = "coalesce(embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0), false)"


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n points and links (i, j): the smallest point that each reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(table: int, ids: np.ndarray, side: np.ndarray, x: np.ndarray, copies: np.ndarray, k: int, tables: int, threshold: float) -> tuple | None:
    """Links among the rows of one group (side 0), or between its two blocks (sides 1 and 2): arrays of id, other, n."""
    left, right = (np.arange(len(ids)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    own, ones, twos = None, [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        i, j = rows[i], right[j]
        if not side.any():
            i, j = i[i < j], j[i < j]
        if len(i) and own is None:
            own = keys(x, k, tables)[:, :table]
        for part in range(0, len(i), 100_000):
            a, b = i[part : part + 100_000], j[part : part + 100_000]
            new = ~(own[a] == own[b]).any(axis=1)
            ones.append(a[new])
            twos.append(b[new])
    i, j = np.concatenate(ones or [left[:0]]), np.concatenate(twos or [left[:0]])
    if not len(i):
        return None
    n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    rows = np.flatnonzero(n)
    return ids[rows], ids[_labels(len(ids), i, j)[rows]], n[rows].astype(np.int64)


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, other, n) of `vectors` (id, copies, embedding; valid, distinct): parts of each vector's number of links, and an
    edge of a spanning forest. An id's parts add up to the multiplicities of the vectors that it links with."""
    k, tables = plan(vectors.count(), threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(b.column(1).value_lengths())
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    h = keys(_matrix(some.column(1)), k, tables)
                    ids = np.repeat(np.array(some.column(0)), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(h))), pa.array(h.ravel() + np.int64(size))], names=["id", "table", "key"])

    found = kept(vectors.select("id", "embedding").mapInArrow(hashed, "id bigint, table int, key bigint"))
    shared = found.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1").select("table", "key")
    shared = kept(shared.withColumn("some", F.lit(True)))
    rows = attach(found, shared, "table", "key").where("some").drop("some").join(small(vectors), "id")
    group = ["table", "key", "lo", "hi"]

    def few_at_once(g: np.ndarray, name: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        """Links within small groups (name: the group of each row): rows are compared with those some places further on."""
        for shift in range(1, FEW):
            i = np.flatnonzero(name[shift:] == name[:-shift]) if len(name) > shift else np.zeros(0, dtype=int)
            if not len(i):
                return
            i = i[np.einsum("ij,ij->i", x[i], x[i + shift]) >= threshold]
            j = i + shift
            if len(i):
                new = (keys(x[i], k, tables) == keys(x[j], k, tables)).argmax(axis=1) == g[i]
                i, j = i[new], j[new]
                yield np.r_[ids[i], ids[j]], np.r_[ids[j], ids[i]], np.r_[copies[j], copies[i]]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts, ends in whole_groups(batches, group):
            table, ids, side, copies, lo, hi = (whole.column(c).to_numpy() for c in ("table", "id", "side", "copies", "lo", "hi"))
            lists = whole.column("embedding").combine_chunks()
            length, name = np.array(lists.value_lengths()), np.repeat(np.arange(len(starts)), ends - starts)
            few, out = (ends - starts <= FEW) & (lo == hi)[starts], []
            for s, e in zip(starts[~few], ends[~few], strict=True):
                if (length[s:e] == length[s]).all():
                    got = _compare(int(table[s]), ids[s:e], side[s:e], _matrix(lists.slice(s, e - s)), copies[s:e], k, tables, threshold)
                    out += [got] if got else []
            for n in np.unique(length[few[name]]):
                at = np.flatnonzero(few[name] & (length == n))
                out += few_at_once(table[at], name[at], ids[at], copies[at], _matrix(lists.take(pa.array(at))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "other", "n"])

    rows = blocked(rows, ["table", "key"], BLOCK).select(*group, "id", "side", "copies", "embedding")
    return rows.mapInArrow(compared, "id bigint, other bigint, n bigint")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of `df` (vec_id, embedding)."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.expr(VALID).alias("valid"))
    valid = rows.where("valid")
    vectors = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    vectors = staged(vectors.withColumn("id", F.monotonically_increasing_id()), "vectors")  # written once, so the numbers hold
    found = staged(links(vectors.select("id", "copies", "embedding"), threshold, recall), "found")
    comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    about = vectors.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(comp, "id", "left")
    about = about.select("embedding", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    names = about.groupBy("comp").agg(F.min("least").alias("component_id"))
    about = staged(about.join(names, "comp").select("embedding", "least", "copies", "n_links", "component_id"), "about")
    # A vector of one row needs no way back to it; those of several, maybe of a third of all rows, are dealt out with a salt.
    one = about.where("copies = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id")
    several = about.where("copies > 1").select("embedding", "n_links", "component_id", F.lit(True).alias("some"))
    got = one.union(attach(valid.select("vec_id", "embedding"), several, "embedding").where("some").select("vec_id", "n_links", "component_id"))
    lone = rows.where("not valid").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return got.union(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
