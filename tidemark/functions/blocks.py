"""Exact ranks, quantiles and running counts over all rows, of which no task holds more than a block of values.

Approximate quantiles cut the values of a column into blocks of about as many rows each. They only deal out work: what comes before a block is
counted exactly, and its own rows are sorted in one task. A value that fills a block alone isn't sorted at all, so that ties of any number are no
task's load."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import E

#: Rows that a block should hold, and the most blocks that there may be.
BLOCK_ROWS, MOST_BLOCKS = 250_000, 4096
FOLLOWING = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


class Cut(NamedTuple):
    """Edges of blocks: a value's block is the number of edges up to it. alone: blocks that hold one value."""

    edges: list[float]
    alone: list[int]

    def lone(self, block: str) -> str:
        return f"({block} IS NULL OR {block} IN ({', '.join(map(str, self.alone))}))" if self.alone else f"{block} IS NULL"


def cuts(df: DataFrame, cols: list[str], n: int | None = None) -> dict[str, Cut]:
    """A cut for each column of doubles. n: rows of df, counted if not given. A value at which three quantiles lie has a block of its own."""
    k = min(MOST_BLOCKS, -(-(df.count() if n is None else n) // BLOCK_ROWS))
    if k < 2:
        return {c: Cut([], []) for c in cols}
    out = {}
    for c, q in zip(cols, df.approxQuantile(cols, [i / k for i in range(k + 1)], 0.25 / k), strict=True):
        q = [x + 0.0 for x in q if math.isfinite(x)]
        many = {a for a, _, b in zip(q, q[1:], q[2:], strict=False) if a == b}
        edges = sorted({*q, *(math.nextafter(x, math.inf) for x in many)})
        out[c] = Cut(edges, [i + 1 for i, x in enumerate(edges) if x in many])
    return out


def in_blocks(df: DataFrame, cut: dict[str, Cut], names: dict[str, str]) -> DataFrame:
    """`df` with the block of each column; names: the new columns' by the old ones'. NaN is in a block after all others, NULL in none."""
    from pyspark.ml.feature import Bucketizer

    plain = {c: b for c, b in names.items() if len(cut[c].edges) < 1}
    df = df.withColumns({b: E(f"CASE WHEN {c} IS NOT NULL THEN 0 END") for c, b in plain.items()})
    for c, b in names.items():
        if c not in plain:
            df = df.withColumn(f"{b}_x", F.col(c) + 0.0)  # 0 and -0 are one value
            got = Bucketizer(splits=[-math.inf, *cut[c].edges, math.inf], inputCol=f"{b}_x", outputCol=f"{b}_d", handleInvalid="keep").transform(df)
            df = got.withColumn(b, F.col(f"{b}_d").cast("int")).drop(f"{b}_x", f"{b}_d")
    return df


def ranks(df: DataFrame, x: str, outs: dict[str, str], by: list[str], cut: Cut) -> DataFrame:
    """`df` with, for each name in `outs`, the mean rank of x among those rows of `by` that have x and for which its condition holds; NULL for
    the others. Rows are shuffled once. `df` is read twice."""
    names, had = list(outs), df.columns
    rows = in_blocks(df, {x: cut}, {x: "__b"}).withColumns({f"__c{i}": E(f"CASE WHEN {x} IS NOT NULL AND ({c}) THEN 1L ELSE 0L END") for i, c in enumerate(outs.values())})
    over = lambda p, rest: f"OVER ({'PARTITION BY ' + ', '.join(p) + ' ' if p else ''}{rest})"
    each, part, lone = range(len(names)), by, "false"
    if cut.edges:
        part, lone = [*by, "__b", "__s"], cut.lone("__b")
        totals = rows.groupBy(*by, "__b").agg(*[F.sum(f"__c{i}").alias(f"__t{i}") for i in each])
        totals = totals.select("*", *[E(f"coalesce(sum(__t{i}) {over(by, f'ORDER BY __b {FOLLOWING}')}, 0)").alias(f"__a{i}") for i in each])
        on = [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*by, "__b"]]
        salt = F.when(E(lone), F.pmod(F.xxhash64(*had), F.lit(64)).cast("int")).otherwise(0)
        rows = rows.withColumn("__s", salt).alias("__l").join(F.broadcast(totals.alias("__r")), on).select("__l.*", *[f"__r.__{k}{i}" for i in each for k in "ta"])
    own = lambda i: f"(sum(__c{i}) {over(part, f'ORDER BY {x}')} - (sum(__c{i}) {over(part, f'ORDER BY {x} RANGE BETWEEN CURRENT ROW AND CURRENT ROW')} - 1) / 2.0D)"
    rank = lambda i: f"__a{i} + CASE WHEN {lone} THEN (__t{i} + 1) / 2.0D ELSE {own(i)} END" if cut.edges else own(i)
    return rows.select(*had, *[E(f"CASE WHEN __c{i} = 1 THEN {rank(i)} END").alias(n) for i, n in enumerate(names)])


def _long(df: DataFrame, cols: list[str], cut: dict[str, Cut], keep: list[str]) -> DataFrame:
    """f (the number of a column), x, b (its block), and what is kept of the row; values that are there."""
    df = in_blocks(df, cut, {c: f"__b{i}" for i, c in enumerate(cols)})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x"), F.col(f"__b{i}").alias("b")) for i, c in enumerate(cols)])).alias("p")
    return df.select(*keep, each).select(*keep, "p.*").where("x IS NOT NULL")


def quantiles(df: DataFrame, cols: list[str], at: list[float], cut: dict[str, Cut]) -> dict[str, list[float]]:
    """The exact quantiles of each column (interpolated; none if it has no values), on the driver. Only rows of the blocks that hold one are
    sorted. `df` is read twice."""
    rows = _long(df, cols, cut, [])
    counted: dict[int, list] = {}
    for r in sorted(rows.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("x").alias("x")).collect()):
        counted.setdefault(r.f, []).append(r)
    asked, value, where = set(), {}, {}
    for f, blocks in counted.items():
        total = sum(r.n for r in blocks)
        for q in at:
            pos = (total - 1) * q
            for k in {math.floor(pos), math.ceil(pos)}:
                left = k
                for r in blocks:
                    if left < r.n:
                        break
                    left -= r.n
                if r.b in cut[cols[f]].alone:
                    value[f, k] = r.x
                else:
                    where[f, k] = (f, r.b, left + 1)
                    asked.add((f, r.b))
    found = {}
    if asked:
        want = " OR ".join(f"(f = {f} AND b IN ({', '.join(str(b) for g, b in sorted(asked) if g == f)}))" for f in {f for f, _ in asked})
        places = " OR ".join(f"(f = {f} AND b = {b} AND k IN ({', '.join(sorted(str(p) for g, c, p in where.values() if (g, c) == (f, b)))}))" for f, b in sorted(asked))
        near = rows.where(want).withColumn("k", E("row_number() OVER (PARTITION BY f, b ORDER BY x)")).where(places)
        found = {(r.f, r.b, r.k): r.x for r in near.collect()}
    value |= {k: found[w] for k, w in where.items()}
    out = {c: [] for c in cols}
    for f, blocks in counted.items():
        total = sum(r.n for r in blocks)
        for q in at:
            pos = (total - 1) * q
            a, z = value[f, math.floor(pos)], value[f, math.ceil(pos)]
            out[cols[f]].append(a if a == z else a + (z - a) * (pos - math.floor(pos)))
    return out


def running(df: DataFrame, cols: list[str], ref: str, cut: dict[str, Cut]) -> DataFrame:
    """feature, x, cr, cc, after: for each value of each column how many rows up to it have a `ref` of 1 and of 0, and the next value (its own,
    but for the last of equal rows). A row a row of a column, and one for each block of one value. `df` is read twice."""
    rows = _long(df, cols, cut, [ref]).withColumn("lone", F.expr("CASE f " + " ".join(f"WHEN {i} THEN {cut[c].lone('b')}" for i, c in enumerate(cols)) + " END"))
    totals = rows.groupBy("f", "b").agg(F.sum(ref).alias("tr"), F.count("*").alias("n"), F.min("x").alias("first"), F.max("lone").alias("single"))
    before = f"OVER (PARTITION BY f ORDER BY b {FOLLOWING})"
    totals = totals.selectExpr("f", "b", "single", "first", "tr", "n - tr AS tc", f"coalesce(sum(tr) {before}, 0) AS br", f"coalesce(sum(n - tr) {before}, 0) AS bc", "lead(first, 1) OVER (PARTITION BY f ORDER BY b) AS following")
    w = "OVER (PARTITION BY f, b ORDER BY x)"
    own = rows.where("NOT lone").drop("lone").join(F.broadcast(totals.where("NOT single").drop("single", "first", "tr", "tc")), ["f", "b"])
    own = own.selectExpr("f", "x", f"br + sum({ref}) {w} AS cr", f"bc + sum(1 - {ref}) {w} AS cc", f"coalesce(lead(x, 1) {w}, following) AS after")
    got = own.union(totals.where("single").selectExpr("f", "first AS x", "br + tr AS cr", "bc + tc AS cc", "following AS after"))
    return got.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("f") + 1).alias("feature"), "x", "cr", "cc", "after")
