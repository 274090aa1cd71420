"""Near-duplicate texts by ProbMinHash over five-word shingles, banding and exact verification.

A text's shingles are its runs of five words (a shorter text with words is one shingle). Each shingle is a Poisson process of
points; each point falls to one of REGISTERS registers, which keeps the shingle of its earliest point. Two texts agree in a
register with the probability Jaccard similarity of their weights. Links are defined by sets, so candidates are drawn with a
weight of 1 for each shingle, however often it occurs: then that similarity is the sets' own. A shingle's points stop once they
come later than every register's (early termination). BANDS bands of ROWS registers are hashed; texts that share a band are
candidates. A link is a candidate pair whose sets of shingles have a Jaccard similarity of SIMILARITY or more, exactly.

What may be missed: a pair with a similarity of exactly 0.8 shares no band with a chance of about 2e-6. Where both texts have at most SKETCH
shingles a candidate pair is never lost after that. Where one has more, a pair of a bucket's later members goes on to the exact comparison if its
sketches look no more than SLACK below 0.8, which is 5.7 standard deviations: a chance of about 1e-8 at 0.8, less above.
Tests measure the recall over long texts and over texts with repeated lines.

Classes are the components of links. Exact copies are one text from the start. The members of a band's bucket are not paired
with one another: first each is compared with the bucket's first member, exactly. Buckets whose members are then all of one
class are done. In the others, members of different classes are compared inside tasks, two blocks of BLOCK members at a time,
by their SKETCH smallest shingles (all shingles, for most texts); only pairs that these show to be similar leave the task, to
be verified exactly. So no bucket is capped, none is held in one task, and pairs that are no links aren't emitted.

Defined cases: null, empty and wordless texts link with nothing, copies of them included. A row with a null doc_id links
with nothing and its class is null. Rows that share a doc_id are versions of one document and so of one class; it links if
any version does. An empty table gives an empty table. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, blocked, components, kept, small, staged, whole_groups

SHINGLE, ROWS, BANDS = 5, 4, 25
REGISTERS = ROWS * BANDS
#: SIMILARITY as a fraction of integers, so that comparing is exact.
NUMERATOR, DENOMINATOR = 4, 5
CACHE_WORDS = 200_000
#: Of a text's shingles, hashed to 32 bits, the smallest SKETCH make a sketch. SLACK: how much lower the similarity may look by
#: sketches of more (for texts that they hold whole, and for the others, where it is 5.7 standard deviations).
SKETCH, BLOCK, SLACK = 512, 256, (0.005, 0.1)
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        return self.setdefault(word, xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of a text and their numbers of occurrences."""
    words = (text or "").split()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h, h.astype(np.int64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(SHINGLE, len(h)), dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out, return_counts=True)


def registers(found: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Of each text, the shingle in each of its m registers; n occurrences weigh 1 + ln(n). The points of all texts' shingles are drawn together, one
    after another, and shingles whose next point is later than all registers of their text stop."""
    sizes = np.array([len(x) for x, _ in found])
    times, keep = np.full(len(found) * m, np.inf), np.zeros(len(found) * m, dtype=np.uint64)
    if not sizes.sum():
        return keep.reshape(len(found), m)
    d = np.concatenate([x for x, _ in found])
    w = 1 + np.log(np.concatenate([c for _, c in found]).astype(np.float64))
    doc, state, t = np.repeat(np.arange(len(found)), sizes), mix(d ^ _U(0xA5A5A5A5A5A5A5A5)), np.zeros(len(d))
    while len(d):
        state = state + _U(0x9E3779B97F4A7C15)
        r = mix(state)
        t = t - np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        at = doc * m + (mix(r ^ _U(0x5851F42D4C957F2D)) % _U(m)).astype(np.int64)
        first = np.flatnonzero(t < times[at])
        first = first[np.lexsort((d[first], -t[first]))]  # the earliest is written last
        times[at[first]], keep[at[first]] = t[first], d[first]
        left = t < times.reshape(-1, m).max(axis=1)[doc]
        d, w, doc, state, t = d[left], w[left], doc[left], state[left], t[left]
    return keep.reshape(len(found), m)


def bands(kept: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text; bands differ in their keys though their registers be equal."""
    out = np.zeros((len(kept), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + kept[:, i::ROWS][:, :BANDS])
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def _parts(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of some rows and about `size` bytes of the last column, so that what is made of a slice is bounded."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = rows
            while n > 1 and b.slice(at, n).column(b.num_columns - 1).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, copy (MD5 of the text, for exact copies) and bands of each row of `docs` that has words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 256, 500_000):
            found = [shingles(t.as_py()) for t in b.column(2)]
            some = [i for i, (x, _) in enumerate(found) if len(x)]
            b, found = b.take(pa.array(some, pa.int64())), [found[i] for i in some]
            sets = [(x, np.ones_like(n)) for x, n in found]
            keys = bands(registers(sets)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc_id", "copy", "bands"])

    texts = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("copy"), "text").where("doc_id is not null and text is not null")
    return texts.mapInArrow(made, "doc_id bigint, copy binary, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted set of shingles of each row of `docs`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 256, 500_000):
            sets = [shingles(t.as_py())[0].view(np.int64) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id bigint, shingles array<bigint>")


def sketch(found: np.ndarray) -> np.ndarray:
    """The SKETCH smallest of a text's shingles, scrambled to 32 bits, sorted."""
    x = np.unique((mix(found) >> _U(32)).astype(np.uint32))
    return x[:SKETCH]


def short_sets(docs: DataFrame) -> DataFrame:
    """id and sketch (4 bytes each) of each row of `docs`."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 256, 500_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(shingles(t.as_py())[0]).tobytes() for t in b.column(1)], pa.binary())], names=["id", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "id bigint, sketch binary")


def similar(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Whether each pair of sketches may belong to texts similar enough: both are compared as far as both reach."""
    flat = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    ones, counts = np.unique(np.concatenate([np.unique(flat[0]), np.unique(flat[1])]) if left is not right else flat[0], return_counts=True)
    common = ones[counts > 1]  # what only one text has is in no intersection
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(common), step):
        part, dense = common[at : at + step], []
        for f, r, n in zip(flat, row, both.shape, strict=True):
            k = np.minimum(np.searchsorted(part, f), len(part) - 1)
            hit = part[k] == f
            x = np.zeros((n, len(part)), dtype=np.float32)
            x[r[hit], k[hit]] = 1
            dense.append(x)
        both += dense[0] @ dense[1].T
    if left is right:
        np.fill_diagonal(both, 0)
    ends = np.uint64(2**32)
    reach = [np.array([ends if len(v) < SKETCH else np.uint64(v[-1]) for v in x]) for x in (left, right)]
    within = lambda x, y: np.stack([np.searchsorted(v.astype(np.uint64), y, side="right") for v in x])
    union = within(left, reach[1]) + within(right, reach[0]).T - both
    slack = np.where((reach[0] == ends)[:, None] & (reach[1] == ends), *SLACK)
    return both >= (NUMERATOR / DENOMINATOR - slack) * union


def unsettled(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of `members` (band, id, comp) that share a band, are of different classes and look similar."""
    ids = small(staged(members.select(F.col("id").alias("doc_id")).distinct(), "ids"))
    short = short_sets(docs.join(ids, "doc_id", "left_semi"))
    group = ["band", "lo", "hi"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, group):
            ids, comp, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
            sketches = [np.frombuffer(x, dtype=np.uint32) for x in table.column("sketch").to_pylist()]
            ones, twos = [], []
            for s, e in zip(starts, ends, strict=True):
                left, right = (np.arange(s, e),) * 2 if not side[s:e].any() else (s + np.flatnonzero(side[s:e] == 1), s + np.flatnonzero(side[s:e] == 2))
                if not len(left) or not len(right) or comp[s:e].min() == comp[s:e].max():
                    continue
                ours = [sketches[k] for k in left]
                i, j = np.nonzero(similar(ours, ours if left is right else [sketches[k] for k in right]) & (comp[left][:, None] != comp[right]))
                a, b = ids[left[i]], ids[right[j]]
                ones.append(np.minimum(a, b)[a != b])
                twos.append(np.maximum(a, b)[a != b])
            if ones:
                pairs = np.unique(np.stack([np.concatenate(ones), np.concatenate(twos)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    rows = blocked(members.join(short, "id"), ["band"], BLOCK).select(*group, "id", "comp", "side", "sketch")
    return rows.mapInArrow(compared, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose texts' shingle sets are similar enough. Only texts that are in a pair are read in full."""
    ids = small(staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids"))
    sets = kept(shingle_sets(docs.join(ids, "doc_id", "left_semi")))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    close = pairs.join(left, "a").join(right, "b").where(F.least(F.size("x"), F.size("y")) * DENOMINATOR >= F.greatest(F.size("x"), F.size("y")) * NUMERATOR)
    return close.where(DENOMINATOR * both >= NUMERATOR * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of its class, for each doc_id that is linked with another or has a copy."""
    made = kept(sketches(docs))
    # One row for each text, that of its smallest doc_id; copies are combined before the shuffle, however many a text has.
    firsts = made.groupBy("copy").agg(F.min(F.struct("doc_id", "bands")).alias("x"), F.count("*").alias("n"))
    firsts = staged(firsts.select("copy", F.col("x.doc_id").alias("id"), "x.bands", "n"), "copies")
    copies = attach(made.select("doc_id", "copy"), firsts.where("n > 1").select("copy", "id"), "copy").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    members = firsts.select("id", F.explode("bands").alias("band"))
    shared = kept(members.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"))
    members = staged(attach(members, shared, "band").where("head is not null").distinct(), "buckets")
    pairs = staged(members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = staged(verified(pairs, docs), "links")
    comp = small(components(links))
    rest = members.where("id <> head").join(comp, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = kept(rest.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", F.lit(True).alias("open")))
    rest = staged(attach(rest, open_, "band").where("open").drop("open"), "buckets")
    more = staged(verified(staged(unsettled(rest, docs), "pairs"), docs), "links")
    edges = copies.union(links).union(more)
    return components(edges).select(F.col("id").alias("doc_id"), F.col("comp").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (whether it is the one its class keeps) for each row of `docs`."""
    got = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id")), classes(docs), "doc_id")
    return got.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one of each class. Rows that share a doc_id but not their text are documents of their own here,
    in the order of their texts' digests; of rows that share both one stays. Rows with a null doc_id stay."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1").limit(1).count():
        lost = kept(classes(docs).where("doc_id <> class_id").select("doc_id", F.lit(True).alias("lost")))
        return attach(docs.toDF(*_places(docs).values()).withColumn("doc_id", F.col(_places(docs)["doc_id"]).cast("long")), lost, "doc_id").where("lost is null").select(*_named(docs))
    place = _places(docs)
    rows = docs.toDF(*place.values()).withColumns({"id": F.col(place["doc_id"]).cast("long"), "copy": F.unhex(F.md5(F.coalesce(place["text"], F.lit(""))))})
    versions = rows.where("id is not null").groupBy("id", "copy").agg(F.count("*").alias("n")).repartitionByRange("id", "copy").sortWithinPartitions("id", "copy")
    versions = staged(versions.withColumn("version", F.monotonically_increasing_id()), "versions")  # numbers in the order of ids
    rows = attach(rows, versions, "id", "copy")
    lost = kept(classes(rows.select(F.col("version").alias("doc_id"), F.col(place["text"]).alias("text"))).where("doc_id <> class_id").select(F.col("doc_id").alias("version"), F.lit(True).alias("lost")))
    left = attach(rows, lost, "version").where("lost is null")
    again = left.where("n > 1").dropDuplicates(["version"])
    return left.where("n is null or n = 1").union(again).select(*_named(docs))


def _places(docs: DataFrame) -> dict[str, str]:
    """Names that no column of ours has."""
    return {c: f"c{i}" for i, c in enumerate(docs.columns)}


def _named(docs: DataFrame) -> list:
    return [F.col(k).alias(c) for c, k in _places(docs).items()]
