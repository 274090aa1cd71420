"""Quality classifier: a sparse ensemble of rules over statistics of the whole text.

Statistics of each text are computed in Arrow batches. Small boosted trees are fitted in numpy on a bounded sample of
labelled rows; every path from a root to a node is a conjunctive rule; a logistic model with an L1 penalty weighs the
rules and leaves most of them out. The rules that remain are compiled into one Spark column expression over the
statistics, so that scoring is a projection.

Bound: at most `SAMPLE_ROWS` labelled rows, those with the smallest hash of doc_id, reach the driver.

Defined cases: a null text is an empty text and gets the score of its statistics (all 0). Labels of one doc_id that
contradict each other count as 0; null labels are left out. A row with a null doc_id is scored and never learned from.
With no labels, or labels of one class only, the score is the share of label 1 (1.0 without labels). Repeated rows get
equal scores. An empty table gives an empty table. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import kept

SAMPLE_ROWS = 8_192
THRESHOLD = 0.3
FEATURES = ["log_words", "word_chars", "distinct", "repeats", "symbols", "shouts", "upper", "digits", "dup_lines", "stops", "short_words", "non_ascii"]
SCHEMA = "doc_id bigint, " + ", ".join(f"{x} double" for x in FEATURES)
_DROP = {k: v.encode() for k, v in {"symbols": "#*$%&|<>~^=_\\", "shouts": "!?", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "stops": ".,;:"}.items()}
_HIGH = bytes(range(128, 192))  # a continuation byte for each character beyond ASCII at least


def statistics(text: str | None) -> tuple[float, ...]:
    """FEATURES of a text. Shares are of words or characters, so that length alone moves only the first."""
    text = text or ""
    words = text.split()
    n, raw = max(1, len(words)), text.encode("utf-8", "surrogatepass")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters = max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(operator.eq, words, words[1:])) / n
    distinct = len(set(words)) / n ** 0.9  # in prose the number of distinct words grows a little slower than the text
    return (
        math.log1p(len(words)), (len(text) - text.count(" ")) / n, distinct, repeats, count(_DROP["symbols"]) / n, count(_DROP["shouts"]) / n,
        count(_DROP["upper"]) / letters, count(_DROP["digits"]) / letters, (len(lines) - len(set(lines))) / max(1, len(lines)), count(_DROP["stops"]) / n,
        sum(1 for x in words if len(x) < 4) / n, count(_HIGH) / letters,
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES for each row of `docs` (doc_id, text)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # texts are long: few are Python objects at a time
                part = b.slice(at, 512)
                x = np.array([statistics(t) for t in part.column(1).to_pylist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in x.T]], names=["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(computed, SCHEMA)


Rule = tuple[tuple[int, str, float], ...]


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, leaf: int = 8) -> list[Rule]:
    """Boost trees on the logistic loss over quantile bins; give the path to each of their nodes."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], axis=1)  # bin k: cut[k-1] < value <= cut[k]
    margin, rules = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        nodes: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            after = []
            for rows, path in nodes:
                best = (1e-9, -1, -1)
                if level < depth and len(rows) >= 2 * leaf:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, edges in enumerate(cuts):
                        if not len(edges):
                            continue
                        b = binned[rows, f]
                        cg, ch, cn = (np.cumsum(np.bincount(b, w, len(edges) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = np.where((cn >= leaf) & (len(rows) - cn >= leaf), cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1), -1)
                        k = int(gain.argmax())
                        best = max(best, (float(gain[k]), f, k))
                if best[1] < 0:
                    margin[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                _, f, k = best
                left = binned[rows, f] <= k
                for side, op in ((rows[left], "<="), (rows[~left], ">")):
                    step = (*path, (f, op, float(cuts[f][k])))
                    rules[tuple(sorted(step))] = None
                    after.append((side, step))
            nodes = after
    return list(rules)


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, op, cut in rule:
        out &= x[:, f] <= cut if op == "<=" else x[:, f] > cut
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    b0, w = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(r.shape[1])
    v = np.full(r.shape[1], 1 / math.sqrt(max(1, r.shape[1])), dtype=r.dtype)
    for _ in range(20):  # the largest curvature, by power iteration
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = 1 / (0.25 * (np.linalg.norm(r @ v) ** 2 / n + 1) + 1e-9)
    zb, z, t = b0, w.copy(), 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(zb + r @ z.astype(r.dtype)))) - y
        nb, nw = zb - size * e.mean(), z - size * (r.T @ e.astype(r.dtype)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - size * penalty, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        zb, z = nb + (t - 1) / nt * (nb - b0), nw + (t - 1) / nt * (nw - w)
        b0, w, t = nb, nw, nt
    return b0, w


class RuleEnsemble:
    """An intercept and weighted conjunctive rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 1.0
            return cls(40.0 if share else -40.0, [])
        rules = grow_trees(x, y)
        r = np.stack([applies(k, x) for k in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0))
        b0, w = lasso(r, y)
        return cls(float(b0), [(k, float(v)) for k, v in zip(rules, w, strict=True) if v])

    def column(self) -> Column:
        """The score as a Spark column over FEATURES."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = " and ".join(f"{FEATURES[f]} {op} {cut!r}D" for f, op, cut in rule)
            total = total + F.when(F.expr(test), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules as text, the weightiest first."""
        return [f"{w:+.3f} " + " and ".join(f"{FEATURES[f]} {op} {c:.4g}" for f, op, c in r) for r, w in sorted(self.rules, key=lambda k: -abs(k[1]))]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the remainder of its id's CRC-32 by 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Learn from rows of `stats` that have a label and aren't held out, `sample_rows` of them at most."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y")).where(~held_out())
    rows = stats.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", *FEATURES)
    got = np.array([r[2:] for r in rows.orderBy(*rows.columns).limit(sample_rows).collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return RuleEnsemble.fit(got[:, 1:], got[:, 0])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    stats = kept(text_statistics(docs))
    got = stats.select("doc_id", held_out().alias("held_out"), fit(stats, labels).column().alias("score"))
    return got.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` with a predicted label of 1. Statistics ride along with each row, so the texts aren't shuffled. The sample is drawn
    from the labels before they meet the documents; labels whose document isn't there take a place in it and teach nothing."""
    known = labels.where("quality is not null").select("doc_id").distinct()
    sample = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    stats = kept(text_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")))
    column = fit(stats, labels).column()

    names = docs.columns
    at = names.index("text")

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in x.T]], names=[*(f"c{i}" for i in range(len(names))), *FEATURES])

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*plain.schema.fields, *(StructField(f, DoubleType()) for f in FEATURES)])
    return plain.mapInArrow(computed, schema).where(column >= THRESHOLD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
