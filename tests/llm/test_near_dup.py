import hashlib
import random
from collections import Counter

import numpy as np

from tidemark.llm import common
from tidemark.llm import near_dup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if w and i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i, _ in rows if i is not None}


def rows_of(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(text(rng.randrange(1, 60))) for _ in range(40)]
    base = text(220)
    for k in range(700):  # a group that shades off from near copies to other texts, around no one hub
        w = list(base)
        for _ in range(rng.randrange(0, 30)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    long = text(3000)
    for k in range(12):
        w = list(long)
        for _ in range(k * 12):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[45]] * 30 + ["one two", "one two", None, None, "", "  \n", "\x1c", "\x1c\x1d", "x", "x"]
    rng.shuffle(out)
    return list(enumerate(out)) + [(None, out[50]), (3, "one two")]


def test_classes_equal_brute_force_however_large_the_group(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as class_id", "1 as kept", "2 as band")
    got = N.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)


def test_dropping_keeps_one_of_each_class_and_every_unrelated_text(spark):
    rows = rows_of(7)[:300] + [(3, "one two"), (3, "one two"), (1, "quite another text that nothing else is like"), (None, None), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as id", "1 as lost", "2 as version", "3 as c0")
    got = N.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    versions = sorted({(i, digest(t)): (i, t) for i, t in rows if i is not None}.items())
    classes = brute([(k, t) for k, (_, (_, t)) in enumerate(versions)])
    want = [v for k, (_, v) in enumerate(versions) if classes[k] == k]
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(f for f in found if f[0] is not None) == Counter(want)
    assert sum(f[0] is None for f in found) == 2
    assert (1, "quite another text that nothing else is like") in found
    apart = spark.createDataFrame(list({i: (i, t) for i, t in rows if i is not None}.values()), "doc_id long, text string")
    want = {i for i, c in brute([tuple(r) for r in apart.collect()]).items() if i == c}
    assert {r.doc_id for r in N.drop_near_duplicates(apart).collect()} == want


def test_both_ways_of_joining_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(9)[:400], "doc_id long, text string")
    want = sorted(map(repr, N.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "SALTS", 3)
    assert sorted(map(repr, N.near_duplicates(docs).collect())) == want


def test_pairs_of_long_texts_at_the_threshold_are_found(spark):
    """Recall among pairs of long texts whose similarity is 0.8 to 0.83, none of which is the first of a bucket: all are like a hub of 0.6."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    texts = []
    for _ in range(12):
        shared = [word() for _ in range(3000)]
        for _ in range(2):
            own = [word() for _ in range(330)]
            texts.append(" ".join(shared + own))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(a != b for a, b in want.items()) == 12
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    sets = [N.shingles(t)[0] for t in texts]
    sketches = [N.sketch(s) for s in sets]
    seen = N.similar(sketches, sketches)
    assert all(seen[i, i ^ 1] for i in range(len(texts))) and seen.sum() == len(texts)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = (np.sort(ids[:600]), np.ones(600, dtype=np.int64)), (np.sort(ids[200:]), np.ones(700, dtype=np.int64))
    kept = N.registers([a, b], 4000)
    assert abs((kept[0] == kept[1]).mean() - 400 / 900) < 0.03
    assert Counter(kept[0].tolist()).most_common(1)[0][1] < 40
    heavy = (a[0], np.where(a[0] == a[0][0], 10**6, 1))
    share = (1 + np.log(1e6)) / (599 + 1 + np.log(1e6))
    assert abs((N.registers([heavy], 4000)[0] == a[0][0]).mean() - share) < 0.01


def test_registers_do_not_depend_on_what_is_computed_along():
    rng = np.random.default_rng(2)
    some = [(np.sort(rng.integers(0, 2**63, n).astype(np.uint64)), np.ones(n, dtype=np.int64)) for n in (3, 50, 0, 800)]
    together = N.registers(some)
    assert all((N.registers([x])[0] == y).all() for x, y in zip(some, together, strict=True))


def test_texts_that_repeat_lines_differently_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    texts = []
    for _ in range(20):  # of each two texts, the sets' similarity is 120 in 148, while that of the weights is far below
        shared = [word() for _ in range(124)]
        for times in (1000, 1000):
            texts.append(" ".join(shared + [word() for _ in range(10)] * times))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert want == {i: i - i % 2 for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == want
