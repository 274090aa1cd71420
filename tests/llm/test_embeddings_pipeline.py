import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import embedding_dup as E

NAN = float("nan")


def brute(rows):
    fine = lambda v: bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if fine(v)]
    up = list(range(len(ok)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                n[a] += 1
                n[b] += 1
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(ok):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted([(i, n[k], least[top(k)]) for k, (i, _) in enumerate(ok)] + [(i, 0, i) for i, v in rows if not fine(v)])


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for n, s in ((260, 0.01), (5, 0.02), (40, 0.03), (1, 0), (120, 0.04), (60, 0.06)):
        c = rng.standard_normal(16)
        c /= np.linalg.norm(c)
        rows += [[float(x) for x in np.float32(c + s * rng.standard_normal(16))] for _ in range(n)]
    rows += [rows[3]] * 30 + [[x * 8 for x in rows[3]], None, [], [0.0] * 16, [NAN] * 16, [None] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-38] * 16]
    return [(1000 - i, v) for i, v in enumerate(rows)]


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("id", F.lit("clash"))
    got = E.near_duplicates(df).collect()
    want = brute([(i, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None) for i, v in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.near_duplicates(df.limit(0)).count() == 0
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect()) == want


def test_plan_reaches_its_recall_by_chance():
    k, tables = E.plan(100_000)
    assert 1 - (1 - E.agreement(np.sqrt(0.1)) ** k) ** tables >= E.RECALL
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert (E.keys(x, k, tables) == E.keys(y, k, tables)).any(axis=1).mean() > 0.998


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as P

    good = [f"{' '.join(f'word{(i * 7 + k * 13) % 997}x{i}' for k in range(80))}." for i in range(120)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, t + " extra", "en", "s", 0) for i, t in enumerate(good[:10])] + [(300, good[0], "en", "s", 0), (301, "### $$$ " * 100, "en", "s", 0), (302, None, None, None, None), (303, "short", "en", "s", 5)]
    rows += [(400, good[50].replace("word", "term") + " token = abcdefghijklmnop1234", "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(301, 0, 0)] + [(1000 + i, 0, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "secret_scan", "packing"]
    seen, now = {}, spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        out = f"file://{tmp_path}/{name}"
        stage(spark, now, f"file://{tmp_path}").write.parquet(out)
        now = spark.read.parquet(out)
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
    assert set(range(120)) <= seen["quality_rules"] and 302 not in seen["quality_rules"] and 303 not in seen["quality_rules"]
    assert set(range(120)) <= seen["near_duplicates"] and not {200, 209, 300} & seen["near_duplicates"] and 400 in seen["near_duplicates"]
    masked = spark.read.parquet(f"file://{tmp_path}/secret_scan").where("doc_id = 400").first()
    assert "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
    assert seen["packing"] == seen["secret_scan"]
    assert P.run(spark, f"file://{tmp_path}").count() == now.count()


def test_pipeline_over_an_empty_table_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", score int, kept int, spans int, class_id int, n_words int, level int, lost int, c0 int, blob int, ids int, place int, block int"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    good = " ".join(f"word{i}" for i in range(70)) + "."
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (None, good + " x", None, None, None), (2, None, None, None, None), (3, good.replace("word", "term") + " token = abcdefghijklmnop1234", "de", "s", 1), (4, "", "en", "s", 0)]
    for name, table in (("none", spark.createDataFrame([], schema + extra)), ("some", spark.createDataFrame([(*r, *[7] * 12) for r in rows], schema + extra))):
        now, sizes = table, []
        for stage, f in P.STAGES:
            out = f"file://{tmp_path}/{name}-{stage}"
            f(spark, now, f"file://{tmp_path}").write.parquet(out)
            columns, now = now.columns, spark.read.parquet(out)
            sizes.append(now.count())
            if stage != "packing":
                assert now.columns == columns, stage
        assert sizes == ([0] * 5 if name == "none" else [*sizes[:2], sizes[1] - 1, sizes[1] - 1, sizes[4]])
        if name == "some":
            assert sizes[0] >= 4 and sizes[1] == 4 and sizes[4] >= 3  # the repeated row of doc_id 1 goes in the third stage
