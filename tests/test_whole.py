"""Steps that read what they work on once, and give what the plain way gives."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import store


def test_a_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(50).selectExpr("id AS k", "id * 2 AS v").mapInPandas(count, "k bigint, v bigint")
    t = store.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert t.upsert(rows) == 50 and seen.value == 50
    assert t.upsert(rows.withColumn("v", F.lit(1).cast("bigint"))) == 50 and seen.value == 100
    assert t.read().agg(F.sum("v"), F.count("*")).first()[:] == (50, 50)
    with pytest.raises(store.DuplicateKey):
        t.upsert(rows.union(rows))
    with pytest.raises(store.DuplicateKey):
        t.insert_once(rows)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 2  # nothing stays of batches that no version names


def test_price_payloads_are_parsed_once(spark):
    from tidemark.plans import intake

    done = intake._prices(spark, "/root/testdata/sf0.001")
    for df, parsers in ((done.rows, 2), (done.runs, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json") <= 2 * parsers
    r = done.runs.groupBy("status").count().toPandas()
    assert set(r.status) >= {"FAILED"} and isinstance(r, pd.DataFrame)


def test_neighbours_by_blocks_are_exact_and_order_ties_by_id(spark, monkeypatch):
    import numpy as np

    from tidemark.operators import analogue as N

    monkeypatch.setattr(N, "PACK", 16)
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (90, 6)).astype("float32")
    x[60:80] = x[:20]  # equal vectors: their distances tie, ids decide
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    df = df.union(spark.createDataFrame([(500, None)], df.schema))
    got = {(r.vec_id, r.rank): (r.neighbour, r.distance) for r in N.embedding_neighbours(df, df.where("vec_id % 3 = 0"), 4).collect()}
    for q in range(0, 90, 3):
        d = [(float(np.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(x[q], x[i], strict=True)))), i) for i in range(90) if i != q]
        for place, (want, i) in enumerate(sorted(d)[:4], 1):
            assert got[q, place] == (i, pytest.approx(want))
    plan = N.embedding_neighbours(df, df.where("vec_id % 3 = 0"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_events_are_dealt_out_and_symbols_without_a_sector_stay(spark, monkeypatch):
    from tidemark.operators import scores as S

    monkeypatch.setattr(S, "PRODUCT_ROWS", 10)
    events = spark.createDataFrame([(i, c) for i, c in enumerate([*S.RELEVANCE, "other"] * 3)], "event_id bigint, category string").coalesce(1)
    sectors = spark.createDataFrame([("a", "ENERGY"), ("b", "TECH"), ("c", None), ("d", "X")], "symbol string, sector string")
    df = S.event_relevance(events, sectors)
    got = {(r.symbol, r.event_id): (r.category, round(r.relevance, 6)) for r in df.collect()}
    assert len(got) == 15 * 4 and df.rdd.getNumPartitions() >= 1 and "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert got["a", 3] == ("geopolitical", 0.4) and got["b", 4] == ("regulatory", 0.45) and got["c", 2] == ("elections_policy", 0.2) and got["d", 0] == ("monetary_policy", 0.4)


def test_sums_of_events_as_last_observed(spark):
    from datetime import datetime

    from tidemark.operators import asof

    t = lambda d: datetime(2020, 1, d)
    seen = spark.createDataFrame([(1, t(1), 0.2), (1, t(1), 0.3), (1, t(2), 0.5), (1, t(9), 0.9), (2, t(4), 0.1), (2, t(7), None)], "event_id int, observed timestamp_ntz, probability double")
    events = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "event_id int, category string")
    times = spark.createDataFrame([(t(d),) for d in (1, 3, 5, 8)], "ts timestamp_ntz")
    got = {r.ts.day: (round(r.total, 9), r.n) for r in asof.observed_sums(events, seen, times).collect()}
    assert got == {1: (0.3, 1), 3: (0.5, 1), 5: (0.6, 2), 8: (0.5, 1)}
    assert asof.observed_sums(events, seen, times)._jdf.queryExecution().executedPlan().toString().count("RangeJoin") == 0


def test_filing_facts_meet_no_pairs_of_all_dates(spark):
    from tidemark.operators import filings

    facts = spark.createDataFrame([], "symbol string, tag string, period_start timestamp_ntz, period_end timestamp_ntz, value double, filed_date timestamp_ntz, form_type string")
    plan = filings.observations(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "interval" in plan.lower()  # only the facts of the year before are joined


def test_a_date_is_sorted_once_a_metric(spark):
    from tidemark.operators import crosssection as X

    df = spark.createDataFrame([("a", 1, 1.0, 5.0), ("b", 1, 1.0, None), ("c", 1, 3.0, 2.0)], "symbol string, ts int, x double, y double")
    got = X.percentile_ranks(df, {"px": ("x", True), "py": ("y", False)})
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
    assert {r.symbol: (round(r.px, 6), r.py) for r in got.collect()} == {"a": (0.5, 0.5), "b": (0.5, None), "c": (1.0, 1.0)}


def test_a_scenario_is_walked_as_a_stream(spark):
    import numpy as np

    from tidemark.operators import broker
    from tidemark.operators.portfolio import Allocation, Fills, Limits

    r = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=40)
    rows = [(run, t, f"s{k}", p := float(r.uniform(5, 50)), p * 1.01, float(r.integers(0, 3) * 4000), None if r.random() < 0.3 else float(r.normal(0, 0.04)), 0.2, f"x{k % 3}") for run in "ab" for t in days for k in range(9) if r.random() < 0.9]
    g = pd.DataFrame(rows, columns=["run_id", "ts", "symbol", "open", "close", "volume", "weight", "volatility", "sector"])
    of = lambda frames: pd.concat(broker.walk(iter(frames), 1e5, Allocation(), Limits(), Fills()))
    whole = of([g])
    assert len(whole) == 78 and whole["approved"].sum() > 100 and whole["trades"].sum() > 10 and whole["rejected"].sum() > 0
    assert of([g.iloc[i : i + 7] for i in range(0, len(g), 7)]).equals(whole)
    df = spark.createDataFrame(g.sample(frac=1, random_state=2), "run_id string, ts timestamp_ntz, symbol string, open double, close double, volume double, weight double, volatility double, sector string")
    got = broker.backtest(df, 1e5)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.orderBy("run_id", "ts").toPandas()
    assert np.allclose(got.select_dtypes("number"), whole.select_dtypes("number"))
