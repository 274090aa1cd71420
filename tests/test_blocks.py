"""What goes by blocks of values, with blocks so small that few rows make many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.operators import drift
from tidemark.operators import metrics as M


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(drift, "ONE_TASK", 50)


def values(n=900):
    """Values with a tie of a third of all rows, zeros of both signs, missing ones."""
    r = np.random.default_rng(5)
    p = np.round(r.normal(0, 1, n), 2)
    p[: n // 3], p[n // 3 : n // 3 + 9] = 0.25, -0.0
    return p, np.round(p + r.normal(0, 1, n), 1), r


def test_ranks_within_groups_by_blocks(spark, small):
    p, y, _ = values()
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y, "g": np.arange(len(p)) % 3}))
    got = M.average_ranks(df, {"p": "rp", "y": "ry"}, ["g"]).toPandas()
    for c in ("p", "y"):
        assert (got[f"r{c}"] == got.groupby("g")[c].rank()).all()
    assert M.rank_ic(df, "y", "p").first().rank_ic == pytest.approx(pd.Series(p).rank().corr(pd.Series(y).rank()))
    assert "rangepartitioning" not in (plan := M.rank_ic(df, "y", "p", ["g"])._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(g#" in plan and "__b" in plan


def test_late_predictions_by_blocks(spark, small):
    p, y, _ = values()
    df = pd.DataFrame({"symbol": np.arange(len(p)) % 7, "ts": np.arange(len(p)), "y": y, "p": p})
    df.loc[::11, "p"], df.loc[::13, "y"] = np.nan, np.nan
    rows = spark.createDataFrame(df).select("symbol", "ts", F.nanvl("y", F.lit(None)).alias("y"), F.nanvl("p", F.lit(None)).alias("p"))
    for r in M.delay_stress(rows, "y", "p").collect():
        late = df.assign(p=df.groupby("symbol").p.shift(r.delay_days)).dropna()
        assert r.n == len(late) and r.rank_ic == pytest.approx(late.p.rank().corr(late.y.rank()))


def test_quantile_bins_by_blocks(spark, small):
    p, y, _ = values()
    df = spark.createDataFrame(pd.DataFrame({"x": p, "z": y}))
    at = [i / 10 for i in range(11)]
    got = blocks.quantiles(df, ["x", "z"], at, blocks.cuts(df, ["x", "z"]))
    assert got["x"] == pytest.approx(list(np.quantile(p, at))) and got["z"] == pytest.approx(list(np.quantile(y, at)))
    prob = np.clip(np.abs(p) / 4, 0, 1)
    curve = M.calibration_curve(spark.createDataFrame(pd.DataFrame({"p": prob, "y": (y > 0) * 1.0})), "y", "p").orderBy("mean_predicted").toPandas()
    edges = np.unique(np.quantile(prob, at))
    want = pd.DataFrame({"p": prob, "y": (y > 0) * 1.0}).groupby(np.maximum(np.searchsorted(edges, prob), 1)).agg(p=("p", "mean"), y=("y", "mean"), n=("p", "size"))
    assert list(curve["count"]) == list(want.n) and list(curve.mean_predicted) == pytest.approx(list(want.p)) and list(curve.mean_realised) == pytest.approx(list(want.y))


def test_drift_of_many_rows_equals_that_of_counts(spark, small, monkeypatch):
    p, y, _ = values()
    ref, cur = (spark.createDataFrame(pd.DataFrame(x)) for x in ({"x": p, "z": np.abs(y)}, {"x": y[:500], "z": np.abs(p[:500])}))
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    many = [rows(f(ref, cur, ["x", "z"])) for f in (drift.drift_report, drift.psi, drift.ks_wasserstein)]
    monkeypatch.setattr(drift, "ONE_TASK", 10**6)
    assert [rows(f(ref, cur, ["x", "z"])) for f in (drift.drift_report, drift.psi, drift.ks_wasserstein)] == many


def test_analogues_of_long_histories_equal_those_of_whole_ones(spark, monkeypatch):
    from tidemark.operators import analogue as N

    r = np.random.default_rng(6)
    at = lambda i: (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime()
    panel = spark.createDataFrame([(f"s{k}", at(i), None if i % 31 == 5 else float(50 + r.normal()), float(round(r.normal(), 1)), float(r.normal()) if i % 9 else None) for k, n in ((0, 150), (1, 90), (2, 30)) for i in range(n)], "symbol string, ts timestamp_ntz, close double, f double, g double")
    rows = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())
    got = N.all_analogues(panel, ["f", "g"], k=7)
    plan, whole = got._jdf.queryExecution().executedPlan().toString(), rows(got)
    assert len(whole) > 100 and "FlatMapCoGroups" not in plan and plan.count("Exchange hashpartitioning") == 1  # only answers leave a task
    for most in (100, 0):
        monkeypatch.setattr(N, "WHOLE", most)
        assert rows(N.all_analogues(panel, ["f", "g"], k=7, block=16)) == whole
