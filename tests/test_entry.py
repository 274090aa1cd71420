"""The driver's contract: queries import without a session; their columns are those of their SQL."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tidemark.llm" not in p.read_text()


def test_flagship_query_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["symbol", "ts"] and df.count() > 1000


def test_small_queries_equal_their_sql(spark):
    import duckdb

    from tidemark.queries import ORACLE, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("benchmark_daily", "fundamentals_asof", "macro_history_asof", "market_regime", "event_relevance", "purged_folds", "reason_code_counts", "upsert_orders"):
        got, want = QUERIES[name](spark, sf), con.sql(ORACLE[name])
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        at = [want.columns.index(c) for c in cols]
        plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
        assert sorted(str(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall()), name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from tidemark.operators import monitoring
    from tidemark.sources import tables

    text = plan(monitoring.view(tables.table(spark, "/root/testdata/sf0.001", "orders"), {"o_orderstatus": "O"}).select("o_orderkey"))
    assert "EqualTo(o_orderstatus,O)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "l_comment" not in plan(tables.bars(spark, "/root/testdata/sf0.001")) and "l_tax" not in plan(tables.bars(spark, "/root/testdata/sf0.001"))


def test_shuffles_are_as_few_as_declared(spark):
    from tidemark.operators import asof, technical
    from tidemark.sources import tables

    bars, facts = tables.bars(spark, "/root/testdata/sf0.001"), tables.facts(spark, "/root/testdata/sf0.001")
    own = plan(bars).count("Exchange hashpartitioning") + plan(facts).count("Exchange hashpartitioning")
    joined = asof.asof_join(bars, facts, ["symbol"], "ts", "published", {"revenue": "revenue"})
    assert plan(joined).count("Exchange hashpartitioning") == own + 1 and "Join" not in plan(joined)
    features = technical.add(bars, technical.RETURN_SET, technical.VOL_SET)
    assert plan(features).count("Exchange hashpartitioning") == plan(bars).count("Exchange hashpartitioning") + 1
