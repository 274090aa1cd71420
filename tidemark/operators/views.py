"""Named read views of the stored relations: each is a filter, an order and a limit, which reach the scan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.monitoring import view


class View(NamedTuple):
    relation: str
    filters: tuple[str, ...]  # columns that a caller may ask values of
    order: str | None = None  # newest first
    limit: int | None = None
    fixed: str | None = None  # what always holds


#: The views, their filters and limits.
VIEWS = {
    "predictions": View("model_predictions", ("symbol", "model_version"), "ts", 500), "risk_decisions": View("risk_decisions", ("symbol", "status"), "ts", 500),
    "rejected_orders": View("risk_decisions", ("symbol",), "ts", 500, "status = 'REJECTED'"), "fills": View("paper_fills", ("order_id",), "ts", 500),
    "orders": View("paper_orders", ("run_id", "status"), "ts", 500), "snapshots": View("portfolio_snapshots", ("run_id",), "ts"), "reports": View("agent_reports", ("symbol", "agent"), "ts", 500),
    "registry": View("model_registry", ("role",), "ts"), "champion": View("model_registry", (), "ts", 1, "role = 'CHAMPION'"), "promotions": View("promotion_log", ("promoted",), "ts"),
    "catalogue": View("data_sources", ("category", "enabled")), "runs": View("ingestion_runs", ("source_id", "status"), "ts", 500), "flags": View("quality_flags", ("severity", "rule"), "ts", 500),
    "reconciliations": View("price_reconciliations", ("symbol", "status"), "ts", 500), "audits": View("leakage_audits", ("run_id",), "ts"), "evaluations": View("evaluations", ("run_id", "kind"), "ts"),
    "holdout_accesses": View("holdout_log", ("run_id",), "ts"), "universe": View("universe_membership", ("universe", "symbol"), "start_ts"), "news": View("news", ("symbol", "category"), "ts", 500),
    "lineage": View("lineage", ("run_id",), "ts"),
}


def read(name: str, relation: DataFrame, limit: int | None = None, since: object = None, until: object = None, **equal: object) -> DataFrame:
    """The rows of a named view. `equal`: values (or lists of them) of the view's filters; anything else is an error."""
    v = VIEWS[name]
    if unknown := set(equal) - set(v.filters):
        raise ValueError(f"{name} has no filter {sorted(unknown)}")
    df = relation.where(v.fixed) if v.fixed else relation
    if v.order and until is not None:
        df = df.where(F.col(v.order) <= F.lit(until))
    return view(df, equal, (v.order, since) if v.order and since is not None else None, v.order, limit or v.limit)


def decoded_reports(rows: DataFrame) -> DataFrame:
    """Reports with their features as a map of numbers."""
    return rows.withColumn("features", F.from_json("features_json", "map<string,double>")).drop("features_json")
