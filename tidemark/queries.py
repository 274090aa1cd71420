"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import evaluation, intake, known, market, storage, trading

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (market, known, evaluation, trading, storage, intake):
    QUERIES |= _module.R.queries
    ORACLE |= _module.R.oracle
