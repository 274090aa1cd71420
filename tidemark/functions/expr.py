"""Column expressions that operators share, as SQL text that names its columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def E(sql: str) -> Column:
    """An expression whose fractional literals are doubles; SQL's own would be decimals, and their quotients cut short."""
    return F.expr(_DECIMAL.sub(r"\1D", sql))


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column: missing has one form."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def over(key: str = "symbol", ts: str = "ts", back: int | None = None, ahead: int = 0) -> str:
    """OVER clause of a key's rows in time order; back: rows of the frame before the current one."""
    base = f"PARTITION BY {key} ORDER BY {ts}"
    return f"OVER ({base})" if back is None else f"OVER ({base} ROWS BETWEEN {back} PRECEDING AND {'CURRENT ROW' if not ahead else f'{ahead} FOLLOWING'})"


def framed(agg: str, arg: str, n: int, least: int | None = None, key: str = "symbol", ts: str = "ts") -> str:
    """An aggregate over the last n rows; NULL until `least` (n, if not given) values are there."""
    w = over(key, ts, n - 1)
    return f"CASE WHEN count({arg}) {w} >= {n if least is None else least} THEN {agg}({arg}) {w} END"


def clip(x: str, lo: float, hi: float) -> str:
    """Bounded to [lo, hi]; a missing value gives hi."""
    return f"greatest({lo:.1f}, least({hi:.1f}, {x}))"


def safe_tanh(x: str) -> str:
    """tanh; a missing value gives 0."""
    return f"coalesce(tanh({x}), 0.0)"


def ewm_rows(alpha: float) -> int:
    """Rows of one key that the closed form takes before its weights overflow."""
    return int(700 / -math.log1p(-alpha))
