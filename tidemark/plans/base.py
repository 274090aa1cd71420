"""What query modules share: registration, relations in SQL, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import SQL

Query = Callable[[SparkSession, str], DataFrame]


def unsigned_zeros(sql: str) -> str:
    """`sql` with 0 added to each round(...): it may round to a negative zero there, which Spark's never does."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += f"{sql[at:i]}(round({unsigned_zeros(sql[i + len('round('):j - 1])}) + 0)"
        at = j
    return out + sql[at:]


class Registry:
    """Queries by name, with their equivalent in DuckDB SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = unsigned_zeros(sql)
            return f

        return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, and timestamps without zone as they are: what both engines give alike."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_(body: str, *names: str, **extra: str) -> str:
    """`body` after a WITH of named relations (and of those they need), then of extra ones."""
    need = []
    for n in names:
        need += [x for x in (["macro1"] if n == "macro" else []) if x not in need] + ([n] if n not in need else [])
    parts = [f"{n} AS ({SQL[n]})" for n in need] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}"


def r(*cols: str, digits: int = 6, **named: str) -> str:
    """SQL: columns (or expressions by name) rounded."""
    return ", ".join([f"round({c}, {digits}) AS {c}" for c in cols] + [f"round({x}, {digits}) AS {k}" for k, x in named.items()])
