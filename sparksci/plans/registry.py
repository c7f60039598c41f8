"""How queries are registered: a function of (spark, sf_dir) and, where SQL can say it, its counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4


def settled_digits(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating columns rounded, so that sums in another order compare equal; adding 0 turns -0 into 0."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: settled_digits(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def r(expression: str, name: str = "") -> str:
    """SQL of a rounded value."""
    return f"round({expression}, {DIGITS}) + 0.0" + (f" AS {name}" if name else "")
