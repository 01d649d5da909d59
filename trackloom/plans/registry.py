"""Registry of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is the same result in ANSI SQL for the check."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that two engines' summation orders do not show."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # adding 0.0 turns a negative zero into zero
            column = (_nearest(column, digits) + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _nearest(column: Column, digits: int) -> Column:
    """As SQL rounds: the product with the power of ten is rounded, not the decimal text of the double."""
    scaled = column.cast("double") * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**digits)).otherwise(column.cast("double"))


def select(columns: str, source: str, ctes: list[str], tail: str = "") -> str:
    """``WITH ctes SELECT columns FROM source``; ``~name`` or ``~expr AS name`` rounds to 6 digits."""
    out = []
    for item in _split(columns):
        if item.startswith("~"):
            body = item[1:].strip()
            expr, _, alias = body.rpartition(" AS ")
            if not expr:
                expr, alias = body, body
            out.append(f"round({expr}, 6) + 0.0 AS {alias}")
        else:
            out.append(item)
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM {source} {tail}"


def _split(columns: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in columns:
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
            continue
        depth += ch in "(["
        depth -= ch in ")]"
        current += ch
    if current.strip():
        parts.append(current.strip())
    return parts
