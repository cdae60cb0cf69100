"""The list of runnable queries: Spark side and SQL side under one declared result schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.session import use_utc

# Dates are given out as ISO text, which reads the same everywhere.
_SQL_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    columns: tuple[tuple[str, str], ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(part.split()) for part in text.split(","))  # type: ignore[misc]


def _typed(name: str, kind: str) -> Column:
    value = F.col(name).cast(kind)
    return (value.cast("string") if kind == "date" else value).alias(name)


def _typed_sql(name: str, kind: str) -> str:
    value = f"CAST({name} AS {_SQL_TYPES[kind]})"
    return f"{f'CAST({value} AS VARCHAR)' if kind == 'date' else value} AS {name}"


def query(key: str, columns: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; both sides are cast to ``columns`` so that names and types agree."""
    spec = _columns(columns)

    def add(run: Run) -> Run:
        def typed(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return run(spark, folder).select(*[_typed(name, kind) for name, kind in spec])

        wrapped = None
        if sql is not None:
            casts = ", ".join(_typed_sql(name, kind) for name, kind in spec)
            wrapped = f"SELECT {casts} FROM (\n{sql}\n) AS result"
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, spec, typed, wrapped)
        return run

    return add
