"""Registry that pairs each Spark query with the SQL that checks it.

A query is declared with its output schema as ``"name:kind ..."`` where kind is
``l`` (whole number), ``d`` (double, rounded to 6 digits), ``s`` (text) or ``b`` (bool).  The same
projection is put on both sides, so types and rounding agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidex.plans.bindings import SHARED_SQL, Tables

_DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.select(*[_spark_column(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_column(n, k) for n, k in self.columns)
        return f"{_shared_prelude(self.sql)}SELECT {cols} FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Decorator: register ``fn(tables) -> DataFrame`` under ``name``."""
    spec = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, spec, fn, sql)
        return fn

    return wrap


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "l":
        c = c.cast("long")
    elif kind == "d":
        c = F.round(c.cast("double"), _DIGITS) + F.lit(0.0)
    elif kind == "s":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "l":
        c = f"CAST({c} AS BIGINT)"
    elif kind == "d":
        c = f"round(CAST({c} AS DOUBLE), {_DIGITS}) + 0.0"
    elif kind == "s":
        c = f"CAST({c} AS VARCHAR)"
    elif kind == "b":
        c = f"CAST({c} AS BOOLEAN)"
    return f'{c} AS "{name}"'


def _shared_prelude(sql: str) -> str:
    """WITH clause holding the shared bindings the text refers to, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SHARED_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SHARED_SQL[n]})" for n in needed) + "\n"
