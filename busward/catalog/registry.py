"""Registered queries: a Spark callable, its result columns, and equivalent DuckDB SQL.

The column list (`name` text, `name:i` integer, `name:d` double at six digits) shapes both results
alike. SQL bodies may name any registered common table expression; the needed ones are prepended.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from busward.plans.adapters import Tables

_CTES: dict[str, str] = {}
# Moves exact decimal ties (0.4157005) off the rounding edge, alike in both engines.
NUDGE = 1e-10


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    body: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        shaped = []
        for name, kind in self.columns:
            value = F.col(name)
            if kind == "i":
                value = value.cast("bigint")
            elif kind == "d":
                value = F.round(value.cast("double") + NUDGE, 6) + F.lit(0.0)
            shaped.append(value.alias(name))
        return df.select(*shaped)

    def sql(self) -> str | None:
        if self.body is None:
            return None
        shaped = []
        for name, kind in self.columns:
            if kind == "i":
                shaped.append(f"CAST({name} AS BIGINT) AS {name}")
            elif kind == "d":
                shaped.append(f"round(CAST({name} AS DOUBLE) + {NUDGE!r}, 6) + 0e0 AS {name}")
            else:
                shaped.append(name)
        return with_ctes(f"SELECT {', '.join(shaped)} FROM (\n{self.body}\n) AS result")


QUERIES: dict[str, Query] = {}


def cte(**bodies: str) -> None:
    """Register common table expressions; later ones may name earlier ones."""
    _CTES.update(bodies)


def with_ctes(body: str) -> str:
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", todo.pop()))
        for name in words & _CTES.keys() - needed:
            needed.add(name)
            todo.append(_CTES[name])
    parts = [f"{n} AS (\n{b}\n)" for n, b in _CTES.items() if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, columns: str, sql: str | None = None):
    """Register a query under a name."""
    spec = tuple(tuple(c.split(":")) if ":" in c else (c, "s") for c in columns.split())

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, spec, build, sql)
        return build

    return register
