"""The query registry: a name, the Spark build and, where it exists, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.plans.views import Inputs, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Inputs], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, oracle(sql) if sql else None)
        return fn

    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, folder, q=q: q.build(Inputs(spark, folder))) for n, q in REGISTRY.items()}


def sql_queries() -> dict[str, str]:
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}


def shown_map(m: Column) -> Column:
    """A map as sorted k=v text, so that both engines give a plain column."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))), ";")


def half_even_sql(num: str, den: str, digits: int) -> str:
    """Half-even quotient in whole-number arithmetic, 0 for a zero divisor."""
    scale = 10**digits
    t, d = f"(({num}) * {scale})", f"({den})"
    up = f"CASE WHEN 2 * ({t} % {d}) > {d} OR (2 * ({t} % {d}) = {d} AND ({t} // {d}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({t} // {d} + {up} AS DOUBLE) / {scale} END"
