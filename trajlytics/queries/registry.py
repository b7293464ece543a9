"""Registered queries: a Spark callable, an output spec, and (where possible) a check query.

Spec: ``name`` or ``name:type`` separated by blanks. Types: s string, i bigint, b boolean,
d double rounded to six decimals, dN double rounded to N decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registered:
    spec: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Rounding offset. Slightly off one half, so that values lying exactly between two roundings (sums
# of short decimals) round the same way whatever the summation order.
TIE = 0.500173

REGISTRY: dict[str, Registered] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) if ":" in f else (f, "s") for f in spec.split()]


def project(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            m = float(10 ** int(kind[1:] or 6))
            c = F.floor(c.cast("double") * F.lit(m) + F.lit(TIE)) / F.lit(m)
        out.append(c.alias(name))
    return df.select(*out)


def project_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _fields(spec):
        if kind == "s":
            e = f"CAST({name} AS VARCHAR)"
        elif kind == "i":
            e = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            e = f"CAST({name} AS BOOLEAN)"
        else:
            m = f"1e{int(kind[1:] or 6)}"
            e = f"CAST(FLOOR(CAST({name} AS DOUBLE) * {m} + {TIE}) / {m} AS DOUBLE)"
        out.append(f"{e} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS checked"


def register(name: str, spec: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Registered(spec, fn, project_sql(sql, spec) if sql else None)
        return fn

    return wrap


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(r: Registered):
        return lambda spark, sf_dir: project(r.run(spark, sf_dir), r.spec)

    return {n: bind(r) for n, r in REGISTRY.items()}


def checks() -> dict[str, str]:
    return {n: r.sql for n, r in REGISTRY.items() if r.sql}
