"""Registry of named queries: each takes (spark, folder) and returns a DataFrame; most have an SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded, all integers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(r6(F.col(f"`{f.name}`")).alias(f.name) if kind == "double" else F.col(f"`{f.name}`").cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else F.col(f"`{f.name}`"))
    return df.select(*out)
