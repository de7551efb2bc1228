"""Binding a value once inside an expression.

A column used twice is two expressions, and one used inside a lambda is evaluated for every element. let() evaluates it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later steps may use often; they aren't merged into those steps."""
    x = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", x.alias("_once")).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def exploded(df: DataFrame, name: str, array: Column) -> DataFrame:
    """df with a row for each element of an array. explode() would also filter by the array's size, which evaluates a costly
    array twice, the first time before any shuffle in between."""
    return df.select("*", F.posexplode_outer(array).alias("_at", name)).filter("_at is not null").drop("_at")
