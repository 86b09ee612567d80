"""Payloads without a fixed schema: VARIANT columns, paths that may be absent, and what shapes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def opened(df: DataFrame, column: str, out: str = "payload") -> DataFrame:
    """df with the JSON text as a VARIANT; null where it is no JSON."""
    return df.withColumn(out, F.try_parse_json(F.col(column)))


def path(payload: str, where: str, kind: str) -> Column:
    """The value at a path as a type; null where the path is absent or holds another type that does not cast."""
    return F.try_variant_get(F.col(payload), where, kind)


def typed(df: DataFrame, fields: dict[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """df with a column for each field (path, type); one scan of the payload serves them all, and a new path needs no new schema."""
    return df.select("*", *[path(payload, where, kind).alias(name) for name, (where, kind) in fields.items()])


def shapes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(shape, n): the schemas of the payloads and how many have each."""
    return df.groupBy(F.schema_of_variant(F.col(payload)).alias("shape")).agg(F.count("*").alias("n"))


def exploded(df: DataFrame, payload: str, where: str, name: str) -> DataFrame:
    """A row for each element of the array at a path, as VARIANT; rows without one are left out."""
    return df.withColumn(name, F.explode(F.try_variant_get(F.col(payload), where, "array<variant>")))
