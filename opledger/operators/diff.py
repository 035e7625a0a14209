"""Keyed difference of two tables, and its application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows (key, op, new values): I for new keys, D for lost ones, U where a column differs (nulls are equal)."""
    names = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = after.select(F.col(key).alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in names])
    joined = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in names])
    op = F.when(F.col("a_key").isNull(), "I").when(F.col("b_key").isNull(), "D").when(differs, "U")
    return joined.withColumn("op", op).filter("op is not null").select(F.coalesce("a_key", "b_key").alias(key), "op", *[F.col(f"b_{c}").alias(c) for c in names])


def field_patches(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One SET (key, field, value as text) per changed field of keys on both sides."""
    a = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in fields])
    b = after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("value")) for c in fields])
    exploded = a.join(b, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["value"]))).alias("p"))
    return exploded.select(key, "p.field", "p.value")


def apply(before: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The table after a patch that diff() gave."""
    kept = before.join(patch.select(key), key, "left_anti")
    return kept.unionByName(patch.filter("op <> 'D'").drop("op").select(*before.columns))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand a different number of times on the two sides; empty for equal tables."""
    names = a.columns
    counted = a.withColumn("surplus", F.lit(1)).unionByName(b.withColumn("surplus", F.lit(-1)))
    return counted.groupBy(*names).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")
