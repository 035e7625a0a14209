"""Array operations on integer arrays made of the embedding vectors; results are joined texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays
from .registry import query, table

_A = "[floor(x::DOUBLE * 1000)::BIGINT for x in embedding]"


def _ints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("a"))


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias("a")


def _sql(expression: str) -> str:
    return f"SELECT vec_id, array_to_string({expression}, ',') AS a FROM (SELECT vec_id, label, {_A} AS a FROM embeddings)"


@query(_sql("a[1:label + 3]"))
def array_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("vec_id", _text(arrays.truncate(F.col("a"), F.col("label") + 3)))


@query(_sql("list_concat(a, [vec_id, 7])"))
def array_append(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("vec_id", _text(arrays.append(F.col("a"), F.array("vec_id", F.lit(7).cast("bigint")))))


@query(_sql("list_concat(list_concat(a[1:5], [vec_id, -1, -2]), a[5 + label + 1:])"))
def array_splice(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.col("vec_id"), F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))
    return _ints(spark, d).select("vec_id", _text(arrays.splice(F.col("a"), 5, F.col("label"), values)))


@query(_sql("list_concat(list_concat(a[2:label + 1], [a[1]]), a[label + 2:])"))
def array_move(spark: SparkSession, d: str) -> DataFrame:
    return _ints(spark, d).select("vec_id", _text(arrays.move(F.col("a"), 0, F.col("label"))))


@query(_sql("[CASE WHEN i - 1 = label THEN -5 WHEN i - 1 = 20 THEN vec_id ELSE x END for x, i in a]"))
def array_assign(spark: SparkSession, d: str) -> DataFrame:
    idx = F.array(F.lit(20), F.lit(900), "label").cast("array<bigint>")
    values = F.array(F.col("vec_id"), F.lit(1).cast("bigint"), F.lit(-5).cast("bigint"))
    return _ints(spark, d).select("vec_id", _text(arrays.assign(F.col("a"), idx, values)))


@query("""SELECT vec_id, array_to_string([array_to_string([CASE WHEN i = 3 AND j = 2 THEN -9 WHEN i = 1 AND j - 1 = label % 4 THEN vec_id ELSE y END for y, j in r], ',') for r, i in [a[1:4], a[5:8], a[9:12], a[13:16]]], ';') AS a
FROM (SELECT vec_id, label, [floor(x::DOUBLE * 1000)::BIGINT for x in embedding] AS a FROM embeddings)""")
def tuple_assign(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    rows = F.array(*[F.slice(a, 1 + 4 * i, 4) for i in range(4)])
    done = arrays.tuple_assign(rows, F.array(F.lit(2), F.lit(0)).cast("array<bigint>"), F.array(F.lit(1), F.col("label") % 4).cast("array<bigint>"), F.array(F.lit(-9).cast("bigint"), F.col("vec_id")))
    return _ints(spark, d).select("vec_id", F.array_join(F.transform(done, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";").alias("a"))


@query(_sql("[vec_id, label::BIGINT, 0]"))
def scalar_replace(spark: SparkSession, d: str) -> DataFrame:
    """SCALAR_ARRAY_REPLACE: a new array in the old one's place."""
    new = F.array(F.col("vec_id"), F.col("label").cast("bigint"), F.lit(0).cast("bigint"))
    return _ints(spark, d).select("vec_id", _text(arrays.scalars(new, lambda x: x.isNotNull())))


@query("""SELECT vec_id, array_to_string([z.k || ':' || z.v for z in list_concat(list_concat([{'k': a[1], 'v': a[2]}], [{'k': a[3], 'v': a[5]}, {'k': a[4], 'v': a[6]}]), [{'k': a[7], 'v': a[8]}])], ',') AS a
FROM (SELECT vec_id, [floor(x::DOUBLE * 1000)::BIGINT for x in embedding] AS a FROM embeddings)""")
def two_field_insert(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    pair = lambda i, j: F.struct(F.get(a, F.lit(i)).alias("k"), F.get(a, F.lit(j)).alias("v"))
    done = arrays.two_field_insert(F.array(pair(0, 1), pair(6, 7)), 1, F.slice(a, 3, 2), F.slice(a, 5, 2), ("k", "v"))
    return _ints(spark, d).select("vec_id", F.array_join(F.transform(done, lambda z: F.concat_ws(":", z["k"].cast("string"), z["v"].cast("string"))), ",").alias("a"))


@query("""SELECT idx, field, arg_max(value, (event_id, p)) AS value FROM (
  SELECT event_id, (event_id + p // 2) % 50 AS idx, CASE p % 2 WHEN 0 THEN 'score' ELSE 'rank' END AS field, value + p AS value, p FROM events, (SELECT unnest([0, 1, 2, 3]) AS p)) GROUP BY ALL""")
def array_object_field_assign(spark: SparkSession, d: str) -> DataFrame:
    """Row-major values of field assignments, taken apart by place, then the last write of (row, field)."""
    log = table(spark, d, "events").select(
        "event_id", F.array(F.col("event_id") % 50, (F.col("event_id") + 1) % 50).alias("idx"), F.array(F.lit("score"), F.lit("rank")).alias("fields"),
        F.array(*[F.col("value") + i for i in range(4)]).alias("values"),
    )
    placed = log.select("event_id", F.posexplode(arrays.field_cells(F.col("idx"), F.col("fields"), F.col("values"))).alias("p", "c")).select("event_id", "p", "c.*")
    return placed.groupBy("idx", "field").agg(F.max_by("value", F.struct("event_id", "p")).alias("value"))


@query("""SELECT vec_id, len(a) >= 4 AND len(list_distinct(a)) = 1 AS repeated, len(list_filter(a, lambda x: x <> floor(x))) = 0 AS ints
FROM (SELECT vec_id, [CASE label % 3 WHEN 0 THEN floor(x::DOUBLE) WHEN 1 THEN round(x::DOUBLE, 1) ELSE x::DOUBLE END for x in embedding[1:3 + label % 2]] AS a FROM embeddings)""")
def repeat_array(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of one repeated scalar, and arrays of integers only, among rounded and unrounded vectors."""
    x3 = F.col("label") % 3
    part = F.slice("embedding", F.lit(1), (F.lit(3) + F.col("label") % 2).cast("int"))
    a = F.transform(part, lambda x: F.when(x3 == 0, F.floor(x.cast("double")).cast("double")).when(x3 == 1, F.round(x.cast("double"), 1)).otherwise(x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"))
    return rows.select("vec_id", ((F.size("a") >= 4) & (F.size(F.array_distinct("a")) == 1)).alias("repeated"), F.forall("a", lambda x: x == F.floor(x)).alias("ints"))
