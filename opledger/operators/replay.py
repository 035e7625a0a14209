"""Replay of an operation log: the state after its first operations, without walking it one by one.

A log row is one operation: its place in the history (explicit columns), a path
key and a value.  Only the last write of a path counts, so replay is one partial
and one final aggregation; a bound on the place is a filter that reaches the scan.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def until(log: DataFrame, place: str | Column, bound: int | None) -> DataFrame:
    """Operations before `bound`; None means all."""
    if bound is None:
        return log
    if not isinstance(bound, int) or isinstance(bound, bool) or bound < 0:
        raise ValueError("the bound must be a non-negative integer")
    return log.filter(F.col(place) < bound if isinstance(place, str) else place < bound)


def numbered(log: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Places 0, 1, ... by a total order, without one task that sees all rows: ranges, then row numbers within them.

    The range of a row is a column, found by quantiles of the first order column (numbers, dates and times); without such a
    column one window numbers all.  Quantiles and sizes of ranges, one each a shuffle partition, are counted when this is
    called and stand in the plan as values.  A join with the sizes would have both sides compute the range from one scan's
    column, and the optimizer has put a filter on that column into the side that lacks it.
    """
    first, kind = order[0], dict(log.dtypes)[order[0]]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"):
        return log.withColumn(name, F.row_number().over(W.orderBy(*order)) - 1)
    stamp = (F.unix_micros(F.col(first).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(first)).cast("double")
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = log.select(F.percentile_approx(stamp, [i / parts for i in range(1, parts)] or [1.0], 10_000).alias("c")).first().c or []
    # how many cuts lie below the row, by halving; beyond the last cut stands null, which is not below
    steps, places = [1 << i for i in reversed(range(len(cuts).bit_length()))], F.array(*map(F.lit, cuts))
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: n + F.when(F.get(places, n + s - 1) < stamp, s).otherwise(0)) if cuts else F.lit(0)
    dealt = log.withColumn("_range", below)
    sizes = {r[0]: r[1] for r in dealt.groupBy("_range").agg(F.count("*")).collect()}
    bases = [0, *accumulate(sizes.get(i, 0) for i in range(len(cuts)))]
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, F.get(F.array(*[F.lit(b).cast("bigint") for b in bases]), F.col("_range")) + inside - 1).drop("_range")


def last_writes(log: DataFrame, path: list[str], place: list[str], values: list[str]) -> DataFrame:
    """The last value of every path."""
    by = F.struct(*place) if len(place) > 1 else F.col(place[0])
    last = F.max_by(F.struct(*values), by) if len(values) > 1 else F.max_by(values[0], by)
    grouped = log.groupBy(*path).agg(last.alias("last_"))
    return grouped.select(*path, *[(F.col("last_")[v] if len(values) > 1 else F.col("last_")).alias(v) for v in values])


def without_removed(log: DataFrame, path: list[str], place: list[str], value: str, removes: Column) -> DataFrame:
    """Last writes of paths whose last operation is not a removal."""
    flagged = log.withColumn("removed_", removes)
    return last_writes(flagged, path, place, [value, "removed_"]).filter("not removed_").drop("removed_")


def assigned_rows(base: DataFrame, position: str, log: DataFrame, index: str, place: list[str], fields: dict[str, str]) -> DataFrame:
    """base rows with the last assigned fields (column of base -> column of log) put in; positions outside change nothing."""
    last = last_writes(log, [index], place, list(dict.fromkeys(fields.values()))).withColumnRenamed(index, "index_")
    changed = last.select("index_", *[F.col(v).alias(f"new_{k}") for k, v in fields.items()])
    joined = base.join(changed, base[position] == changed["index_"], "left")
    return joined.select(*[F.when(F.col("index_").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def merged_objects(log: DataFrame, owner: list[str], text: str, place: list[str]) -> DataFrame:
    """owner, object (JSON text, keys sorted): assigned objects of any keys merged, the last write of every (owner, key)."""
    each = log.select(*owner, *place, F.explode(F.from_json(text, "map<string,variant>")).alias("key_", "value_"))
    last = last_writes(each.withColumn("value_", F.to_json("value_")), [*owner, "key_"], place, ["value_"])
    pairs = F.array_sort(F.collect_list(F.struct("key_", "value_")))
    parts = F.transform(pairs, lambda p: F.concat(F.to_json(F.array(p["key_"])), F.lit(":"), p["value_"]))
    # the key stands in a one-element array text: its brackets go
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r'^\[("(?:[^"\\]|\\.)*")\]', "$1"))
    return last.groupBy(*owner).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias(text))


def outside(base: DataFrame, position: str, log: DataFrame, index: str) -> DataFrame:
    """Operations whose row does not exist."""
    return log.join(base.select(F.col(position).alias(index)), index, "left_anti")


def appended(log: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Texts of a key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(place, text)))
    return log.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text))


def cursors(log: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Where each append starts: the length of all before it."""
    before = W.partitionBy(key).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("cursor", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)).cast("bigint"))
