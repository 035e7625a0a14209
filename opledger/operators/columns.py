"""Column encoders over tables: dictionaries, modes, bit packing, runs and index-set choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import encodings as enc

#: A run of fewer consecutive indexes is no chunk of its own.
LEAST_RUN = 4
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def dictionary(df: DataFrame, value: str, place: str, name: str) -> DataFrame:
    """value, first_seen and an id in the order of first sight.

    Values are grouped first, so the ranking sees each once; for dictionaries
    that do not fit one task use replay.numbered on the grouped table.
    """
    seen = df.groupBy(value).agg(F.min(place).alias("first_seen"))
    return seen.withColumn(name, (F.dense_rank().over(W.orderBy("first_seen")) - 1).cast("bigint"))


def field_modes(df: DataFrame) -> DataFrame:
    """field, mode: CONST, BOOL, INT, STRING or GENERIC for every column, by one aggregation over the table."""
    flags = df.agg(*[F.coalesce(F.min(F.col(c)).eqNullSafe(F.max(F.col(c))) & (F.count("*") == F.count(c)), F.lit(False)).alias(c) for c in df.columns])
    kinds = {c: "INT" if t in INTEGERS else "BOOL" if t == "boolean" else "STRING" if t == "string" else "GENERIC" for c, t in df.dtypes}
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.col(c), "CONST").otherwise(kinds[c]).alias("mode")) for c in df.columns])
    return flags.select(F.explode(rows).alias("r")).select("r.field", "r.mode")


def pack_bits(df: DataFrame, place: str, flag: Column) -> DataFrame:
    """byte_no, bits: flags at places as bits of bytes, lowest first."""
    byte, bit = F.floor(F.col(place) / 8).alias("byte_no"), (F.col(place) % 8).cast("int")
    return df.groupBy(byte).agg(F.sum(F.when(flag, F.call_function("shiftleft", F.lit(1), bit)).otherwise(0)).cast("bigint").alias("bits"))


def unpack_bits(packed: DataFrame, places: DataFrame, place: str, name: str) -> DataFrame:
    """The flag at every place."""
    byte = F.floor(F.col(place) / 8)
    joined = places.withColumn("byte_no", byte).join(packed, "byte_no")
    return joined.select(place, (F.getbit("bits", (F.col(place) % 8).cast("int")) == 1).alias(name))


def runs(df: DataFrame, key: str, index: str) -> DataFrame:
    """key, first_id, length of the maximal runs of consecutive indexes."""
    island = F.col(index) - F.row_number().over(W.partitionBy(key).orderBy(index))
    return df.select(key, index, island.alias("island")).groupBy(key, "island").agg(F.min(index).alias("first_id"), F.count("*").alias("length")).drop("island")


def elias_fano(df: DataFrame, key: str, index: str) -> DataFrame:
    """key, index, low_part and high_bit of every entry of increasing lists."""
    w = W.partitionBy(key)
    rows = df.select(key, index, F.count("*").over(w).alias("n"), F.min(index).over(w).alias("a"), F.max(index).over(w).alias("b"), (F.row_number().over(w.orderBy(index)) - 1).alias("pos"))
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), enc.elias_fano_low_bits(F.col("n"), F.col("b") - F.col("a")).cast("int"))
    v = F.col(index) - F.col("a")
    return rows.select(key, index, (v % unit).alias("low_part"), (F.floor(v / unit) + F.col("pos")).alias("high_bit"))


def chunks(lists: DataFrame, key: str, index: str) -> DataFrame:
    """key, first_id, length, run, bytes: increasing lists cut to runs of four or more consecutive indexes and what lies between them."""
    by = W.partitionBy(key)
    rows = lists.select(key, index, F.lag(index).over(by.orderBy(index)).alias("before"), (F.col(index) - F.row_number().over(by.orderBy(index))).alias("island"))
    island = W.partitionBy(key, "island")
    sized = rows.select(key, index, "before", F.count("*").over(island).alias("held"), F.min(index).over(island).alias("a"))
    begins = ((F.col("held") >= LEAST_RUN) & (F.col(index) == F.col("a"))).cast("bigint")
    placed = sized.withColumn("longs", F.sum(begins).over(by.orderBy(index))).withColumn("run", F.col("held") >= LEAST_RUN)
    placed = placed.withColumn("chunk", F.when(F.col("run"), F.col("a")).otherwise(-1 - F.col("longs")))
    whole = placed.withColumn("first_id", F.min(index).over(W.partitionBy(key, "chunk")))
    steps = F.sum(F.when(~F.col("run") & (F.col(index) > F.col("first_id")), enc.varint_length(F.col(index) - F.col("before"))).otherwise(0))
    found = whole.groupBy(key, "chunk", "first_id", "run").agg(F.count("*").alias("length"), steps.alias("steps"))
    return found.select(key, "first_id", "length", "run", (1 + enc.varint_length(F.col("length")) + enc.varint_length(F.col("first_id")) + F.col("steps")).alias("bytes"))


def index_choice(lists: DataFrame, key: str, index: str) -> DataFrame:
    """key, n, the bytes of three encodings (tag and length included; null where one does not apply) and the encoding that an increasing list gets."""
    n, lo, hi = F.col("n"), F.col("a"), F.col("b")
    step = F.col(index) - F.lag(index).over(W.partitionBy(key).orderBy(index))
    sizes = lists.select(key, index, step.alias("step")).groupBy(key).agg(
        F.count("*").alias("n"), F.min(index).alias("a"), F.max(index).alias("b"), F.min("step").alias("least"), F.max("step").alias("most"),
        F.sum(enc.varint_length(F.coalesce("step", index))).alias("deltas"),
    )
    cut = chunks(lists, key, index).groupBy(key).agg(F.count("*").alias("pieces"), F.sum("bytes").alias("pieces_bytes"))
    chunked = F.when((n >= 8) & (F.col("pieces") > 1), 1 + enc.varint_length(n) + enc.varint_length(F.col("pieces")) + F.col("pieces_bytes"))
    fano = F.when((n >= 32) & (enc.elias_fano_low_bits(n, hi - lo) <= 24), 1 + enc.elias_fano_bytes(n, lo, hi))
    sized = sizes.join(cut, key).select("*", (1 + enc.varint_length(n) + F.col("deltas")).alias("delta_bytes"), chunked.alias("chunked_bytes"), fano.alias("elias_fano_bytes"))
    choice = (
        F.when((n > 1) & (hi - lo + 1 == n), "RUN").when((n > 2) & (F.col("least") == F.col("most")) & (F.col("least") > 1), "ARITHMETIC").when(n <= 2, "RAW")
        .when(F.col("chunked_bytes") < F.col("delta_bytes"), "CHUNKED").when(F.col("chunked_bytes").isNull() & (F.col("elias_fano_bytes") + 16 < F.col("delta_bytes")), "ELIAS_FANO")
        .otherwise("DELTA")
    )
    return sized.select(key, "n", "delta_bytes", "chunked_bytes", "elias_fano_bytes", choice.alias("encoding"))


def history_index_form(a: Column) -> Column:
    """The form of an index list inside a history: RUN, BITMAP, DELTA or RAW, by its order and greatest member."""
    steps = F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)
    every = lambda f: F.forall(steps, f)
    return (
        F.when((F.size(a) >= 4) & every(lambda s: s == 1), "RUN").when((F.size(a) >= 8) & every(lambda s: s > 0) & (F.element_at(a, -1) < 64) & (F.get(a, F.lit(0)) >= 0), "BITMAP")
        .when((F.size(a) >= 4) & every(lambda s: s >= 0), "DELTA").otherwise("RAW")
    )


def uint_form(a: Column) -> Column:
    """The form of a list of unsigned numbers: PERIODIC, ARITHMETIC, DELTA or RAW; the first that fits."""
    steps = F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)
    return (
        F.when((F.size(a) >= 8) & enc.shortest_period(a).isNotNull(), "PERIODIC").when((F.size(a) >= 2) & (F.size(F.array_distinct(steps)) == 1) & (F.get(steps, F.lit(0)) >= 0), "ARITHMETIC")
        .when(F.forall(steps, lambda s: s >= 0), "DELTA").otherwise("RAW")
    )
