"""Patches and whole histories in frames, and back to a log.

A patch frame (kind 1) holds the JSON text of one patch, a history frame (kind 2)
that of all patches of a history, so it is as large as the history; its metadata
name the history and the patch.  Reading refuses frames that are not well formed
or have another schema id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transport
from .documents import OPERATION, patch_texts
from .model import LOG

PATCH, HISTORY = 1, 2


def _metadata(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(values.items())]))


def patch_frames(log: DataFrame, schema_id: str) -> DataFrame:
    """history_id, patch_seq, frame of every patch."""
    # metadata are a column of their own: in a frame they stand several times
    texts = patch_texts(log).withColumn("meta", _metadata(history=F.col("history_id"), patch=F.col("patch_seq")))
    return texts.select("history_id", "patch_seq", transport.frame(F.lit(PATCH), F.lit(schema_id), F.col("meta"), F.col("patch")).alias("frame"))


def history_frames(log: DataFrame, schema_id: str) -> DataFrame:
    """history_id, frame of every history."""
    names = [f.name for f in LOG.fields][3:]
    ops = log.groupBy("history_id", "patch_seq").agg(F.array_sort(F.collect_list(F.struct("op_seq", F.struct(*names).alias("o")))).alias("p"))
    patches = ops.select("history_id", F.struct("patch_seq", F.transform("p", lambda x: x["o"]).alias("ops")).alias("patch"))
    whole = patches.groupBy("history_id").agg(F.to_json(F.array_sort(F.collect_list("patch"), lambda x, y: (x["patch_seq"] - y["patch_seq"]).cast("int"))).alias("patches"))
    return whole.select("history_id", transport.frame(F.lit(HISTORY), F.lit(schema_id), _metadata(history=F.col("history_id")), F.col("patches")).alias("frame"))


def read_frames(frames: DataFrame, schema_id: str | None = None) -> DataFrame:
    """The log of frames of both kinds (column frame); schema_id, if given, must be theirs."""
    rows = transport.with_header(frames.select("frame"))
    wrong = transport.frame_error(F.col("frame"), F.col("header"))
    if schema_id is not None:
        wrong = F.coalesce(wrong, F.when(~F.col("header.schema_id").eqNullSafe(F.lit(schema_id)), "schema"))
    text = F.decode(transport.frame_payload(F.col("frame"), F.col("header")), "UTF-8")
    sound = F.when(wrong.isNull(), text).otherwise(F.raise_error(F.concat(F.lit("frame refused: "), wrong)).cast("string"))
    # spark_partition_id() keeps filters above this projection: pushed into it, they would hold every step of the header, and the frame, thousands of times
    meta = F.when(F.spark_partition_id() >= 0, F.from_json("header.metadata", "history string, patch bigint"))
    read = rows.select(F.col("header.kind").alias("kind"), meta.alias("m"), sound.alias("payload"))
    one = F.when(F.col("kind") == PATCH, F.array(F.struct(F.col("m.patch").alias("patch_seq"), F.from_json("payload", f"array<{OPERATION}>").alias("ops"))))
    many = F.from_json(F.when(F.col("kind") == HISTORY, F.col("payload")), f"array<struct<patch_seq:bigint,ops:array<{OPERATION}>>>")
    patches = read.select(F.col("m.history").alias("history_id"), F.explode(F.coalesce(one, many)).alias("p"))
    return patches.select("history_id", "p.patch_seq", F.posexplode("p.ops").alias("op_seq", "o")).select("history_id", "patch_seq", F.col("op_seq").cast("bigint"), "o.*")
