"""Incremental histories on Structured Streaming.

append_builder keeps, per history, the cursor of an append-only text: operations
that start at the cursor extend it, any other one demotes the history to the
general log until it is reset.  State is small: cursor, count, mode and generation;
texts go out as they come and are joined by replay.  An operation with `reset`
begins a new generation of its history.

Operations of a history are taken in the order of patch_seq inside a micro-batch
and in the order of batches; one that comes with a smaller patch_seq than an
earlier batch held raises an error, for its place is already taken.

finish() closes what the stream has written: modes and dictionaries of generations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "history_id string, generation bigint, patch_seq bigint, start bigint, text string, mode string, cursor bigint, length bigint"
STATE = "cursor bigint, length bigint, appending boolean, generation bigint, last bigint"


def checked_splices(ops: DataFrame) -> DataFrame:
    """Refuses operations without a text or with negative numbers."""
    good = F.col("text").isNotNull() & (F.col("start") >= 0) & (F.col("removed") >= 0)
    return ops.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("a splice needs a text and numbers that are not negative")).cast("boolean")))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cursor, length, appending, generation, last = state.get if state.exists else (-1, 0, True, 0, -1)
    rows = pd.concat(list(batches)).sort_values("patch_seq")
    if len(rows) and int(rows["patch_seq"].iloc[0]) <= last:
        raise ValueError(f"history {key[0]}: patch {int(rows['patch_seq'].iloc[0])} came after patch {last}")
    out = []
    for seq, start, removed, text, reset in zip(*(rows[c].tolist() for c in ("patch_seq", "start", "removed", "text", "reset"))):
        if reset:
            cursor, length, appending, generation = -1, 0, True, generation + 1
        appending = bool(appending and removed == 0 and cursor in (-1, start))
        if appending:
            cursor = int(start) + len(text)
        length, last = length + 1, int(seq)
        out.append((key[0], generation, seq, start, text, "STRING_APPEND" if appending else "GENERIC", cursor, length))
    state.update((cursor, length, appending, generation, last))
    yield pd.DataFrame(out, columns=["history_id", "generation", "patch_seq", "start", "text", "mode", "cursor", "length"])


def append_builder(ops: DataFrame) -> DataFrame:
    """Streamed splices (history_id, patch_seq, start, removed, text and, if wanted, reset) with the mode and cursor that each leaves."""
    reset = F.coalesce("reset", F.lit(False)) if "reset" in ops.columns else F.lit(False)
    return checked_splices(ops).withColumn("reset", reset).groupBy("history_id").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def finish(built: DataFrame) -> DataFrame:
    """history_id, generation, mode, length, cursor of what a builder has written: one demoted operation makes its generation general, also before it."""
    mode = F.when(F.every(F.col("mode") == "STRING_APPEND"), "STRING_APPEND").otherwise("GENERIC")
    return built.groupBy("history_id", "generation").agg(mode.alias("mode"), F.max("length").alias("length"), F.max_by("cursor", "patch_seq").alias("cursor"))


def dictionary(built: DataFrame) -> DataFrame:
    """history_id, generation, text, text_id: the distinct inserted texts of each generation, numbered by first sight."""
    seen = built.groupBy("history_id", "generation", "text").agg(F.min("patch_seq").alias("first_seq"))
    place = F.row_number().over(W.partitionBy("history_id", "generation").orderBy("first_seq")) - 1
    return seen.select("history_id", "generation", "text", place.cast("bigint").alias("text_id"))


def last_writes(events: DataFrame, path: list[str], place: list[str], value: str) -> DataFrame:
    """The streaming form of replay: an update-mode aggregate."""
    return events.groupBy(*path).agg(F.max_by(value, F.struct(*place)).alias(value))
