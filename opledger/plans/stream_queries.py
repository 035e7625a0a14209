"""Streaming queries over the tables' files, run to their end; results come back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay
from ..streaming import builder
from .registry import query, shared_folder, table


def _run(spark: SparkSession, streamed: DataFrame, mode: str, folder: str) -> DataFrame:
    """Writes the stream's batches to a folder until the input ends; of an updating stream the last state of a key stays."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_no={number}")  # a batch that is run again replaces itself

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    job = streamed.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    job.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_lww(spark: SparkSession, d: str) -> DataFrame:
    """Replay as a stream: the same rows as the batch query."""
    folder = shared_folder(spark)
    out = _run(spark, builder.last_writes(_stream(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value"), "update", folder)
    return out.groupBy("user_id", "event_type").agg(F.max_by("value", "batch_no").alias("value"))


def _built(spark: SparkSession, ops: DataFrame) -> DataFrame:
    folder = shared_folder(spark)
    ops.write.parquet(f"{folder}/in")
    streamed = spark.readStream.schema(ops.schema).parquet(f"{folder}/in")
    return _run(spark, builder.append_builder(streamed), "append", folder)


def _splices(spark: SparkSession, d: str) -> DataFrame:
    placed = replay.cursors(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return placed.select(F.col("conv_id").cast("string").alias("history_id"), F.col("turn").cast("bigint").alias("patch_seq"), F.col("cursor").alias("start"), F.lit(0).cast("bigint").alias("removed"), "text")


@query("""SELECT conv_id::VARCHAR AS history_id, turn AS patch_seq, 'STRING_APPEND' AS mode, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS "cursor", (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS length FROM conversations""")
def stream_builder(spark: SparkSession, d: str) -> DataFrame:
    """The append builder over conversations: mode, cursor and length after every operation."""
    return _built(spark, _splices(spark, d)).select("history_id", "patch_seq", "mode", "cursor", "length")


_GENERATIONS = """(SELECT *, start = first_value(start) OVER (PARTITION BY conv_id, g ORDER BY turn) + coalesce(sum(length(text)) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS straight
FROM (SELECT conv_id, turn, text, sum(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) OVER w AS g, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS start
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"""


def _reset_splices(spark: SparkSession, d: str) -> DataFrame:
    odd = (F.col("patch_seq") % 4 == 3) & (F.col("history_id").cast("bigint") % 2 == 0)
    return _splices(spark, d).withColumns({"start": F.col("start") + F.when(odd, 1).otherwise(0), "reset": F.col("patch_seq") % 3 == 2})


@query(f"""SELECT conv_id::VARCHAR AS history_id, g::BIGINT AS generation, CASE WHEN bool_and(straight) THEN 'STRING_APPEND' ELSE 'GENERIC' END AS mode, count(*) AS length FROM {_GENERATIONS} GROUP BY ALL""")
def stream_builder_finish(spark: SparkSession, d: str) -> DataFrame:
    """Generations of histories that are reset on the way, finished: mode and number of patches."""
    return builder.finish(_built(spark, _reset_splices(spark, d))).select("history_id", "generation", "mode", "length")


@query(f"""SELECT conv_id::VARCHAR AS history_id, g::BIGINT AS generation, text, (row_number() OVER (PARTITION BY conv_id, g ORDER BY min(turn)) - 1)::BIGINT AS text_id FROM {_GENERATIONS} GROUP BY conv_id, g, text""")
def stream_builder_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of inserted texts of every generation."""
    return builder.dictionary(_built(spark, _reset_splices(spark, d)))
