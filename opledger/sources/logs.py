"""Reading and writing operation logs, frames and streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transport import with_header
from ..operators.model import LOG, checked


def write_log(log: DataFrame, path: str, buckets: int = 64) -> None:
    """A log as Parquet, partitioned by a hash of the history so that one history is read from one folder; sorted within files."""
    placed = log.withColumn("bucket", F.pmod(F.xxhash64("history_id"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", F.floor(F.col("patch_seq") / 1_000_000)).sortWithinPartitions("bucket", "history_id", "patch_seq", "op_seq").write.partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, history_id: str | None = None, until: int | None = None, buckets: int = 64, validate: bool = True) -> DataFrame:
    """A log, or one history of it; the bound on patch_seq reaches the scan."""
    log = spark.read.parquet(path)
    if history_id is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(history_id)), F.lit(buckets)).cast("int")).first()[0]
        log = log.filter((F.col("bucket") == bucket) & (F.col("history_id") == history_id))
    if until is not None:
        log = log.filter(F.col("patch_seq") < until)
    log = log.drop("bucket")
    return checked(log) if validate else log


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of log files as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames with their header fields beside them, so that inspection never reads a payload."""
    with_header(frames).write.parquet(path)


def inspect_frames(spark: SparkSession, path: str) -> DataFrame:
    """Headers only; the scan leaves the payload column out."""
    return spark.read.parquet(path).select("frame_id", "header.*")
