"""What the operators of this subpackage share: scratch folders, bounded batches, word cuts."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, give or take one document.
BATCH_BYTES = 1 << 20
#: Rows with texts that cross to a Python worker in one Arrow batch, whatever the session says; texts may be long.
BATCH_ROWS = 512
#: For encoders, which look up each distinct word of a batch once.
LARGE_BYTES, LARGE_ROWS = 2 << 20, 1024
_GIVEN: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a run on one machine gets a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, lost executors lose nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what kept() wrote for these; nothing may read them any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "kept_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner find finished shuffles, whose files stay on the executors' disks until the driver collects garbage."""
    gc.collect()  # handles of finished plans
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, most: int = BATCH_ROWS) -> DataFrame:
    """df, after the session's Arrow batches are set to at most so many rows, or fewer if it had fewer: mapInArrow has no such parameter of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = _GIVEN.setdefault(df.sparkSession.sparkContext.applicationId, int(conf.get(name)))
    conf.set(name, str(min(given, most) if given > 0 else most))
    return df


def sided(keys: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """Key rows (kept) as the side of a join: broadcast where they are counted to be few, else left to a shuffle."""
    return F.broadcast(keys) if keys.count() <= most_rows else keys


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose column holds about `most` bytes; one row may hold more."""
    for batch in batches:
        values = batch.column(column)
        if batch.num_rows == 0:
            continue
        if values.nbytes <= most:
            yield batch
            continue
        lengths = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
        sizes = np.fromiter((0 if v is None else v for v in pa.compute.binary_length(lengths).to_pylist()), np.int64, batch.num_rows)
        groups = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def by_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema, column: str, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with bounded slices; work returns a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    typed = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names = [f.name for f in typed.fields]

    def run(batches):
        arrow = to_arrow_schema(typed)
        for part in slices(batches, column, most):
            made = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return bounded(df, rows).mapInArrow(run, typed)


def crc_of_id(column: str | Column) -> Column:
    """crc32 of the decimal text of an id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod modulus is remainder; a null id is not held out."""
    return F.coalesce(crc_of_id(column) % modulus == remainder, F.lit(False))


#: Whether a byte ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_END = np.zeros(256, bool)
WORD_END[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place of none)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased (A-Z) words in order, and the number of words of each text.

    A word is a run of characters outside blank, \\t, \\n, \\v, \\f and \\r.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~WORD_END[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    ends_of_texts = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers("up", _P, n)[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers("down", _INV, n)[starts]
    return mix(hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), counts
