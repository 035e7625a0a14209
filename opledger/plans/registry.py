"""Where queries and their SQL are kept under one name."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where the session names none, a run on one machine gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.match(r"local(\[|$)", spark.sparkContext.master):
        base = tempfile.mkdtemp(prefix="query-")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"
