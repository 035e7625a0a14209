"""Replay, difference, log files and streams."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from opledger.operators import diff, layouts, model, replay
from opledger.sources import logs
from opledger.streaming import builder


def test_until_rejects_bad_bounds(spark):
    log = spark.range(5)
    assert replay.until(log, "id", None).count() == 5 and replay.until(log, "id", 3).count() == 3 and replay.until(log, "id", 99).count() == 5
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            replay.until(log, "id", bad)


def test_numbered_is_dense(spark):
    df = spark.range(0, 500).withColumn("x", F.hash("id"))
    got = replay.numbered(df, "x", "id").orderBy("x", "id").collect()
    assert [r.place for r in got] == list(range(500))


def test_numbered_with_nulls_ties_and_any_number_of_ranges(spark):
    df = spark.range(0, 300).selectExpr("id", "if(id % 5 = 0, null, id % 7) AS x", "CAST(NULL AS double) AS y", "if(id % 9 = 0, double('NaN'), id / 3) AS z")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 20):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for first in "xyz":
                got = replay.numbered(df, first, "id").orderBy(first, "id").collect()
                assert [r.place for r in got] == list(range(300)), (parts, first)
            assert replay.numbered(df.filter("id < 0"), "x", "id").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_as_the_first_query_of_a_session(data):
    """What the optimizer infers depends on the numbers of columns, so a new session is needed."""
    code = f"""
from pyspark.sql import SparkSession
from opledger.plans import catalogue
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
print("rows", len(catalogue.QUERIES["replay_until_place"](spark, {data!r}).collect()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-3000:]


def test_other_path_after_a_splice_does_not_disturb_it(spark):
    """A splice on one path and a SET on another are replayed each on its own path."""
    log = spark.createDataFrame([("a", 0, "xyz"), ("b", 1, "1"), ("a", 2, "q"), ("b", 3, None)], "path string, seq int, value string")
    got = {r.path: r.value for r in replay.last_writes(log, ["path"], ["seq"], ["value"]).collect()}
    assert got["a"] == "q" and set(got) == {"a", "b"}


def test_diff_then_apply_gives_the_target(spark):
    r = random.Random(5)
    for _ in range(3):
        before = [(i, r.choice("ab"), r.choice([None, 1, 2])) for i in range(30) if r.random() < 0.8]
        after = [(i, r.choice("ab"), r.choice([None, 1, 2])) for i in range(40) if r.random() < 0.7]
        a, b = (spark.createDataFrame(x, "k int, s string, n int") for x in (before, after))
        assert diff.same_rows(diff.apply(a, diff.diff(a, b, "k"), "k"), b).isEmpty()
        assert diff.diff(a, a, "k").isEmpty()


def test_log_files_round_trip(spark, tmp_path):
    rows = [("h1", p, 0, "SET", ["x"], None, None, None, None, None, None, str(p)) for p in range(20)] + [("h2", 0, 0, "REMOVE", ["x"]) + (None,) * 7]
    log = spark.createDataFrame(rows, model.LOG)
    logs.write_log(log, f"{tmp_path}/log")
    assert logs.read_log(spark, f"{tmp_path}/log").count() == 21
    assert logs.read_log(spark, f"{tmp_path}/log", "h1", until=7).count() == 7
    bad = spark.createDataFrame([("h", 0, 0, "SET", ["x"]) + (None,) * 7], model.LOG)
    with pytest.raises(Exception, match="bad operation"):
        model.checked(bad).collect()


def test_history_modes(spark):
    def history(name, n, *ops):
        made = []
        for i in range(n):
            for k, op in enumerate(ops):
                row = dict.fromkeys(model.LOG.names) | {"history_id": name, "patch_seq": i, "op_seq": k, "path": ["p"]} | {c: v(i) if callable(v) else v for c, v in op.items()}
                made.append([row[c] for c in model.LOG.names])
        return made

    put, append = {"op": "SET", "value": "1"}, {"op": "STRING_SPLICE", "start": lambda i: 4 + 2 * i, "removed": 0, "text": "ab"}
    ints, objects = ({"op": "ARRAY_OBJECT_ASSIGN", "idx": [0, 4], "values": ['{"a":1,"b":%s}' % v, '{"b":3,"a":4}']} for v in ("2", '"x"'))
    fields = {"op": "ARRAY_OBJECT_FIELD_ASSIGN", "idx": [1, 2], "fields": ["x"], "values": ["1", "2"]}
    rows = (
        history("few", 7, put) + history("set", 8, put) + history("columns", 8, put, put | {"path": ["q", "r"]}) + history("paths", 9, put | {"path": lambda i: [str(i)]})
        + history("assign", 8, {"op": "ASSIGN", "fields": lambda i: ["b", "a"] if i % 2 else ["a", "b"], "values": ["1", "2"]}) + history("keys", 8, {"op": "ASSIGN", "fields": lambda i: [str(i)], "values": ["1"]})
        + history("append", 9, append) + history("splice", 9, append | {"removed": 1}) + history("two", 9, append, put) + history("ints", 8, ints) + history("objects", 8, objects)
        + history("fields", 8, fields, put | {"path": ["last"]}) + history("uneven", 8, fields | {"values": ["1"]}) + history("trailing", 8, fields, append)
    )
    log = spark.createDataFrame(rows, model.LOG)
    got = {r.history_id: r.mode for r in layouts.history_modes(log).collect()}
    assert got == {
        "few": "GENERIC", "set": "SET_COLUMNS", "columns": "SET_COLUMNS", "paths": "GENERIC", "assign": "ASSIGN_COLUMNS", "keys": "GENERIC", "append": "STRING_APPEND", "splice": "STRING_SPLICE", "two": "GENERIC",
        "ints": "ROW_OBJECT_ASSIGN_INTEGERS", "objects": "ROW_OBJECT_ASSIGN", "fields": "ROW_FIELD_ASSIGN", "uneven": "GENERIC", "trailing": "GENERIC",
    }


def test_builder_demotes_for_good(spark, tmp_path):
    ops = [("h", 0, 0, 0, "ab"), ("h", 1, 2, 0, "c"), ("h", 2, 0, 1, "x"), ("h", 3, 3, 0, "d"), ("k", 0, 5, 0, "z")]
    schema = "history_id string, patch_seq bigint, start bigint, removed bigint, text string"
    spark.createDataFrame(ops, schema).write.parquet(f"{tmp_path}/in")
    streamed = builder.append_builder(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    job = streamed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {(r.history_id, r.patch_seq): r.mode for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("h", 0): "STRING_APPEND", ("h", 1): "STRING_APPEND", ("h", 2): "GENERIC", ("h", 3): "GENERIC", ("k", 0): "STRING_APPEND"}
