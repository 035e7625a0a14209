"""Replay, text and difference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays, diff, replay
from ..operators.model import valid_operation
from .registry import query, table

TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def replay_lww(spark: SparkSession, d: str) -> DataFrame:
    """SET history: the last value of every path."""
    return replay.last_writes(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE event_id < 600 GROUP BY ALL")
def replay_until(spark: SparkSession, d: str) -> DataFrame:
    """The state after the operations with sequence numbers below a bound; the bound reaches the scan."""
    log = replay.until(table(spark, d, "events"), "event_id", 600)
    return replay.last_writes(log, ["user_id", "event_type"], ["event_id"], ["value"])


@query("""SELECT user_id, event_type, arg_max(value, place) AS value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events) WHERE place < 700 GROUP BY ALL""")
def replay_until_place(spark: SparkSession, d: str) -> DataFrame:
    """The state after the first operations by time order, places being numbered without a global window."""
    log = replay.until(replay.numbered(table(spark, d, "events"), "ts", "event_id"), "place", 700)
    return replay.last_writes(log, ["user_id", "event_type"], ["place"], ["value"])


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'error') AS error,
arg_max(value, event_id) FILTER (event_type = 'purchase') AS purchase, arg_max(value, event_id) FILTER (event_type = 'signup') AS signup, arg_max(value, event_id) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id""")
def replay_assign_columns(spark: SparkSession, d: str) -> DataFrame:
    """ASSIGN history with known keys: the last value of every key, one column each, in one aggregation."""
    last = [F.max_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id"))).alias(t) for t in TYPES]
    return table(spark, d, "events").groupBy("user_id").agg(*last)


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN e.i IS NOT NULL THEN e.v ELSE o_totalprice END AS o_totalprice FROM orders
LEFT JOIN (SELECT event_id % 1000 AS i, arg_max(value, event_id) AS v FROM events GROUP BY 1) e ON o_orderkey = e.i""")
def replay_row_fields(spark: SparkSession, d: str) -> DataFrame:
    """Row field assignments on a record table: the last value per row, put in by a left join on the row's place."""
    log = table(spark, d, "events").select((F.col("event_id") % 1000).alias("idx"), "event_id", "value")
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return replay.assigned_rows(base, "o_orderkey", log, "idx", ["event_id"], {"o_totalprice": "value"})


@query("""SELECT o_orderkey, CASE WHEN e.i IS NOT NULL THEN e.w.t ELSE o_orderstatus END AS o_orderstatus, CASE WHEN e.i IS NOT NULL THEN e.w.v ELSE o_totalprice END AS o_totalprice FROM orders
LEFT JOIN (SELECT event_id % 1500 AS i, arg_max({'t': event_type, 'v': value}, event_id) AS w FROM events GROUP BY 1) e ON o_orderkey = e.i""")
def replay_row_objects(spark: SparkSession, d: str) -> DataFrame:
    """Row object assignments: two fields of a row change together."""
    log = table(spark, d, "events").select((F.col("event_id") % 1500).alias("idx"), "event_id", "event_type", "value")
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return replay.assigned_rows(base, "o_orderkey", log, "idx", ["event_id"], {"o_orderstatus": "event_type", "o_totalprice": "value"})


@query("SELECT event_id, event_id * 3 AS idx FROM events WHERE event_id * 3 NOT IN (SELECT o_orderkey FROM orders)")
def replay_row_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Assignments to rows that do not exist."""
    log = table(spark, d, "events").select("event_id", (F.col("event_id") * 3).alias("idx"))
    return replay.outside(table(spark, d, "orders"), "o_orderkey", log, "idx").select("event_id", "idx")


@query("""SELECT user_id, event_type, v.value AS value FROM (SELECT user_id, event_type, arg_max({'value': value, 'gone': value < 20}, event_id) AS v FROM events GROUP BY ALL) WHERE NOT v.gone""")
def replay_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """REMOVE: paths whose last operation is a removal are gone."""
    return replay.without_removed(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"], "value", F.col("value") < 20)


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_append(spark: SparkSession, d: str) -> DataFrame:
    return replay.appended(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE turn < 3 GROUP BY conv_id")
def text_append_until(spark: SparkSession, d: str) -> DataFrame:
    return replay.appended(replay.until(table(spark, d, "conversations"), "turn", 3), "conv_id", "turn", "text")


@query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "cursor" FROM conversations""")
def text_append_cursor_check(spark: SparkSession, d: str) -> DataFrame:
    return replay.cursors(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "cursor")


@query("SELECT doc_id, text[1:least(5, length(text))] || '<new>' || text[least(5, length(text)) + 4:] AS text FROM documents")
def text_splice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", arrays.text_splice(F.col("text"), 5, 3, "<new>").alias("text"))


@query("SELECT doc_id, text[1:least(10, length(text))] || text[3:8] || text[least(10, length(text)) + 1:] AS text FROM documents")
def text_copy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", arrays.text_copy(F.col("text"), 10, 2, 6).alias("text"))


@query("""WITH a AS (SELECT doc_id, 'A' || text[3:] AS t FROM documents), b AS (SELECT doc_id, t[1:least(4, length(t))] || 'BB' || t[least(4, length(t)) + 1:] AS t FROM a)
SELECT doc_id, t[1:least(1, length(t))] || t[least(1, length(t)) + 4:] AS text FROM b""")
def text_splice_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Three splices in order on every text, as one fold."""
    steps = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(r).alias("removed"), F.lit(i).alias("inserted")) for s, r, i in ((0, 2, "A"), (4, 0, "BB"), (1, 3, ""))])
    return table(spark, d, "documents").select("doc_id", arrays.text_replay(F.col("text"), steps).alias("text"))


_AFTER = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey + 1000000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 = 0)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    changed = before.filter(k % 11 != 0).withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return before, changed.unionByName(before.filter(k % 13 == 0).withColumn("o_orderkey", k + 1000000000000))


@query(f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'I' WHEN b.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op, b.o_orderstatus, b.o_totalprice
FROM orders a FULL JOIN {_AFTER} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def diff_upsert(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, d), "o_orderkey")


@query("SELECT NULL::BIGINT AS o_orderkey, NULL::VARCHAR AS o_orderstatus, NULL::DOUBLE AS o_totalprice, NULL::BIGINT AS surplus WHERE false")
def diff_apply_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """apply(before, diff(before, after)) against after: no row is left."""
    before, after = _snapshots(spark, d)
    return diff.same_rows(diff.apply(before, diff.diff(before, after, "o_orderkey"), "o_orderkey"), after)


@query(f"SELECT a.o_orderkey, 'o_orderstatus' AS field, b.o_orderstatus AS value FROM orders a JOIN {_AFTER} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def diff_fields(spark: SparkSession, d: str) -> DataFrame:
    """The same difference as one SET per changed field."""
    return diff.field_patches(*_snapshots(spark, d), "o_orderkey", ["o_orderstatus"])


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN event_id % 4 <> 0 WHEN 3 THEN false WHEN 4 THEN true ELSE event_id % 10 <> 5 END AS valid FROM events""")
def assert_patch(spark: SparkSession, d: str) -> DataFrame:
    """Arity and argument checks on a log with bad operations put in."""
    e = F.col("event_id")
    log = table(spark, d, "events").select(
        "event_id",
        F.element_at(F.array(*map(F.lit, ("SET", "REMOVE", "TRUNCATE", "NO_SUCH", "STRING_SPLICE", "ARRAY_ASSIGN"))), (e % 6 + 1).cast("int")).alias("op"),
        F.array(F.col("user_id").cast("string"), "event_type").alias("path"),
        F.when(e % 6 == 2, F.when(e % 4 == 0, -1).otherwise(3)).when(e % 6 == 4, 1).cast("bigint").alias("start"),
        F.when(e % 6 == 4, 2).cast("bigint").alias("removed"),
        F.when(e % 6 == 4, "x").alias("text"),
        F.when(e % 6 == 5, F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("idx"),
        F.when(e % 6 == 5, F.when(e % 10 == 5, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2")))).alias("values"),
        F.when(e % 6 == 0, F.col("value").cast("string")).alias("value"),
    )
    return log.select("event_id", valid_operation(set(log.columns)).alias("valid"))
