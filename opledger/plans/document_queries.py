"""Mixed histories replayed onto documents, differences of documents, patches as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, framed, replay
from ..operators.model import LOG, checked
from ..sources import logs
from .frame_queries import SCHEMA_ID
from .registry import query, shared_folder, table

BASE = '{"list":[],"nested":{},"text":""}'


def _log(events: DataFrame) -> DataFrame:
    """One operation per event, of seven kinds by the event's number: the history of each user."""
    e, k = F.col("event_id"), F.col("event_id") % 7
    v = F.floor("value").cast("bigint").cast("string")
    reset = (k == 6) & (e % 4 == 0)
    path = (
        F.when(k == 2, F.array().cast("array<string>")).when(k.isin(3, 4), F.array(F.lit("list"))).when(k == 5, F.array(F.lit("text")))
        .when(reset, F.array(F.lit("nested"))).when(k == 6, F.array(F.lit("nested"), F.col("event_type"))).otherwise(F.array("event_type"))
    )
    given = {
        "op": F.when(k == 1, "REMOVE").when(k == 2, "ASSIGN").when(k == 3, "APPEND").when(k == 5, "STRING_SPLICE").otherwise("SET"), "path": path,
        "start": F.when(k == 5, 1 << 40), "removed": F.when(k == 5, 0), "text": F.when(k == 5, F.substring("event_type", 1, 1)),
        "fields": F.when(k == 2, F.array(F.col("event_type"), F.lit("z"))), "values": F.when(k == 2, F.array(v, e.cast("string"))).when(k == 3, F.array(v)),
        "value": F.when(k == 0, v).when(k == 4, F.concat(F.lit("["), e.cast("string"), F.lit("]"))).when(reset, "{}").when(k == 6, v),
    }
    keys = {"history_id": F.col("user_id").cast("string"), "patch_seq": e, "op_seq": F.lit(0)}
    return events.select(*[(keys | given).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields])


def _bases(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("history_id")).distinct().withColumn("document", F.lit(BASE))


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, written once: replay reads its log for each of its joins, and would compute a costly one as often."""
    folder = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _mixed_sql(where: str) -> str:
    return f"""WITH e AS (SELECT user_id, event_id, event_type, floor(value)::BIGINT AS v, event_id % 7 AS k FROM events {where}), u AS (SELECT DISTINCT user_id FROM events),
leaf AS (SELECT user_id, event_type AS key, arg_max({{'gone': k = 1, 'v': v}}, event_id) AS w FROM e WHERE k < 3 GROUP BY ALL), zed AS (SELECT user_id, max(event_id) AS v FROM e WHERE k = 2 GROUP BY 1),
r AS (SELECT user_id, max(event_id) FILTER (k = 4) AS l, max(event_id) FILTER (k = 6 AND event_id % 4 = 0) AS n FROM e GROUP BY 1),
lists AS (SELECT user_id, string_agg(CASE WHEN k = 4 THEN event_id ELSE v END::VARCHAR, ',' ORDER BY event_id) AS s FROM e JOIN r USING (user_id) WHERE k IN (3, 4) AND event_id >= coalesce(l, 0) GROUP BY 1),
inner_ AS (SELECT user_id, event_type AS key, arg_max(v, event_id) AS v FROM e JOIN r USING (user_id) WHERE k = 6 AND event_id % 4 <> 0 AND event_id > coalesce(n, -1) GROUP BY ALL),
nested AS (SELECT user_id, string_agg('"' || key || '":' || v, ',' ORDER BY key) AS s FROM inner_ GROUP BY 1), texts AS (SELECT user_id, string_agg(event_type[1], '' ORDER BY event_id) AS s FROM e WHERE k = 5 GROUP BY 1),
parts AS (SELECT user_id, key, '"' || key || '":' || w.v AS s FROM leaf WHERE NOT w.gone UNION ALL SELECT user_id, 'z', '"z":' || v FROM zed
 UNION ALL SELECT user_id, 'list', '"list":[' || coalesce(s, '') || ']' FROM u LEFT JOIN lists USING (user_id) UNION ALL SELECT user_id, 'nested', '"nested":{{' || coalesce(s, '') || '}}' FROM u LEFT JOIN nested USING (user_id)
 UNION ALL SELECT user_id, 'text', '"text":"' || coalesce(s, '') || '"' FROM u LEFT JOIN texts USING (user_id))
SELECT user_id::VARCHAR AS history_id, '{{' || string_agg(s, ',' ORDER BY key) || '}}' AS document FROM parts GROUP BY 1"""


@query(_mixed_sql(""))
def replay_mixed(spark: SparkSession, d: str) -> DataFrame:
    """SET, REMOVE, ASSIGN, APPEND, text and nested operations of one history, folded onto its document."""
    events = table(spark, d, "events")
    return documents.replay(_bases(events), checked(_log(events)))


@query(_mixed_sql("WHERE event_id < 600"))
def replay_mixed_until(spark: SparkSession, d: str) -> DataFrame:
    """The same at an earlier point; the bound reaches the scan."""
    events = table(spark, d, "events")
    return documents.replay(_bases(events), _log(events), 600)


@query("""WITH n AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS gone FROM events GROUP BY 1),
k AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events JOIN n USING (user_id) WHERE event_type <> 'error' AND event_id > coalesce(gone, -1) GROUP BY ALL)
SELECT user_id::VARCHAR AS history_id, '{"a":' || CASE WHEN count(event_type) = 0 THEN '{}' ELSE '{' || string_agg('"' || event_type || '":{"id":' || v || '}', ',' ORDER BY event_type) || '}' END || '}' AS document FROM n LEFT JOIN k USING (user_id) GROUP BY 1""")
def replay_nested_remove(spark: SparkSession, d: str) -> DataFrame:
    """REMOVE of a parent and its SET anew between writes below it: what stood below is gone."""
    events = table(spark, d, "events")
    again = F.col("event_type") == "error"
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    keys = {"history_id": F.col("user_id").cast("string"), "patch_seq": F.col("event_id")}

    def rows(part: DataFrame, seq: int, op: str, path, value=None) -> DataFrame:
        given = keys | {"op_seq": F.lit(seq).cast("bigint"), "op": F.lit(op), "path": path, "value": value}
        return part.select(*[given[f.name].alias(f.name) if given.get(f.name) is not None else none(f) for f in LOG.fields])

    top = F.array(F.lit("a"))
    log = rows(events.filter(again), 0, "REMOVE", top).unionByName(rows(events.filter(again), 1, "SET", top, F.lit("{}"))).unionByName(
        rows(events.filter(~again), 0, "SET", F.array(F.lit("a"), F.col("event_type")), F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))))
    base = _bases(events).withColumn("document", F.lit('{"a":{}}'))
    return documents.replay(base, log)


@query("""SELECT history_id, document FROM (""" + _mixed_sql("") + ")")
def diff_documents_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two states of nested documents, replayed onto the first: the second."""
    events = table(spark, d, "events")
    log = _log(events)
    early = documents.replay(_bases(events), log, 600).withColumnRenamed("document", "before")
    late = documents.replay(_bases(events), log).withColumnRenamed("document", "after")
    pairs = _kept(early.join(late, "history_id"))
    return documents.replay(pairs.select("history_id", F.col("before").alias("document")), _kept(documents.diff(pairs)))


@query("""SELECT user_id::VARCHAR AS history_id, event_id AS patch_seq, CASE event_id % 7 WHEN 1 THEN '[{"op":"REMOVE","path":["' || event_type || '"]}]'
 WHEN 5 THEN '[{"op":"STRING_SPLICE","path":["text"],"start":1099511627776,"removed":0,"text":"' || event_type[1] || '"}]' WHEN 3 THEN '[{"op":"APPEND","path":["list"],"values":["' || floor(value)::BIGINT || '"]}]'
 WHEN 2 THEN '[{"op":"ASSIGN","path":[],"fields":["' || event_type || '","z"],"values":["' || floor(value)::BIGINT || '","' || event_id || '"]}]' WHEN 4 THEN '[{"op":"SET","path":["list"],"value":"[' || event_id || ']"}]'
 WHEN 0 THEN '[{"op":"SET","path":["' || event_type || '"],"value":"' || floor(value)::BIGINT || '"}]'
 ELSE CASE WHEN event_id % 4 = 0 THEN '[{"op":"SET","path":["nested"],"value":"{}"}]' ELSE '[{"op":"SET","path":["nested","' || event_type || '"],"value":"' || floor(value)::BIGINT || '"}]' END END AS patch FROM events""")
def patch_texts(spark: SparkSession, d: str) -> DataFrame:
    """Patches of several kinds as JSON texts."""
    return documents.patch_texts(_log(table(spark, d, "events")))


@query(_mixed_sql(""))
def patch_texts_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Patches written as texts, read again and replayed."""
    events = table(spark, d, "events")
    return documents.replay(_bases(events), _kept(documents.read_patches(documents.patch_texts(_log(events)))))


_OBJECTS = """(SELECT event_id, {key} AS owner, unnest(CASE event_id % 3 WHEN 0 THEN [{{'key': 'score', 'v': floor(value)::BIGINT}}] WHEN 1 THEN [{{'key': 'score', 'v': floor(value)::BIGINT}}, {{'key': 'rank', 'v': event_id}}] ELSE [{{'key': event_type, 'v': event_id}}] END, recursive := true) FROM events)"""


def _merged_sql(key: str, name: str) -> str:
    return f"""SELECT owner AS {name}, '{{' || string_agg('"' || key || '":' || v, ',' ORDER BY key) || '}}' AS object FROM (SELECT owner, key, arg_max(v, event_id) AS v FROM {_OBJECTS.format(key=key)} GROUP BY ALL) GROUP BY 1"""


def _objects(spark: SparkSession, d: str, owner) -> DataFrame:
    e, v = F.col("event_id"), F.floor("value").cast("bigint").cast("string")
    score = F.concat(F.lit('{"score":'), v)
    text = F.when(e % 3 == 0, F.concat(score, F.lit("}"))).when(e % 3 == 1, F.concat(score, F.lit(',"rank":'), e.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"'), "event_type", F.lit('":'), e.cast("string"), F.lit("}")))
    return table(spark, d, "events").select(owner, "event_id", text.alias("object"))


@query(_merged_sql("event_id % 500", "idx"))
def replay_row_merge(spark: SparkSession, d: str) -> DataFrame:
    """Row object assignments with differing keys: the last write of every (row, key)."""
    return replay.merged_objects(_objects(spark, d, (F.col("event_id") % 500).alias("idx")), ["idx"], "object", ["event_id"])


@query(_merged_sql("user_id", "user_id"))
def replay_assign_open(spark: SparkSession, d: str) -> DataFrame:
    """ASSIGN history whose keys are not known beforehand."""
    return replay.merged_objects(_objects(spark, d, F.col("user_id")), ["user_id"], "object", ["event_id"])


@query(_mixed_sql(""))
def patch_frames_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Patches framed one by one, decoded to a log and replayed."""
    events = table(spark, d, "events")
    return documents.replay(_bases(events), _kept(framed.read_frames(framed.patch_frames(_log(events), SCHEMA_ID), SCHEMA_ID)))


@query(_mixed_sql(""))
def history_frames_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Whole histories framed, decoded into log files and replayed from these."""
    events = table(spark, d, "events")
    folder = f"{shared_folder(spark)}/log"
    logs.write_log(framed.read_frames(framed.history_frames(_log(events), SCHEMA_ID), SCHEMA_ID), folder, buckets=8)
    return documents.replay(_bases(events), logs.read_log(spark, folder))
