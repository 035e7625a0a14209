"""Storage modes of histories and layouts of patches, and what their detectors look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import layouts
from ..operators.model import LOG
from .registry import query, table

def op(kind: str, path=(), **given) -> Column:
    """An operation as a struct with the columns of a log; texts and numbers may be columns."""
    column = lambda v: v if isinstance(v, Column) else F.array(*map(column, v)) if isinstance(v, (list, tuple)) else F.lit(v)
    given = {"op": kind, "path": path} | given
    return F.struct(*[(column(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields[3:]])


def _patch_log(rows: DataFrame, history: Column, patch: Column, ops: Column) -> DataFrame:
    each = rows.select(history.cast("string").alias("history_id"), patch.cast("bigint").alias("patch_seq"), F.posexplode(ops).alias("op_seq", "o"))
    return each.select("history_id", "patch_seq", F.col("op_seq").cast("bigint"), "o.*")


@query("""WITH e AS (SELECT *, user_id % 7 AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
s AS (SELECT user_id, u, event_id, event_type, 10 + 3 * place + CASE WHEN user_id % 2 = 1 AND event_type = 'signup' THEN 1 ELSE 0 END AS start, place FROM e),
f AS (SELECT user_id, any_value(u) AS u, count(*) AS patches, count(DISTINCT event_type) AS kinds, bool_and(start = f + 3 * place) AS straight FROM (SELECT *, first_value(start) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM s) GROUP BY 1)
SELECT user_id::VARCHAR AS history_id, patches, CASE WHEN patches < 8 THEN 'GENERIC' WHEN u = 0 THEN 'SET_COLUMNS' WHEN u = 1 THEN CASE WHEN user_id % 2 = 0 OR kinds = 1 THEN 'ASSIGN_COLUMNS' ELSE 'GENERIC' END WHEN u = 2 THEN 'ROW_FIELD_ASSIGN'
 WHEN u = 3 THEN CASE WHEN user_id % 2 = 0 THEN 'ROW_OBJECT_ASSIGN_INTEGERS' ELSE 'ROW_OBJECT_ASSIGN' END WHEN u = 4 THEN CASE WHEN straight THEN 'STRING_APPEND' ELSE 'STRING_SPLICE' END WHEN u = 5 THEN 'STRING_SPLICE'
 WHEN kinds = 1 THEN 'SET_COLUMNS' ELSE 'GENERIC' END AS mode FROM f""")
def history_mode(spark: SparkSession, d: str) -> DataFrame:
    """Modes of histories made of each user's events, of one or two operations per patch; whether shapes hold is up to the events."""
    u, kind, even = F.col("user_id") % 7, F.col("event_type"), F.col("user_id") % 2 == 0
    v, place = F.floor("value").cast("bigint").cast("string"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    events = table(spark, d, "events").withColumn("place", place)
    later = 10 + 3 * F.col("place") + F.when(~even & (kind == "signup"), 1).otherwise(0)
    objects = F.concat(F.lit('{"score":'), v, F.lit(',"rank":'), F.when(even, F.col("event_id").cast("string")).otherwise(F.lit('"x"')), F.lit("}"))
    row = [F.col("event_id") % 9, F.col("event_id") % 5 + 9]
    ops = (
        F.when(u == 0, F.array(op("SET", ["a"], value=v), op("SET", ["b", "c"], value=v)))
        .when(u == 1, F.array(op("ASSIGN", [], fields=[F.lit("score"), F.when(even, "rank").otherwise(kind)], values=[v, v])))
        .when(u == 2, F.array(op("ARRAY_OBJECT_FIELD_ASSIGN", ["rows"], idx=row, fields=["score", "rank"], values=[v, v, v, v]), op("SET", ["last"], value=v)))
        .when(u == 3, F.array(op("ARRAY_OBJECT_ASSIGN", ["rows"], idx=row, values=[objects, objects])))
        .when(u == 4, F.array(op("STRING_SPLICE", ["t"], start=later, removed=0, text="abc"))).when(u == 5, F.array(op("STRING_SPLICE", ["t"], start=0, removed=0, text="abc")))
        .otherwise(F.array(op("SET", [kind], value=v)))
    )
    return layouts.history_modes(_patch_log(events, F.col("user_id"), F.col("event_id"), ops))


@query("""SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'ROOT_SPLICE_COPY' WHEN 1 THEN CASE WHEN event_type <> 'view' THEN 'ROOT_SPLICE' ELSE 'OP_STREAM' END WHEN 2 THEN CASE WHEN even THEN 'ROOT_APPEND_RUN' ELSE 'OP_STREAM' END WHEN 3 THEN 'REMOVE_ASSIGN'
 WHEN 4 THEN CASE WHEN even THEN 'ROOT_ASSIGN' ELSE 'OP_STREAM' END WHEN 5 THEN CASE WHEN even THEN 'ASSIGN_OBJECT' ELSE 'OP_STREAM' END WHEN 6 THEN CASE WHEN even THEN 'SMALL_STRUCTURAL' ELSE 'OP_STREAM' END
 WHEN 7 THEN CASE WHEN even THEN 'ROWS_BY_FIELD' ELSE 'OP_STREAM' END WHEN 8 THEN CASE WHEN even THEN 'ROWS_BY_OBJECT' ELSE 'OP_STREAM' END WHEN 9 THEN CASE WHEN even THEN 'SET_PATHS_INTEGERS' ELSE 'SET_PATHS' END
 WHEN 11 THEN 'PLAIN' ELSE 'OP_STREAM' END AS layout FROM (SELECT *, user_id % 2 = 0 AS even FROM events)""")
def patch_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout of one patch per event: thirteen kinds, each within the limits of a layout or just outside, as the event has it."""
    e, kind, even = F.col("event_id"), F.col("event_type"), F.col("user_id") % 2 == 0
    v = F.floor("value").cast("bigint")
    text, either = v.cast("string"), lambda x, y: F.when(even, x).otherwise(y)
    numbers = [(v + i * either(1, 2)).cast("string") for i in range(4)]
    changed = [F.concat(F.lit('{"value":'), text, F.lit(',"changed":'), either(F.lit("true"), F.lit("false")), F.lit("}"))] * 4
    spots = [F.lit(0), F.lit(3), F.lit(6), either(F.lit(9), F.lit(10))]
    splice = op("STRING_SPLICE", [], start=1, removed=0, text=kind)
    made = [
        F.array(splice, op("STRING_COPY", [], start=0, removed=2, idx=[3])),
        F.array(F.when(kind == "view", op("STRING_SPLICE", ["t"], start=1, removed=0, text=kind)).otherwise(splice)),
        F.array(op("APPEND", [], values=numbers)),
        F.array(op("REMOVE", [kind]), op("ASSIGN", [], fields=[kind], values=[text])),
        F.array(op("ASSIGN", [], fields=[either(F.lit("f1"), F.lit("a")), either(F.lit("f20"), F.lit("b"))], values=[text, text])),
        F.array(op("ASSIGN", ["x"], fields=["a"], values=[either(F.lit("[1,2]"), F.lit('"s"'))])),
        F.array(op("ARRAY_SPLICE", ["x"], start=0, removed=1, values=[text]), op("ASSIGN", ["y"], fields=["a"], values=[text]), op("SET", ["z"], value=either(text, F.lit('{"q":1}')))),
        F.array(op("ARRAY_OBJECT_FIELD_ASSIGN", [], idx=spots, fields=["value", "changed"], values=[text, "true"] * 4)),
        F.array(op("ARRAY_OBJECT_ASSIGN", [], idx=[0, 2, 4, 6], values=changed)),
        F.array(*[op("SET", ["r", str(i), kind], value=either(text, F.lit('"s"'))) for i in range(16)]),
        F.array(*[op("SET", [str(i)], value=text) for i in range(16)]),
        F.array(op("MERGE", [], value=text)),
        F.array(op("APPEND", ["x"], values=[text]), op("SET", ["y"], value=text)),
    ]
    ops = made[0]
    for i, x in enumerate(made[1:], 1):
        ops = F.when(e % 13 == i, x).otherwise(ops)
    log = _patch_log(table(spark, d, "events"), F.lit("all"), e, ops)
    return layouts.patch_layouts(log).select(F.col("patch_seq").alias("event_id"), "layout")


@query("""SELECT event_id // 2 AS pair, count(DISTINCT event_type) = 1 AS type_constant, count(DISTINCT user_id) = 1 AS user_constant, count(*) >= 2 AS enough FROM events GROUP BY 1""")
def path_template(spark: SparkSession, d: str) -> DataFrame:
    """Which segments of the paths of two events are constant."""
    same = lambda c: F.min(c) == F.max(c)
    pair = F.floor(F.col("event_id") / 2).alias("pair")
    return table(spark, d, "events").groupBy(pair).agg(same("event_type").alias("type_constant"), same("user_id").alias("user_constant"), (F.count("*") >= 2).alias("enough"))


@query("""SELECT event_id, ['null', 'boolean', 'integer', 'string', 'array', 'object', 'double'][(event_id % 7 + 1)::INT] AS kind FROM events""")
def json_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The tag of JSON values, by their parsed form."""
    samples = ("null", "true", "12", '"x"', "[1]", '{"a":1}', "1.5")
    text = F.get(F.array(*map(F.lit, samples)), (F.col("event_id") % 7).cast("int"))
    shape = F.schema_of_variant(F.parse_json(text))
    kind = F.when(shape == "VOID", "null").when(shape == "BOOLEAN", "boolean").when(shape == "BIGINT", "integer").when(shape == "STRING", "string").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("double")
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


@query("""SELECT user_id, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS keys, count(DISTINCT event_type) AS n FROM events GROUP BY 1""")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sorted key set of every object."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("keys"), F.count_distinct("event_type").alias("n"))
