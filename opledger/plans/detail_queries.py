"""Readers and inverse forms: expansion of index sets, columnar records, flattened objects, path segments, JSON equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import encodings as enc
from ..operators import columns, layouts
from .encoding_queries import _PARTS, _small_lists
from .registry import query, table


@query("SELECT user_id, event_id FROM events")
def index_expand(spark: SparkSession, d: str) -> DataFrame:
    """Runs (first, length) back to the ids."""
    runs = columns.runs(table(spark, d, "events"), "user_id", "event_id")
    return runs.select("user_id", F.explode(F.sequence("first_id", F.col("first_id") + F.col("length") - 1)).alias("event_id"))


@query("SELECT o_orderkey, unnest([o_orderkey, o_orderkey + 7, o_orderkey + 14, o_orderkey + 21]) AS idx FROM orders")
def index_arithmetic_expand(spark: SparkSession, d: str) -> DataFrame:
    """(length, start, step) back to the indexes."""
    coded = table(spark, d, "orders").select("o_orderkey", F.lit(4).alias("n"), F.lit(7).alias("step"))
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("o_orderkey") + F.col("step") * i)
    return coded.select("o_orderkey", F.explode(places).alias("idx"))


@query("""SELECT user_id, event_id FROM events""")
def index_elias_fano_decode(spark: SparkSession, d: str) -> DataFrame:
    """Low parts and high bits back to the ids; header fields come from one aggregate."""
    events = table(spark, d, "events")
    parts = columns.elias_fano(events, "user_id", "event_id").select("user_id", "low_part", "high_bit")
    head = events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("user_id").orderBy("high_bit")) - 1
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), enc.elias_fano_low_bits(F.col("n"), F.col("b") - F.col("a")).cast("int"))
    return parts.join(head, "user_id").select("user_id", ((F.col("high_bit") - place) * unit + F.col("low_part") + F.col("a")).alias("event_id"))


@query("""SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS n_nationkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name, count(*) AS n FROM nation GROUP BY 1""")
def record_columnar(spark: SparkSession, d: str) -> DataFrame:
    """Record arrays as one list per field."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("r"))
    return lists.select("n_regionkey", F.array_join(F.transform("r", lambda x: x["n_nationkey"].cast("string")), ",").alias("n_nationkey"), F.array_join("r.n_name", ",").alias("n_name"), F.size("r").cast("bigint").alias("n"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Columnar records back to rows."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("r")).select("n_regionkey", F.col("r.n_nationkey").alias("k"), F.col("r.n_name").alias("s"))
    return lists.select("n_regionkey", F.inline(F.arrays_zip("k", "s"))).select("n_regionkey", F.col("k").alias("n_nationkey"), F.col("s").alias("n_name"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || ',"type":"' || event_type || '","user":' || user_id || '}' AS object FROM events""")
def assign_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Objects flattened to one value per key and put together again."""
    pairs = F.array(
        F.struct(F.lit("user").alias("name"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value")),
        F.struct(F.lit("type").alias("name"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("value")),
    )
    flat = table(spark, d, "events").select("event_id", F.inline(pairs))
    text = F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["value"]))
    return flat.groupBy("event_id").agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("object"))


@query(f"""SELECT l_orderkey, array_to_string([a[i % p + 1] for i in range(10)], '') AS joined FROM (SELECT l_orderkey, a, list_filter(range(1, least(65, len(a))), lambda p: len(list_filter(range(p + 1, len(a) + 1), lambda i: a[i] <> a[i - p])) = 0)[1] AS p FROM {_PARTS}) WHERE p IS NOT NULL""")
def periodic_join(spark: SparkSession, d: str) -> DataFrame:
    """The first ten items of a periodic list joined: whole periods repeated, then a prefix."""
    lists = _small_lists(spark, d).select("l_orderkey", "a", enc.shortest_period(F.col("a")).cast("int").alias("p")).filter("p is not null")
    part = lambda n: F.array_join(F.transform(F.slice("a", F.lit(1), n), lambda x: x.cast("string")), "")
    return lists.select("l_orderkey", F.concat(F.repeat(part(F.col("p")), F.floor(F.lit(10) / F.col("p")).cast("int")), part(F.lit(10) % F.col("p"))).alias("joined"))


@query("""SELECT event_id, 0::BIGINT AS pos, 'int' AS kind, user_id::VARCHAR AS segment FROM events UNION ALL SELECT event_id, 1, 'string', event_type FROM events""")
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    """Path texts taken apart into tagged segments."""
    text = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]'))
    paths = table(spark, d, "events").select("event_id", F.posexplode(F.from_json(text, "array<variant>")).alias("pos", "v"))
    kind = F.when(F.schema_of_variant("v") == "STRING", "string").otherwise("int")
    return paths.select("event_id", F.col("pos").cast("bigint"), kind.alias("kind"), F.variant_get("v", "$", "string").alias("segment"))


@query("""SELECT event_id, ['NULL', 'BOOL', 'INT', 'STRING', 'BOOL_OBJECT', 'STRINGS', 'INTS', 'OTHER', 'OTHER'][(event_id % 9 + 1)::INT] AS kind FROM events""")
def assign_value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The compact form that an assigned value gets."""
    samples = ("null", "false", "-7", '"x"', '{"k":true}', '["a","b"]', "[1,2,3]", "1.5", '{"a":1,"b":2}')
    text = F.get(F.array(*map(F.lit, samples)), (F.col("event_id") % 9).cast("int"))
    return table(spark, d, "events").select("event_id", layouts.assign_value_kind(text).alias("kind"))


@query("SELECT event_id, true AS same, event_id % 2 = 0 AS other FROM events")
def json_equal(spark: SparkSession, d: str) -> DataFrame:
    """Deep equality of JSON texts by their canonical forms: another key order is equal, another value is not."""
    k = F.get_json_object("props", "$.k")
    one, two = F.concat(F.lit('{"a":1.0,"k":'), k, F.lit("}")), F.concat(F.lit('{ "k" : '), k, F.lit(', "a" : 1 }'))
    three = F.when(F.col("event_id") % 2 == 0, two).otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"a":2}')))
    forms = table(spark, d, "events").select("event_id", *[canonical.canonical_json(t)["text"].alias(n) for t, n in ((one, "x"), (two, "y"), (three, "z"))])
    return forms.select("event_id", (F.col("x") == F.col("y")).alias("same"), (F.col("x") == F.col("z")).alias("other"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS accepted FROM events")
def canonical_validate(spark: SparkSession, d: str) -> DataFrame:
    """Interchange rules: integers beyond 2**53 - 1 and too deep values are refused."""
    samples = ("9007199254740991", '["a"]', "9007199254740993", "[" * 40 + "]" * 40)
    text = F.get(F.array(*map(F.lit, samples)), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", canonical.canonical_json(text, most_depth=20, interchange=True)["error"].isNull().alias("accepted"))
