"""Value, dictionary, index-set and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import encodings as enc
from ..operators import columns, replay
from .registry import query, table


@query("SELECT event_type, first_seen, (dense_rank() OVER (ORDER BY first_seen) - 1)::BIGINT AS path_id FROM (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1)")
def path_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary ids in the order of first sight; only the distinct keys are ranked."""
    return columns.dictionary(table(spark, d, "events"), "event_type", "event_id", "path_id")


@query("""WITH p AS (SELECT user_id, event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS path_id FROM events GROUP BY 1, 2) SELECT e.event_id, p.path_id FROM events e JOIN p USING (user_id, event_type)""")
def path_interning(spark: SparkSession, d: str) -> DataFrame:
    """Every operation with the id of its two-segment path; ids are numbered range by range."""
    events = table(spark, d, "events")
    seen = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))
    ids = replay.numbered(seen, "first_seen", name="path_id")
    return events.join(ids, ["user_id", "event_type"]).select("event_id", F.col("path_id").cast("bigint"))


@query("SELECT event_id, event_type FROM events")
def dictionary_decode(spark: SparkSession, d: str) -> DataFrame:
    """Ids back to texts by a join with the dictionary."""
    events = table(spark, d, "events")
    words = columns.dictionary(events, "event_type", "event_id", "path_id").select("path_id", "event_type")
    coded = events.join(words, "event_type").select("event_id", "path_id")
    return coded.join(words, "path_id").select("event_id", "event_type")


@query("""SELECT l_orderkey, min(l_linestatus) = max(l_linestatus) AS status_constant, min(l_quantity) = max(l_quantity) AS quantity_constant, count(*) AS n FROM lineitem GROUP BY 1""")
def column_const(spark: SparkSession, d: str) -> DataFrame:
    same = lambda c: F.min(c) == F.max(c)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(same("l_linestatus").alias("status_constant"), same("l_quantity").alias("quantity_constant"), F.count("*").alias("n"))


@query("""SELECT unnest([{'field': 'n_nationkey', 'mode': CASE WHEN min(n_nationkey) = max(n_nationkey) THEN 'CONST' ELSE 'INT' END},
 {'field': 'n_name', 'mode': CASE WHEN min(n_name) = max(n_name) THEN 'CONST' ELSE 'STRING' END}, {'field': 'n_regionkey', 'mode': CASE WHEN min(n_regionkey) = max(n_regionkey) THEN 'CONST' ELSE 'INT' END}], recursive := true) FROM nation""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Storage mode of every field of a record table, from one aggregation."""
    return columns.field_modes(table(spark, d, "nation"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS last_id, max(event_id) FILTER (event_id <= 500) AS at_500 FROM events GROUP BY ALL")
def value_at(spark: SparkSession, d: str) -> DataFrame:
    """Random access: the value that a column held at a place."""
    at = F.max_by("event_id", F.when(F.col("event_id") <= 500, F.col("event_id"))).alias("at_500")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"), at)


#: Index lists made of each user's events: scattered, consecutive, in steps, in runs with gaps, or the shortest ones.
_LISTS = """(SELECT user_id, CASE user_id % 5 WHEN 0 THEN event_id WHEN 1 THEN first_id + place WHEN 2 THEN first_id + 3 * place WHEN 3 THEN first_id + place + 100 * (place // 5) ELSE event_id END AS idx
FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS place, min(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE user_id % 5 < 4 OR place < 2 + user_id % 3)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    w, u, place = W.partitionBy("user_id").orderBy("event_id"), F.col("user_id") % 5, F.col("place")
    rows = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("bigint").alias("place"), F.min("event_id").over(w).alias("first_id"))
    idx = F.when(u == 1, F.col("first_id") + place).when(u == 2, F.col("first_id") + 3 * place).when(u == 3, F.col("first_id") + place + 100 * F.floor(place / 5)).otherwise(F.col("event_id"))
    return rows.filter((u < 4) | (place < 2 + F.col("user_id") % 3)).select("user_id", idx.cast("bigint").alias("idx"))


def _vl(x: str) -> str:
    return f"greatest(1, ceil(length(ltrim(bin({x}), '0')) / 7.0))::BIGINT"


_DELTA = "SELECT user_id, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id", 1, 0).over(w)).alias("delta"))


@query(f"""SELECT user_id, first_value, step, bool_and(idx = first_value + step * pos) AS arithmetic, count(*) AS n FROM (
 SELECT user_id, idx, row_number() OVER w - 1 AS pos, first(idx) OVER w AS first_value, coalesce(nth_value(idx, 2) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) - first(idx) OVER w AS step
 FROM {_LISTS} WINDOW w AS (PARTITION BY user_id ORDER BY idx)) GROUP BY ALL""")
def column_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Whether each user's numbers are first + step * place."""
    w = W.partitionBy("user_id").orderBy("idx")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = _lists(spark, d).select(
        "user_id", "idx", (F.row_number().over(w) - 1).alias("pos"), F.min("idx").over(W.partitionBy("user_id")).alias("first_value"),
        F.coalesce(F.nth_value("idx", 2).over(whole), F.lit(0)).alias("second"),
    ).withColumn("step", F.col("second") - F.col("first_value"))
    return rows.groupBy("user_id", "first_value", "step").agg(F.every(F.col("idx") == F.col("first_value") + F.col("step") * F.col("pos")).alias("arithmetic"), F.count("*").alias("n"))


@query(_DELTA)
def value_delta(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d)


@query("SELECT user_id, event_id, event_id AS decoded FROM events")
def value_undelta(spark: SparkSession, d: str) -> DataFrame:
    """Deltas back to values by a running sum."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return _deltas(spark, d).select("user_id", "event_id", F.sum("delta").over(w).alias("decoded"))


@query("SELECT event_id, CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END AS zigzag, v AS back FROM (SELECT event_id, 500 - event_id AS v FROM events)")
def zigzag(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "events").select("event_id", enc.zigzag(F.lit(500) - F.col("event_id")).alias("zigzag"))
    return coded.withColumn("back", enc.unzigzag(F.col("zigzag")))


@query("SELECT o_orderkey, o_custkey, greatest(1, ceil(length(ltrim(bin(o_custkey), '0')) / 7.0))::BIGINT AS bytes FROM orders")
def varint_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", enc.varint_length(F.col("o_custkey")).alias("bytes"))


@query("""SELECT o_orderkey, array_to_string([lower(lpad(hex(((o_orderkey >> (7 * i)) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END), 2, '0')) for i in range(n)], '') AS bytes
FROM (SELECT o_orderkey, greatest(1, ceil(length(ltrim(bin(o_orderkey), '0')) / 7.0))::BIGINT AS n FROM orders)""")
def varint_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", enc.varint_hex(F.col("o_orderkey")).alias("bytes"))


@query("SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def varint_decode(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "orders").select("o_orderkey", enc.varint_bytes(F.col("o_orderkey")).alias("b"))
    return coded.select("o_orderkey", enc.read_varint(F.col("b"), F.lit(0))["value"].alias("decoded"))


_PARTS = "(SELECT l_orderkey, list(l_partkey % 3 ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS a FROM lineitem GROUP BY 1)"


def _small_lists(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    sorted_ = F.array_sort(F.collect_list(order))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(sorted_, lambda x: x["l_partkey"] % 3).alias("a"))


@query(f"""SELECT l_orderkey, len(a) AS n, list_filter(range(1, least(65, len(a))), lambda p: len(list_filter(range(p + 1, len(a) + 1), lambda i: a[i] <> a[i - p])) = 0)[1] AS period FROM {_PARTS}""")
def uint_periodic(spark: SparkSession, d: str) -> DataFrame:
    """The shortest period of each order's list of small numbers."""
    return _small_lists(spark, d).select("l_orderkey", F.size("a").cast("bigint").alias("n"), enc.shortest_period(F.col("a")).alias("period"))


@query(f"""SELECT l_orderkey, CASE WHEN len(a) >= 4 AND len(list_distinct(a)) = 1 THEN 'REPEAT' WHEN len(list_filter(a, lambda x: x <> x // 1)) = 0 THEN 'INT' ELSE 'DOUBLE' END AS mode FROM {_PARTS}""")
def int_array_mode(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when((F.size("a") >= 4) & (F.size(F.array_distinct("a")) == 1), "REPEAT").when(F.forall("a", lambda x: x == F.floor(x)), "INT").otherwise("DOUBLE")
    return _small_lists(spark, d).select("l_orderkey", mode.alias("mode"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_id % 2 = 0 OR user_id % 3 > 0) = 1 AND count(*) >= 4 AS record_shape FROM events GROUP BY 1""")
def record_columns(spark: SparkSession, d: str) -> DataFrame:
    """Whether all objects of a user's list have the same keys in the same order; in every third list some have another order."""
    k, v = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    one, two = F.concat(F.lit('{"k":'), k, F.lit(',"id":'), v, F.lit("}")), F.concat(F.lit('{"id":'), v, F.lit(',"k":'), k, F.lit("}"))
    rows = table(spark, d, "events").select("user_id", F.when((F.col("event_id") % 2 == 0) | (F.col("user_id") % 3 > 0), one).otherwise(two).alias("object"))
    keys = F.to_json(F.json_object_keys("object"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), ((F.count_distinct(keys) == 1) & (F.count("*") >= 4)).alias("record_shape"))


@query("SELECT doc_id // 8 AS byte_no, sum(CASE WHEN toxic = 1 THEN 1 << (doc_id % 8)::INT ELSE 0 END)::BIGINT AS bits FROM labels GROUP BY 1")
def bool_bitpack(spark: SparkSession, d: str) -> DataFrame:
    """Booleans as bits of bytes, lowest first."""
    return columns.pack_bits(table(spark, d, "labels"), "doc_id", F.col("toxic") == 1)


@query("SELECT doc_id, toxic = 1 AS flag FROM labels")
def bool_unpack(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    packed = columns.pack_bits(labels, "doc_id", F.col("toxic") == 1)
    return columns.unpack_bits(packed, labels.select("doc_id"), "doc_id", "flag")


@query(r"SELECT n_nationkey, regexp_extract(n_name, '^(.*[^0-9])(0|[1-9][0-9]*)$', 1) AS prefix, regexp_extract(n_name, '^(.*[^0-9])(0|[1-9][0-9]*)$', 2) AS suffix FROM nation")
def numeric_suffix_keys(spark: SparkSession, d: str) -> DataFrame:
    prefix, suffix = enc.numeric_suffix(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", prefix.alias("prefix"), suffix.alias("suffix"))


@query(r"SELECT count(*) FILTER (regexp_matches(c_name, '^(.*[^0-9])(0|[1-9][0-9]*)$')) AS factored, count(*) AS n FROM customer")
def numeric_suffix_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Zero-padded suffixes are not factored."""
    return table(spark, d, "customer").agg(F.count(F.when(enc.numeric_suffix(F.col("c_name"))[0] != "", 1)).alias("factored"), F.count("*").alias("n"))


@query(f"SELECT user_id, count(*) AS n, min(idx) AS first_id, max(idx) AS last_id, max(idx) - min(idx) + 1 = count(*) AND count(*) > 1 AS run FROM {_LISTS} GROUP BY 1")
def index_run(spark: SparkSession, d: str) -> DataFrame:
    n, lo, hi = F.count("*"), F.min("idx"), F.max("idx")
    return _lists(spark, d).groupBy("user_id").agg(n.alias("n"), lo.alias("first_id"), hi.alias("last_id"), ((hi - lo + 1 == n) & (n > 1)).alias("run"))


@query(f"SELECT user_id, count(*) > 2 AND count(DISTINCT step) = 1 AND min(step) > 1 AS arithmetic FROM (SELECT user_id, idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS step FROM {_LISTS}) GROUP BY 1")
def index_arith(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("idx") - F.lag("idx").over(W.partitionBy("user_id").orderBy("idx"))
    return _lists(spark, d).select("user_id", step.alias("step")).groupBy("user_id").agg(((F.count("*") > 2) & (F.min("step") == F.max("step")) & (F.min("step") > 1)).alias("arithmetic"))


@query("""SELECT user_id, sum(greatest(1, ceil(length(ltrim(bin(delta), '0')) / 7.0)))::BIGINT AS delta_bytes FROM (%s) GROUP BY 1""" % _DELTA)
def index_delta(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each list as varint deltas."""
    return _deltas(spark, d).groupBy("user_id").agg(F.sum(enc.varint_length(F.col("delta"))).alias("delta_bytes"))


_ISLANDS = "SELECT user_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island, event_id FROM events"


@query(f"SELECT user_id, min(event_id) AS first_id, count(*) AS length FROM ({_ISLANDS}) GROUP BY user_id, island")
def index_islands(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of consecutive ids."""
    return columns.runs(table(spark, d, "events"), "user_id", "event_id")


_CHUNKS = f"""i AS (SELECT user_id, idx, lag(idx) OVER w AS prev, idx - row_number() OVER w AS island FROM {_LISTS} WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
l AS (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS held, min(idx) OVER (PARTITION BY user_id, island) AS a FROM i),
m AS (SELECT *, sum(CASE WHEN held >= 4 AND idx = a THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS longs FROM l),
p AS (SELECT *, CASE WHEN held >= 4 THEN a ELSE -1 - longs END AS chunk FROM m), q AS (SELECT *, min(idx) OVER (PARTITION BY user_id, chunk) AS first_id FROM p),
c AS (SELECT user_id, first_id, count(*) AS length, held >= 4 AS run, (1 + {_vl("count(*)")} + {_vl("first_id")} + coalesce(sum({_vl("idx - prev")}) FILTER (held < 4 AND idx > first_id), 0))::BIGINT AS bytes FROM q GROUP BY user_id, chunk, first_id, held >= 4)"""


@query(f"WITH {_CHUNKS} SELECT user_id, first_id, length, run, bytes FROM c")
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lists cut to runs of four or more and what lies between them, with the bytes of each chunk."""
    return columns.chunks(_lists(spark, d), "user_id", "idx")


@query("""WITH s AS (SELECT user_id, count(*) AS n, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1),
l AS (SELECT *, CASE WHEN (b - a) // n < 1 THEN 0 ELSE length(ltrim(bin((b - a) // n), '0')) - 1 END AS low FROM s)
SELECT e.user_id, e.event_id, (e.event_id - a) % (1::BIGINT << low::INT) AS low_part, ((e.event_id - a) // (1::BIGINT << low::INT)) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) - 1 AS high_bit FROM events e JOIN l USING (user_id)""")
def index_elias_fano(spark: SparkSession, d: str) -> DataFrame:
    """Low part and place of the high bit of every id of each list."""
    return columns.elias_fano(table(spark, d, "events"), "user_id", "event_id")


@query(f"""WITH {_CHUNKS}, k AS (SELECT user_id, count(*) AS pieces, sum(bytes) AS pb FROM c GROUP BY 1),
x AS (SELECT user_id, count(*) AS n, min(idx) AS a, max(idx) AS b, min(idx - prev) AS lo, max(idx - prev) AS hi, sum({_vl("coalesce(idx - prev, idx)")}) AS s FROM i GROUP BY 1),
w AS (SELECT *, CASE WHEN (b - a) // n < 1 THEN 0 ELSE length(ltrim(bin((b - a) // n), '0')) - 1 END AS low FROM x), h AS (SELECT *, ceil((n + (b - a) // (1::BIGINT << low::INT) + 1) / 8.0)::BIGINT AS hb FROM w),
y AS (SELECT user_id, n, a, b, lo, hi, (1 + {_vl("n")} + s)::BIGINT AS delta_bytes, CASE WHEN n >= 8 AND pieces > 1 THEN (1 + {_vl("n")} + {_vl("pieces")} + pb)::BIGINT END AS chunked_bytes,
 CASE WHEN n >= 32 AND low <= 24 THEN (1 + {_vl("n")} + {_vl("a")} + 1 + ceil(n * low / 8.0) + hb + {_vl("hb")})::BIGINT END AS elias_fano_bytes FROM h JOIN k USING (user_id))
SELECT user_id, n, delta_bytes, chunked_bytes, elias_fano_bytes, CASE WHEN n > 1 AND b - a + 1 = n THEN 'RUN' WHEN n > 2 AND lo = hi AND lo > 1 THEN 'ARITHMETIC' WHEN n <= 2 THEN 'RAW'
 WHEN chunked_bytes < delta_bytes THEN 'CHUNKED' WHEN chunked_bytes IS NULL AND elias_fano_bytes + 16 < delta_bytes THEN 'ELIAS_FANO' ELSE 'DELTA' END AS encoding FROM y""")
def index_cost_choice(spark: SparkSession, d: str) -> DataFrame:
    """The encoding of each list, of six, by its shape and by computed sizes."""
    return columns.index_choice(_lists(spark, d), "user_id", "idx")


_SHORT = "(SELECT l_orderkey, list(CASE l_orderkey % 4 WHEN 0 THEN l_linenumber WHEN 1 THEN l_linenumber * (1 + l_orderkey % 3) WHEN 2 THEN l_linenumber * l_linenumber ELSE l_suppkey END::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY 1)"


def _short_lists(spark: SparkSession, d: str) -> DataFrame:
    o, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    v = F.when(o == 0, n).when(o == 1, n * (1 + F.col("l_orderkey") % 3)).when(o == 2, n * n).otherwise(F.col("l_suppkey")).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["v"]).alias("a"))


_STEPS = "len(list_filter(range(1, len(a)), lambda i: {}))"


@query(f"""SELECT l_orderkey, len(a) AS n, CASE WHEN len(a) >= 4 AND {_STEPS.format("a[i + 1] - a[i] <> 1")} = 0 THEN 'RUN' WHEN len(a) >= 8 AND {_STEPS.format("a[i + 1] <= a[i]")} = 0 AND a[len(a)] < 64 THEN 'BITMAP'
 WHEN len(a) >= 4 AND {_STEPS.format("a[i + 1] < a[i]")} = 0 THEN 'DELTA' ELSE 'RAW' END AS form FROM {_SHORT}""")
def index_history_form(spark: SparkSession, d: str) -> DataFrame:
    """The form that each order's list of indexes gets inside a history."""
    return _short_lists(spark, d).select("l_orderkey", F.size("a").cast("bigint").alias("n"), columns.history_index_form(F.col("a")).alias("form"))


@query(f"""SELECT l_orderkey, CASE WHEN len(a) >= 8 AND len(list_filter(range(1, len(a)), lambda p: len(list_filter(range(p + 1, len(a) + 1), lambda i: a[i] <> a[i - p])) = 0)) > 0 THEN 'PERIODIC'
 WHEN len(a) >= 2 AND {_STEPS.format("a[i + 1] - a[i] <> a[2] - a[1]")} = 0 AND a[2] >= a[1] THEN 'ARITHMETIC' WHEN {_STEPS.format("a[i + 1] < a[i]")} = 0 THEN 'DELTA' ELSE 'RAW' END AS form FROM {_SHORT}""")
def uint_form(spark: SparkSession, d: str) -> DataFrame:
    """The form of each order's list of unsigned numbers."""
    return _short_lists(spark, d).select("l_orderkey", columns.uint_form(F.col("a")).alias("form"))


@query("SELECT l_orderkey, bit_or(1::BIGINT << l_linenumber) AS bits, bit_count(bit_or(1::BIGINT << l_linenumber))::BIGINT AS n FROM lineitem GROUP BY 1")
def index_bitmap(spark: SparkSession, d: str) -> DataFrame:
    bits = enc.bitmap_of(F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(bits.alias("bits")).withColumn("n", F.bit_count("bits").cast("bigint"))


@query("SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS member FROM lineitem")
def index_bitmap_unpack(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(enc.bitmap_of(F.col("l_linenumber")).alias("bits"))
    return grouped.select("l_orderkey", F.explode(F.transform(enc.bitmap_members(F.col("bits")), lambda x: x.cast("bigint"))).alias("member"))


@query("SELECT doc_id, length(text) AS units FROM documents")
def utf16_length(spark: SparkSession, d: str) -> DataFrame:
    """UTF-16 code units (the tables hold no character above the basic plane)."""
    return table(spark, d, "documents").select("doc_id", enc.utf16_length(F.col("text")).alias("units"))
