"""Canonical JSON, fingerprints, transport and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, transport
from .registry import query, table

SCHEMA = {"type": "document", "fields": ["doc_id", "text"]}
SCHEMA_ID = canonical.schema_id(SCHEMA)


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS canonical FROM events""")
def canonical_known(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of known fields, inside code generation."""
    text = canonical.canonical_struct(user_id=F.col("user_id"), event_type=F.col("event_type"), event_id=F.col("event_id"))
    return table(spark, d, "events").select("event_id", text.alias("canonical"))


@query("""SELECT event_id, '{"a":[1,null,true],"k":' || (props->>'k') || ',"z":{"b":1,"c":2}}' AS canonical, NULL::VARCHAR AS error FROM events""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of texts of any shape, in Arrow batches."""
    raw = F.concat(F.lit('{ "z" : {"c": 2, "b": 1.0}, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, null, true] }'))
    return table(spark, d, "events").select("event_id", canonical.canonical_json(raw).alias("c")).select("event_id", F.col("c.text").alias("canonical"), "c.error")


_FNV = "lower(lpad(format('{:x}', list_reduce([ord(c)::UHUGEINT for c in string_split(%s, '')], lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) %% 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)), 16, '0'))"


@query("SELECT DISTINCT event_type, " + _FNV % "event_type" + " AS fnv FROM events")
def fnv1a64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type").distinct().withColumn("fnv", canonical.fnv1a64(F.col("event_type")))


@query("SELECT DISTINCT event_type, 'fnv1a64:' || " + _FNV % """('{"fields":["value"],"type":"' || event_type || '"}')""" + " AS schema_id FROM events")
def schema_ids(spark: SparkSession, d: str) -> DataFrame:
    """Schema ids over canonical texts."""
    text = canonical.canonical_struct(type=F.col("event_type"), fields=F.array(F.lit("value")))
    return table(spark, d, "events").select("event_type").distinct().withColumn("schema_id", F.concat(F.lit("fnv1a64:"), canonical.fnv1a64(text)))


@query("SELECT doc_id, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS token FROM documents")
def base64url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", transport.base64url(F.col("text").cast("binary")).alias("token"))


@query("SELECT doc_id, text FROM documents")
def base64url_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    tokens = base64url(spark, d)
    return tokens.select("doc_id", F.decode(transport.base64url_bytes(F.col("token")), "UTF-8").alias("text"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 4 THEN true ELSE false END AS valid FROM documents""")
def base64url_decode_strict(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with padding, a bad character or spare bits are refused."""
    spoiled = F.element_at(F.array(F.lit("QUJD"), F.lit("QUI="), F.lit("Q$JD"), F.lit("QUJ"[:2] + "J"), F.lit("QUI")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", transport.valid_base64url(spoiled).alias("valid"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    meta = canonical.canonical_struct(source=F.col("source"), seq=F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", "text", transport.frame(F.lit(1), F.lit(SCHEMA_ID), meta, F.col("text")).alias("frame"))


_VARINT = "[lower(lpad(hex(((%s >> (7 * i)) & 127) + CASE WHEN i < %s - 1 THEN 128 ELSE 0 END), 2, '0')) for i in range(%s)]"
_LEN = "greatest(1, ceil(length(ltrim(bin(%s), '0')) / 7.0))::BIGINT"


def _varint(c: str) -> str:
    return "array_to_string(" + _VARINT % (c, _LEN % c, _LEN % c) + ", '')"


_META = """('{"seq":' || doc_id || ',"source":"' || source || '"}')"""
_META_SIZE, _TEXT_SIZE = f"strlen({_META})", "strlen(text)"


@query(f"""SELECT doc_id, '{transport.MAGIC}0100' || {_varint(str(len(SCHEMA_ID)) + '::BIGINT')} || {_varint(_META_SIZE)} || {_varint(_TEXT_SIZE)} || lower(hex(encode('{SCHEMA_ID}'))) || lower(hex(encode({_META}))) || lower(hex(encode(text))) AS frame FROM documents""")
def frame_build(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("doc_id", F.lower(F.hex("frame")).alias("frame"))


@query(f"""SELECT doc_id, 1 AS kind, '{SCHEMA_ID}' AS schema_id, {_META} AS metadata, strlen(text)::BIGINT AS payload_length, NULL::VARCHAR AS error FROM documents""")
def frame_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of binary frames; the payload is not decoded."""
    rows = transport.with_header(_frames(spark, d).select("doc_id", "frame"), name="h")
    return rows.select("doc_id", "h.kind", "h.schema_id", "h.metadata", "h.payload_length", transport.frame_error(F.col("frame"), F.col("h")).alias("error"))


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'magic' WHEN 2 THEN 'trailing' WHEN 3 THEN CASE WHEN strlen(text) > 0 THEN 'short' END END AS error FROM documents""")
def frame_errors(spark: SparkSession, d: str) -> DataFrame:
    """Spoiled frames: another magic, a byte too many, a byte too few."""
    f = F.col("frame")
    spoiled = F.when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("00")), f)).when(F.col("doc_id") % 4 == 2, F.concat(f, F.unhex(F.lit("00")))).when(F.col("doc_id") % 4 == 3, F.substring(f, F.lit(1), (F.octet_length(f) - 1).cast("int"))).otherwise(f)
    rows = _frames(spark, d).select("doc_id", spoiled.alias("frame"))
    rows = transport.with_header(rows, name="h")
    return rows.select("doc_id", transport.frame_error(F.col("frame"), F.col("h")).alias("error"))


@query(f"""SELECT doc_id, doc_id % 3 <> 0 AS accepted FROM documents""")
def frame_schema_guard(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose schema id is not the expected one, or is missing, are refused."""
    own = F.when(F.col("doc_id") % 3 != 0, F.lit(SCHEMA_ID)).otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("fnv1a64:0000000000000000")))
    frames = table(spark, d, "documents").select("doc_id", transport.frame(F.lit(1), own, F.lit(None).cast("string"), F.col("text")).alias("frame"))
    return transport.with_header(frames).select("doc_id", F.col("header.schema_id").eqNullSafe(F.lit(SCHEMA_ID)).alias("accepted"))


@query("SELECT doc_id, text AS payload FROM documents")
def frame_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = transport.with_header(_frames(spark, d).select("doc_id", "frame"), name="h")
    return rows.select("doc_id", F.decode(transport.frame_payload(F.col("frame"), F.col("h")), "UTF-8").alias("payload"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_path_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT event_id, '[["SET",["' || user_id || '","' || event_type || '"],' || (props->>'k') || ']]' AS patch FROM events""")
def serialize_patch(spark: SparkSession, d: str) -> DataFrame:
    """One patch of one SET as JSON text."""
    path = F.to_json(F.array(F.col("user_id").cast("string"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit('[["SET",'), path, F.lit(","), F.get_json_object("props", "$.k"), F.lit("]]")).alias("patch"))


@query("SELECT event_id, 'SET' AS op, user_id::VARCHAR AS user_id, event_type, (props->>'k')::BIGINT AS value FROM events")
def deserialize_patch(spark: SparkSession, d: str) -> DataFrame:
    """The texts of serialize_patch as operations again."""
    at = lambda p: F.variant_get(F.col("v"), p, "string")
    rows = serialize_patch(spark, d).select("event_id", F.parse_json("patch").alias("v"))
    return rows.select("event_id", at("$[0][0]").alias("op"), at("$[0][1][0]").alias("user_id"), at("$[0][1][1]").alias("event_type"), F.variant_get(F.col("v"), "$[0][2]", "bigint").alias("value"))
