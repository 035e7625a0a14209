"""base64url text and self-describing binary frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encodings import read_varint, varint_bytes

# Magic bytes with version, kinds of frames, greatest metadata.
MAGIC = "66726601"
KINDS = {1: "patch", 2: "history"}
MOST_METADATA = 64 << 10


def base64url(data: Column) -> Column:
    """Without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def valid_base64url(token: Column) -> Column:
    """Only the alphabet, a possible length, and no set bits after the last byte."""
    shape = token.rlike("^[A-Za-z0-9_-]*$") & (F.length(token) % 4 != 1)
    spare = F.when(F.length(token) % 4 == 2, token.rlike("[AQgw]$")).when(F.length(token) % 4 == 3, token.rlike("[AEIMQUYcgkosw048]$")).otherwise(True)
    return F.coalesce(shape & spare, F.lit(False))


def base64url_bytes(token: Column) -> Column:
    """The bytes of a token, null if it is not strict."""
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    return F.when(valid_base64url(token), F.try_to_binary(padded, F.lit("base64")))


def frame(kind: Column, schema_id: Column, metadata: Column, payload: Column) -> Column:
    """Magic, kind, flags, three lengths, then schema id, metadata and payload; null parts have length 0."""
    schema = F.coalesce(schema_id.cast("binary"), F.lit("").cast("binary"))
    meta = F.coalesce(metadata.cast("binary"), F.lit("").cast("binary"))
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    size = lambda c: varint_bytes(F.octet_length(c).cast("bigint"))
    return F.concat(F.unhex(F.lit(MAGIC)), F.unhex(F.lpad(F.hex(kind), 2, "0")), F.unhex(F.lit("00")), size(schema), size(meta), size(body), schema, meta, body)


def with_header(df: DataFrame, frame: str = "frame", name: str = "header") -> DataFrame:
    """Adds struct(kind, schema_id, metadata, payload_offset, payload_length, byte_length, metadata_length).

    Empty parts are null fields.  Each length is read once, in steps: the second
    stands where the first one ends.
    """
    data, c = F.col(frame), F.col
    read = df.withColumn("_a", read_varint(data, F.lit(6)))
    read = read.withColumn("_b", read_varint(data, 6 + c("_a.length")))
    read = read.withColumn("_c", read_varint(data, 6 + c("_a.length") + c("_b.length")))
    read = read.withColumn("_at", 6 + c("_a.length") + c("_b.length") + c("_c.length"))
    part = lambda at, n: F.when(n > 0, F.try_validate_utf8(F.substring(data, (at + 1).cast("int"), n.cast("int")).cast("string")))
    header = F.struct(
        F.conv(F.hex(F.substring(data, 5, 1)), 16, 10).cast("int").alias("kind"),
        part(c("_at"), c("_a.value")).alias("schema_id"),
        part(c("_at") + c("_a.value"), c("_b.value")).alias("metadata"),
        (c("_at") + c("_a.value") + c("_b.value")).alias("payload_offset"),
        c("_c.value").alias("payload_length"),
        F.octet_length(data).cast("bigint").alias("byte_length"),
        c("_b.value").alias("metadata_length"),
    )
    return read.withColumn(name, header).drop("_a", "_b", "_c", "_at")


def frame_error(data: Column, header: Column, most_metadata: int = MOST_METADATA) -> Column:
    """What is wrong with a frame, null if nothing is."""
    return (
        F.when(data.isNull() | (F.lower(F.hex(F.substring(data, 1, 4))) != MAGIC), "magic")
        .when(~F.coalesce(header["kind"].isin(*KINDS), F.lit(False)), "kind")
        .when(F.hex(F.substring(data, 6, 1)) != "00", "flags")
        .when(header["payload_length"].isNull(), "length")
        .when(header["metadata_length"] > most_metadata, "metadata")
        .when(header["payload_offset"] + header["payload_length"] > header["byte_length"], "short")
        .when(header["payload_offset"] + header["payload_length"] < header["byte_length"], "trailing")
    )


def frame_payload(data: Column, header: Column) -> Column:
    return F.substring(data, (header["payload_offset"] + 1).cast("int"), header["payload_length"].cast("int"))
