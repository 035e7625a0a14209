"""Column expressions for integer, index-set and value encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3.  Exact for all but the least bigint."""
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 1, -F.shiftrightunsigned(u, 1) - 1).otherwise(F.shiftrightunsigned(u, 1))


def varint_length(v: Column) -> Column:
    """Bytes of a non-negative number in base 128."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7)).cast("bigint")


def varint_hex(v: Column) -> Column:
    """Base-128 bytes, least first, as lower-case hex."""
    step = lambda i: F.call_function("shiftright", v, (7 * i).cast("int")).bitwiseAND(127) + F.when(i < varint_length(v) - 1, 128).otherwise(0)
    two = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    return F.when(v.between(0, 127), two(v)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), varint_length(v) - 1), lambda i: two(step(i))), ""))


def varint_bytes(v: Column) -> Column:
    return F.unhex(varint_hex(v))


def read_varint(b: Column, at: Column) -> Column:
    """struct(value, length) of the varint that starts at a zero-based place of a binary column; both null if it does not end.

    One or two bytes, as nearly all have, are read by plain arithmetic; only longer ones go through the fold.
    """
    byte = lambda i: F.conv(F.hex(F.substring(b, (at + 1 + i).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = lambda v, n: F.struct(v.cast("bigint").alias("value"), F.lit(n).cast("bigint").alias("length"))
    text = F.hex(F.substring(b, (at + 1).cast("int"), F.lit(9)))
    digits = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))

    def step(s, x):
        end = s["n"].isNotNull() | x.isNull()
        return F.struct(
            F.when(end, s["v"]).otherwise(s["v"] + F.call_function("shiftleft", x.bitwiseAND(127).cast("bigint"), 7 * s["i"])).alias("v"),
            F.when(end, s["n"]).when(x < 128, s["i"] + 1).alias("n"),
            (s["i"] + 1).alias("i"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(None).cast("int").alias("n"), F.lit(0).alias("i"))
    done = lambda s: F.struct(F.when(s["n"].isNotNull(), s["v"]).alias("value"), s["n"].cast("bigint").alias("length"))
    return F.when(byte(0) < 128, found(byte(0), 1)).when(byte(1) < 128, found(byte(0) - 128 + 128 * byte(1), 2)).otherwise(F.aggregate(digits, start, step, done))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units; Spark's own lengths count code points."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")


def numeric_suffix(key: Column) -> tuple[Column, Column]:
    """(prefix, number text) of a key that ends in a number without leading zeros; empty strings for others."""
    pattern = r"^(.*[^0-9])(0|[1-9][0-9]*)$"
    return F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2)


def shortest_period(a: Column, most: int = 64) -> Column:
    """Smallest p of 1 to `most`, below the length, with every a[i] = a[i - p]; null without one."""
    held = F.filter(
        F.sequence(F.lit(1), F.least(F.lit(most), F.size(a) - 1)),
        lambda p: F.forall(F.sequence(p, F.size(a) - 1), lambda i: F.get(a, i) == F.get(a, i - p)),
    )
    return F.when(F.size(a) > 1, F.try_element_at(held, F.lit(1))).cast("bigint")


def elias_fano_low_bits(n: Column, span: Column) -> Column:
    """Low bits per entry: floor(log2(span / n)), at least 0."""
    ratio = F.floor(span / F.greatest(n, F.lit(1)))
    return F.when(ratio < 1, 0).otherwise(F.length(F.bin(ratio)) - 1).cast("bigint")


def elias_fano_bytes(n: Column, first: Column, last: Column) -> Column:
    """Bytes of an increasing list in Elias-Fano form: header numbers, packed low bits, unary high bits."""
    span = last - first
    low = elias_fano_low_bits(n, span)
    high_bits = n + F.floor(span / F.pow(F.lit(2.0), low)).cast("bigint") + 1
    return varint_length(n) + varint_length(first) + 1 + F.ceil(n * low / 8).cast("bigint") + F.ceil(high_bits / 8).cast("bigint") + varint_length(F.ceil(high_bits / 8).cast("bigint"))


def bitmap_of(indexes: Column) -> Column:
    """Aggregate: a 64-bit set of indexes 0 to 63."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), indexes.cast("int")))


def bitmap_members(bits: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
