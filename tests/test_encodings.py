"""Numbers, index sets and bits against plain Python."""

import random

from pyspark.sql import functions as F

from opledger.functions import encodings as enc


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def test_varints_and_zigzag(spark):
    r = random.Random(1)
    values = [0, 1, 127, 128, 16383, 16384, 2**53, 2**55] + [r.randrange(1 << r.randrange(1, 60)) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    coded = df.select("v", enc.varint_bytes(F.col("v")).alias("b"), enc.varint_length(F.col("v")).alias("n"))
    back = coded.select("v", "b", "n", enc.read_varint(F.concat(F.unhex(F.lit("ff")), F.col("b"), F.unhex(F.lit("07"))), F.lit(1)).alias("r"))
    for row in back.collect():
        assert bytes(row.b) == varint(row.v) and row.n == len(row.b)
        assert (row.r.value, row.r.length) == (row.v, row.n)
    signed = spark.createDataFrame([(v,) for x in values for v in (x, -x)] + [(-(2**52) - 1,)], "v bigint")
    assert signed.filter(enc.unzigzag(enc.zigzag(F.col("v"))) != F.col("v")).count() == 0


def test_unfinished_varint_is_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x80\x80"),), (bytearray(b""),)], "b binary")
    assert [r.x.value for r in df.select(enc.read_varint(F.col("b"), F.lit(0)).alias("x")).collect()] == [None, None]


def test_varints_of_one_to_three_bytes_at_any_place(spark):
    """What stands before and after does not matter, and a varint that the data cut off is null."""
    rows = [(lead, n, cut) for lead in (b"", b"\x81", b"\x7f\xff") for n in (0, 127, 128, 255, 256, 16383, 16384, 2097151) for cut in (0, 1)]
    df = spark.createDataFrame([(len(lead), n, cut, bytearray(lead + varint(n)[:len(varint(n)) - cut] + (b"" if cut else b"\x05"))) for lead, n, cut in rows], "at int, n bigint, cut int, b binary")
    for r in df.select("n", "cut", enc.read_varint(F.col("b"), F.col("at")).alias("x")).collect():
        assert (r.x.value, r.x.length) == ((None, None) if r.cut else (r.n, len(varint(r.n))))


def test_shortest_period(spark):
    lists = [[1, 2, 1, 2], [1, 1, 1], [1, 2, 3], [5], [], [1, 2, 1]]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a array<int>")
    got = {r.i: r.p for r in df.select("i", enc.shortest_period(F.col("a")).alias("p")).collect()}
    assert got == {0: 2, 1: 1, 2: None, 3: None, 4: None, 5: 2}


def test_bitmap_and_utf16(spark):
    df = spark.createDataFrame([(0,), (63,), (5,)], "x int").agg(enc.bitmap_of(F.col("x")).alias("b"))
    assert df.select(enc.bitmap_members(F.col("b")).alias("m")).first().m == [0, 5, 63]
    assert spark.createDataFrame([("a😀b",)], "t string").select(enc.utf16_length(F.col("t")).alias("n")).first().n == 4
