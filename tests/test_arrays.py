"""Array and text operations against Python lists, edges included."""

import random

from pyspark.sql import functions as F

from opledger.operators import arrays


def test_lists_like_python(spark):
    r = random.Random(3)
    cases = [([r.randrange(50) for _ in range(r.randrange(0, 9))], r.randrange(0, 10), r.randrange(0, 6), [r.randrange(50) for _ in range(r.randrange(0, 4))]) for _ in range(150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<int>, s int, n int, v array<int>")
    got = df.select(
        "i", arrays.splice(F.col("a"), F.col("s"), F.col("n"), F.col("v")).alias("splice"), arrays.truncate(F.col("a"), F.col("s")).alias("cut"),
        arrays.append(F.col("a"), F.col("v")).alias("append"), arrays.move(F.col("a"), F.col("n"), F.col("s")).alias("move"),
    ).collect()
    for row in got:
        a, s, n, v = cases[row.i]
        spliced = list(a)
        spliced[s:s + n] = v
        assert row.splice == spliced
        assert row.cut == a[:s] and row.append == a + v
        moved = list(a)
        if n < len(a):
            x = moved.pop(n)
            moved.insert(s, x)
        assert row.move == moved


def test_assignments(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 9, 0], [7, 8, 9])], "a array<int>, i array<int>, v array<int>")
    assert df.select(arrays.assign(F.col("a"), F.col("i"), F.col("v")).alias("x")).first().x == [9, 2, 3]
    rows = spark.createDataFrame([([[1, 2], [3, 4]],)], "a array<array<int>>")
    got = rows.select(arrays.tuple_assign(F.col("a"), F.array(F.lit(1), F.lit(1)), F.array(F.lit(0), F.lit(0)), F.array(F.lit(8), F.lit(9))).alias("x"))
    assert got.first().x == [[1, 2], [9, 4]]


def test_text_splices(spark):
    texts = ["", "a", "abcdef", "a😀bc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", arrays.text_splice(F.col("t"), 2, 2, "XY").alias("s"), arrays.text_copy(F.col("t"), 1, 0, 2).alias("c"), arrays.text_replay(F.col("t"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("removed"), F.lit("z").alias("inserted")))).alias("r")).collect()
    for row in got:
        t = row.t
        if t is None:
            assert row.s is None and row.c is None and row.r is None
            continue
        assert row.s == t[:2] + "XY" + t[4:]
        assert row.c == t[:1] + t[0:2] + t[1:]
        assert row.r == "z" + t[1:]


def test_negative_numbers_are_clamped(spark):
    t = F.lit("abcdef")
    row = spark.range(1).select(
        arrays.text_splice(t, -2, 1, "X").alias("a"), arrays.text_splice(t, 2, -1, "X").alias("b"), arrays.text_splice(t, 99, 5, "X").alias("c"),
        arrays.text_copy(t, 1, -3, 2).alias("d"), arrays.text_copy(t, 1, 2, -2).alias("e"), arrays.text_copy(t, -1, 4, 9).alias("f"),
    ).first()
    assert tuple(row) == ("Xbcdef", "abXcdef", "abcdefX", "aabbcdef", "abcdef", "efabcdef")


def test_assign_with_repeated_and_outer_indexes(spark):
    a, idx = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 7, 1, -1))).cast("array<bigint>")
    row = spark.range(1).select(arrays.assign(a, idx, F.array(F.lit(5), F.lit(6), F.lit(None), F.lit(8))).alias("a"), arrays.assign(a, F.array().cast("array<bigint>"), F.array().cast("array<int>")).alias("b")).first()
    assert row.a == [1, None, 3] and row.b == [1, 2, 3]
    cells = spark.range(1).select(arrays.field_cells(F.array(F.lit(4), F.lit(9)), F.array(F.lit("x"), F.lit("y")), F.array(*map(F.lit, range(4)))).alias("c")).first().c
    assert [tuple(c) for c in cells] == [(4, "x", 0), (4, "y", 1), (9, "x", 2), (9, "y", 3)]
    both = spark.range(1).select(arrays.scalars(F.array(F.lit("1"), F.lit("[2]")), lambda v: ~v.rlike(r"^[\[{]")).alias("n"), arrays.scalars(F.array(F.lit("1")), lambda v: ~v.rlike(r"^[\[{]")).alias("s")).first()
    assert both.n is None and both.s == ["1"]
