import json
import math

import random
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opledger.functions import canonical, transport

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet=st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_canonical_text_is_stable_and_means_the_same(value):
    text = canonical.canonical_text(value)
    assert canonical.canonical_text(json.loads(text, parse_int=float)) == text
    assert json.loads(text, parse_int=float) == value


def test_numbers_and_keys():
    assert [canonical.number_text(x) for x in (1.0, 1e7, 1e21, 1.5e-7, 0.00001, -0.0, 123.456, 1e20)] == ["1", "10000000", "1e+21", "1.5e-7", "0.00001", "0", "123.456", "100000000000000000000"]
    assert canonical.canonical_text({"～": 1, "😀": 2}) == '{"😀":2,"～":1}'
    for bad in (math.inf, math.nan, "\ud800"):
        with pytest.raises(ValueError, match=r"\$"):
            canonical.canonical_text([bad])
    with pytest.raises(ValueError):
        canonical.canonical_text({"a": 2**53}, interchange=True)
    deep = []
    for _ in range(20):
        deep = [deep]
    with pytest.raises(ValueError, match="deep"):
        canonical.canonical_text(deep, most_depth=10)


def test_arrow_form(spark):
    df = spark.createDataFrame([('{"b":1.0,"a":[true,null]}',), ("{",), (None,)], "t string")
    got = [tuple(r.c) for r in df.select(canonical.canonical_json(F.col("t")).alias("c")).collect()]
    assert got[0] == ('{"a":[true,null],"b":1}', None) and got[1][0] is None and got[1][1] and got[2] == (None, None)


def test_fnv(spark):
    texts = ["", "a", "foobar", "é😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", canonical.fnv1a64(F.col("t")))
    assert {r.t: r.h for r in df.collect()} == {t: canonical.fnv1a64_text(t.encode()) for t in texts}
    assert canonical.fnv1a64_text(b"foobar") == "85944171f73967e8"


def test_base64url_is_strict(spark):
    import base64

    raw = [bytes(range(n)) for n in range(6)] + [b"\xff\xfe\xfd"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").withColumn("t", transport.base64url(F.col("b")))
    for r in df.select("b", "t", transport.base64url_bytes(F.col("t")).alias("back")).collect():
        assert r.t == base64.urlsafe_b64encode(r.b).decode().rstrip("=") and bytes(r.back) == bytes(r.b)
    bad = spark.createDataFrame([("QUI=",), ("Q",), ("QR",), ("QU+/",), ("QUJ",), (None,)], "t string")
    assert bad.filter(transport.valid_base64url(F.col("t"))).count() == 0


def test_frames(spark):
    meta = "x" * 200
    df = spark.createDataFrame([(1, "s", meta, bytearray(b"abc")), (2, None, None, bytearray(b"")), (3, "s", None, bytearray(b"z" * 300))], "i int, s string, m string, p binary")
    frames = df.withColumn("frame", transport.frame(F.lit(2), F.col("s"), F.col("m"), F.col("p")))
    got = transport.with_header(frames)
    for r in got.select("*", transport.frame_error(F.col("frame"), F.col("header")).alias("e"), transport.frame_payload(F.col("frame"), F.col("header")).alias("back")).collect():
        assert r.e is None and (r.header.kind, r.header.schema_id, r.header.metadata) == (2, r.s, r.m) and bytes(r.back) == bytes(r.p)
    small = transport.with_header(frames.filter("i = 1")).select(transport.frame_error(F.col("frame"), F.col("header"), most_metadata=100).alias("e"))
    assert small.first().e == "metadata"
    broken = transport.with_header(spark.createDataFrame([(bytearray(b"abcd"),), (bytearray(b"frf\x01\x09\x00\x00\x00\x00"),), (None,)], "frame binary"))
    assert [r.e for r in broken.select(transport.frame_error(F.col("frame"), F.col("header")).alias("e")).collect()] == ["magic", "kind", "magic"]


def test_engine_and_python_give_one_text(spark):
    """Texts that stay in the engine, those that do not and those that are refused."""
    r = random.Random(8)

    def value(depth=0):
        kind = r.randrange(7 if depth < 3 else 5)
        if kind < 2:
            return r.choice([None, True, False, 0, -5, 12, 999999999999999, 2**53 - 1, 2**60, 1.5, -0.0, 1e30, 100.0])
        if kind < 5:
            return "".join(r.choice("abzAZ09 /~.:,-\u007fé😀\\\"\n") for _ in range(r.randrange(5)))
        if kind == 5:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return {"".join(r.choice("aZ_ é.") for _ in range(r.randrange(3))): value(depth + 1) for _ in range(r.randrange(4))}

    texts = [json.dumps(value(), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(600)] + ["{", "[1,]", '{"a":1,"a":2}', "-0", "[-0]", "01", "", " 7 ", None, "nul"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.c for x in frame.select("i", canonical.canonical_json(F.col("t")).alias("c")).collect()}
    kept = frame.filter(canonical._plain(F.col("t"), 512)).count()
    assert 100 < kept < 550
    for i, t in enumerate(texts):
        try:
            want = None if t is None else canonical.canonical_text(json.loads(t))
        except ValueError:
            want = None
            assert got[i].error
        assert got[i].text == want, t
