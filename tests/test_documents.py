"""Mixed histories, differences of documents and patch texts, against a plain fold."""

import copy
import json
import random

import pytest

from opledger.functions.canonical import canonical_text
from opledger.operators import documents, framed
from opledger.operators.model import LOG

EMPTY = dict.fromkeys(("start", "removed", "text", "idx", "fields", "values", "value"))


def random_value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return r.randrange(-50, 50)
    if kind in (2, 3):
        return "".join(r.choice("abü\"\\ 😀") for _ in range(r.randrange(6)))
    if kind == 4:
        return [random_value(r, depth + 1) for _ in range(r.randrange(4))]
    if kind == 5:
        return [{"id": i, "v": random_value(r, 3)} for i in range(r.randrange(4))]
    return {r.choice("abcdé"): random_value(r, depth + 1) for _ in range(r.randrange(4))}


def paths(value, at=()):
    yield list(at), value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from paths(v, (*at, str(k)))


def random_operation(r, document):
    path, value = r.choice(list(paths(document)))
    op = {"path": path}
    some = [json.dumps(random_value(r, 2)) for _ in range(r.randrange(3))]
    if isinstance(value, str) and r.random() < 0.8:
        if r.random() < 0.5:
            return {**op, "op": "STRING_SPLICE", "start": r.randrange(8), "removed": r.randrange(4), "text": r.choice(["", "x", "yz"])}
        return {**op, "op": "STRING_COPY", "start": r.randrange(8), "removed": r.randrange(8), "idx": [r.randrange(4)]}
    if isinstance(value, dict) and r.random() < 0.6:
        keys = r.sample("abcde", len(some))
        return {**op, "op": "ASSIGN", "fields": keys, "values": some}
    if isinstance(value, list) and r.random() < 0.8:
        n, kind = len(value), r.randrange(8)
        idx = [r.randrange(n + 2) for _ in some]
        if kind == 0:
            return {**op, "op": "TRUNCATE", "start": r.randrange(4)}
        if kind == 1:
            return {**op, "op": "APPEND", "values": some}
        if kind == 2:
            return {**op, "op": "ARRAY_SPLICE", "start": r.randrange(5), "removed": r.randrange(3), "values": some}
        if kind == 3:
            return {**op, "op": "ARRAY_MOVE", "start": r.randrange(5), "removed": r.randrange(5)}
        if kind == 4:
            return {**op, "op": "SCALAR_ARRAY_REPLACE", "values": ["1", '"x"']}
        if kind == 5:
            return {**op, "op": "ARRAY_TWO_FIELD_INSERT", "start": r.randrange(4), "fields": ["id", "v"], "values": ["1", "2", '"p"', "null"]}
        if value and all(isinstance(x, dict) for x in value):
            if kind == 6:
                return {**op, "op": "ARRAY_OBJECT_ASSIGN", "idx": idx, "values": ['{"v":%d}' % i for i in range(len(idx))]}
            return {**op, "op": "ARRAY_OBJECT_FIELD_ASSIGN", "idx": idx, "fields": ["v", "w"], "values": [str(i) for i in range(2 * len(idx))]}
        return {**op, "op": "ARRAY_ASSIGN", "idx": idx, "values": some}
    if path and r.random() < 0.3:
        return {**op, "op": "REMOVE"}
    return {**op, "op": "SET", "value": json.dumps(random_value(r, 1))}


def test_replay_equals_a_plain_fold(spark):
    """400 histories: dropping what is overwritten changes no document."""
    r = random.Random(11)
    base, rows, wanted, early = [], [], {}, {}
    for h in range(400):
        document = {"a": random_value(r), "b": [1, 2, 3], "c": "text", "d": {}}
        base.append((str(h), json.dumps(document)))
        for seq in range(r.randrange(12)):
            if seq == 4:
                early[str(h)] = canonical_text(document)
            op = random_operation(r, document)
            rows.append({**EMPTY, "history_id": str(h), "patch_seq": seq, "op_seq": 0, **op})
            document = documents.applied(document, {**EMPTY, **copy.deepcopy(op)})
        wanted[str(h)] = canonical_text(document)
        early.setdefault(str(h), wanted[str(h)])
    log = spark.createDataFrame([[x[f.name] for f in LOG.fields] for x in rows], LOG).repartition(5)
    start = spark.createDataFrame(base, "history_id string, document string")
    assert {x.history_id: x.document for x in documents.replay(start, log).collect()} == wanted
    assert {x.history_id: x.document for x in documents.replay(start, log, 4).collect()} == early
    assert documents.live(log).count() < log.count()
    back = documents.read_patches(documents.patch_texts(log))
    assert sorted(map(str, back.select(*LOG.names).collect())) == sorted(map(str, log.collect()))


def test_differences_applied_give_the_target(spark):
    r = random.Random(5)
    pairs = []
    for i in range(400):
        a = {"a": random_value(r), "rows": [{"id": k, "v": random_value(r, 2)} for k in range(4)], "t": "some text here"}
        b = copy.deepcopy(a)
        for _ in range(r.randrange(4)):
            b = documents.applied(b, {**EMPTY, **random_operation(r, b)})
        pairs.append((str(i), json.dumps(a), json.dumps(b)))
    frame = spark.createDataFrame(pairs, "history_id string, before string, after string")
    for key in (None, "id"):
        patches = documents.diff(frame, key)
        got = {x.history_id: x.document for x in documents.replay(frame.selectExpr("history_id", "before AS document"), patches).collect()}
        assert got == {h: canonical_text(json.loads(b)) for h, _, b in pairs}
    one = documents.differences([{"id": 1, "v": 1}, {"id": 2, "v": 2}], [{"id": 1, "v": 1}, {"id": 2, "v": 3}], row_key="id")
    assert one == [{"op": "SET", "path": ["1", "v"], "value": "3"}]


def test_errors_name_the_operation(spark):
    base = spark.createDataFrame([("h", '{"a":1}')], "history_id string, document string")
    log = spark.createDataFrame([("h", 3, 0, "SET", ["a", "b"], None, None, None, None, None, None, "1")], LOG)
    with pytest.raises(Exception, match="history h, patch 3, operation 0"):
        documents.replay(base, log).collect()
    over = log.unionByName(spark.createDataFrame([("h", 4, 0, "SET", ["a"], None, None, None, None, None, None, "2")], LOG))
    assert documents.replay(base, over).first().document == '{"a":2}'
    assert documents.replay(base, log.limit(0)).first().document == '{"a":1}'
    alone = spark.createDataFrame([("new", 0, 0, "SET", [], None, None, None, None, None, None, "[1]")], LOG)
    assert {r.history_id: r.document for r in documents.replay(base, alone).collect()} == {"h": '{"a":1}', "new": "[1]"}


def test_filters_stay_above_frame_headers(spark, data):
    """A filter that is pushed into the steps of the header would evaluate the frame thousands of times a row."""
    from opledger.functions.transport import MAGIC
    from opledger.plans import document_queries, registry

    log = framed.read_frames(framed.patch_frames(document_queries._log(registry.table(spark, data, "events")), "fnv1a64:00"), "fnv1a64:00")
    plan = log.filter("history_id = '7'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"0x{MAGIC}") == 1


@pytest.mark.parametrize("name", ["patch_frames_replayed", "patch_texts_replayed", "diff_documents_roundtrip"])
def test_replay_reads_a_costly_log_once(spark, data, name):
    """Replay joins its log with itself: what decodes or compares must not stand in its plan as often."""
    from opledger.plans import catalogue

    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "from_json" not in plan
