"""Replay of mixed histories onto documents, differences of documents, and patches as text.

A document is one JSON text; a log has the columns of model.LOG.  Replay first
drops, by joins on (history, path), every operation whose place a later SET,
REMOVE or SCALAR_ARRAY_REPLACE of the same path or of one above it overwrites, so
that of a long SET history only last writes are left.  What is left is folded in
order (text and array operations depend on all before them): operations stream
through a task that holds one document, never a history.

Semantics that are ours: numbers in paths address arrays; a missing key of an
object is made by its SET or ASSIGN alone; REMOVE of what is not there, indexes
outside an array and moves outside it change nothing; starts and lengths are
clamped; of one operation's repeated places the last counts.  A path through a
scalar or a missing container, or an operation on a value of the wrong kind,
raises an error that names it - unless a later operation overwrites the place.
STRING_COPY has its target in start, its source in removed and its length in
idx; ARRAY_MOVE its source in start and its target in removed; TRUNCATE its
length in start; ARRAY_TWO_FIELD_INSERT the values of its first field, then of its
second.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_text
from .model import LOG
from .replay import until as before

WHOLE = ("SET", "REMOVE", "SCALAR_ARRAY_REPLACE")
MOVING = ("ARRAY_SPLICE", "ARRAY_MOVE", "TRUNCATE", "APPEND", "ARRAY_TWO_FIELD_INSERT")


def _prefixes(path: str | Column, strict: bool) -> Column:
    """All beginnings of a path, the root first, as texts."""
    path = F.col(path) if isinstance(path, str) else path
    places = F.filter(F.sequence(F.lit(0), F.size(path)), lambda n: n < F.size(path) if strict else F.lit(True))
    return F.transform(places, lambda n: F.to_json(F.slice(path, F.lit(1), n)))


def live(log: DataFrame) -> DataFrame:
    """The operations that no later one overwrites.

    A write counts as overwriting only where its path goes through no array whose
    elements move, for there a path does not name one place.
    """
    numeric = F.coalesce(F.element_at("path", -1).rlike("^[0-9]+$"), F.lit(False))
    at = F.struct("patch_seq", "op_seq")
    shifts = log.filter(F.col("op").isin(*MOVING)).select("history_id", F.to_json("path").alias("above"))
    drops = log.filter((F.col("op") == "REMOVE") & numeric).select("history_id", F.to_json(F.slice("path", F.lit(1), F.size("path") - 1)).alias("above"))
    moving = shifts.unionByName(drops).distinct()
    writes = log.filter(F.col("op").isin(*WHOLE) & ~((F.col("op") == "REMOVE") & numeric)).groupBy("history_id", "path").agg(F.max(at).alias("last"))
    over = writes.withColumn("place", F.to_json("path")).withColumn("above", F.explode_outer(_prefixes("path", True)))
    unsafe = over.join(moving, ["history_id", "above"], "left_semi").select("history_id", "place").distinct()
    sure = over.select("history_id", "place", "last").distinct().join(unsafe, ["history_id", "place"], "left_anti")
    each = log.select("history_id", "patch_seq", "op_seq", F.explode(_prefixes("path", False)).alias("place"))
    dead = each.join(sure, ["history_id", "place"]).filter(at < F.col("last")).select("history_id", "patch_seq", "op_seq").distinct()
    return log.join(dead, ["history_id", "patch_seq", "op_seq"], "left_anti")


def _key(holder, segment: str):
    if isinstance(holder, list):
        return int(segment) if segment.isdigit() else -1
    return segment


def _held(holder, segment: str, where: str):
    """What a container holds at a segment."""
    if isinstance(holder, dict) and segment in holder:
        return holder[segment]
    if isinstance(holder, list) and 0 <= _key(holder, segment) < len(holder):
        return holder[_key(holder, segment)]
    raise ValueError(f"{where}: no container at {segment!r}")


def _clamped(n: int, most: int) -> int:
    return max(0, min(n, most))


def _on_text(op: dict, text, where: str):
    if not isinstance(text, str):
        raise ValueError(f"{where}: not a text")
    at = _clamped(op["start"], len(text))
    if op["op"] == "STRING_SPLICE":
        return text[:at] + op["text"] + text[at + max(0, op["removed"]):]
    source = _clamped(op["removed"], len(text))
    return text[:at] + text[source:source + max(0, op["idx"][0])] + text[at:]


def _on_array(op: dict, a, where: str) -> list:
    if not isinstance(a, list):
        raise ValueError(f"{where}: not an array")
    kind, values = op["op"], [json.loads(v) for v in op["values"] or ()]
    places = [(i, i) if 0 <= i < len(a) else (None, i) for i in op["idx"] or ()]
    if kind == "TRUNCATE":
        return a[:max(0, op["start"])]
    if kind == "APPEND":
        return a + values
    if kind == "ARRAY_SPLICE":
        at = _clamped(op["start"], len(a))
        return a[:at] + values + a[at + max(0, op["removed"]):]
    if kind == "ARRAY_MOVE":
        source, target = op["start"], op["removed"]
        if not 0 <= source < len(a) or target < 0:
            return a
        rest = a[:source] + a[source + 1:]
        return rest[:target] + [a[source]] + rest[target:]
    if kind == "ARRAY_TWO_FIELD_INSERT":
        at, n, (x, y) = _clamped(op["start"], len(a)), len(values) // 2, op["fields"]
        return a[:at] + [{x: u, y: v} for u, v in zip(values[:n], values[n:])] + a[at:]
    a = list(a)
    if kind == "ARRAY_ASSIGN":
        for (i, _), v in zip(places, values):
            if i is not None:
                a[i] = v
    elif kind == "ARRAY_OBJECT_ASSIGN":
        for (i, _), v in zip(places, values):
            if i is not None:
                a[i] = {**a[i], **v}
    elif kind == "ARRAY_TUPLE_ASSIGN":
        for (i, _), f, v in zip(places, op["fields"], values):
            if i is not None and int(f) < len(a[i]):
                a[i] = [*a[i][:int(f)], v, *a[i][int(f) + 1:]]
    else:  # ARRAY_OBJECT_FIELD_ASSIGN: values row by row
        n = len(op["fields"])
        for r, (i, _) in enumerate(places):
            if i is not None:
                a[i] = {**a[i], **dict(zip(op["fields"], values[r * n:(r + 1) * n]))}
    return a


def applied(document, op: dict):
    """The document after one operation (a row of a log as a dict); containers are changed in place."""
    kind, path = op["op"], op["path"]
    where = f"{kind} at {json.dumps(path)}"
    holder, last = {"": document}, ""
    for segment in path:
        holder, last = _held(holder, last, where), segment
    if not isinstance(holder, (dict, list)):
        raise ValueError(f"{where}: a path through a scalar")
    key = _key(holder, last)
    there = key in holder if isinstance(holder, dict) else 0 <= key < len(holder)
    if kind == "REMOVE":
        if there:
            del holder[key]
        return holder.get("") if not path else document
    if kind in ("SET", "SCALAR_ARRAY_REPLACE"):
        new = json.loads(op["value"]) if kind == "SET" else [json.loads(v) for v in op["values"]]
        if isinstance(holder, list) and not there:
            if key != len(holder):
                return document
            holder.append(new)
            return document
    else:
        old = _held(holder, last, where)
        if kind in ("STRING_SPLICE", "STRING_COPY"):
            new = _on_text(op, old, where)
        elif kind == "ASSIGN":
            if not isinstance(old, dict):
                raise ValueError(f"{where}: not an object")
            old.update(zip(op["fields"], map(json.loads, op["values"])))
            new = old
        else:
            new = _on_array(op, old, where)
    holder[key] = new
    return document if path else new


def replay(base: DataFrame, log: DataFrame, until: int | None = None) -> DataFrame:
    """history_id, document (canonical text) of every base document (history_id, document) after its operations with patch_seq below until.

    Histories without a base document start from null, which only a SET of the root changes.
    """
    names = [f.name for f in LOG.fields]
    ops = live(before(log, "patch_seq", until).select(*names))
    first = base.select("history_id", F.lit(None).cast("bigint").alias("patch_seq"), F.lit(None).cast("bigint").alias("op_seq"), F.lit("DOCUMENT").alias("op"), F.array().cast("array<string>").alias("path"), *[F.lit(None).cast(LOG[c].dataType).alias(c) for c in names[5:-1]], F.col("document").alias("value"))
    rows = first.unionByName(ops).repartition("history_id").sortWithinPartitions("history_id", F.asc_nulls_first("patch_seq"), F.asc_nulls_first("op_seq"))

    def run(batches):
        import pyarrow as pa

        history, document, begun = None, None, False
        for batch in batches:
            ids, documents = [], []
            for row in batch.to_pylist():
                if not begun or row["history_id"] != history:
                    if begun:
                        ids.append(history)
                        documents.append(canonical_text(document))
                    history, document, begun = row["history_id"], None, True
                if row["op"] == "DOCUMENT":
                    document = None if row["value"] is None else json.loads(row["value"])
                else:
                    try:
                        document = applied(document, row)
                    except (ValueError, TypeError, KeyError) as e:
                        raise ValueError(f"history {history}, patch {row['patch_seq']}, operation {row['op_seq']}: {e}") from e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(documents, pa.string())], names=["history_id", "document"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([history], pa.string()), pa.array([canonical_text(document)], pa.string())], names=["history_id", "document"])

    return rows.mapInArrow(run, "history_id string, document string")


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _middle(a, b) -> tuple[int, int]:
    """Lengths of what two sequences share at their starts and at their ends."""
    most = min(len(a), len(b))
    lead = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - lead) if a[-1 - i] != b[-1 - i]), most - lead)
    return lead, tail


def _same(a, b) -> bool:
    return canonical_text(a) == canonical_text(b)


def differences(a, b, path: tuple[str, ...] = (), row_key: str | None = None) -> list[dict]:
    """Operations that turn one JSON value into another.

    Objects are compared key by key; arrays of objects whose row_key values stand in
    one order row by row; other arrays and texts by what differs between a shared
    start and a shared end.
    """
    if _same(a, b):
        return []
    here = {"path": list(path)}
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "REMOVE", "path": [*path, k]} for k in a if k not in b]
        new = [k for k in b if k not in a]
        if new:
            out.append({"op": "ASSIGN", **here, "fields": new, "values": [_text(b[k]) for k in new]})
        for k in b:
            if k in a:
                out += differences(a[k], b[k], (*path, k), row_key)
        return out
    if isinstance(a, str) and isinstance(b, str) and a and b:
        lead, tail = _middle(a, b)
        if lead or tail:
            return [{"op": "STRING_SPLICE", **here, "start": lead, "removed": len(a) - lead - tail, "text": b[lead:len(b) - tail]}]
    if isinstance(a, list) and isinstance(b, list):
        keyed = [[x.get(row_key) if isinstance(x, dict) else None for x in v] for v in (a, b)]
        if row_key is not None and len(a) == len(b) and None not in keyed[0] and _same(*keyed):
            return [op for i, (x, y) in enumerate(zip(a, b)) for op in differences(x, y, (*path, str(i)), row_key)]
        texts = [[canonical_text(x) for x in v] for v in (a, b)]
        lead, tail = _middle(*texts)
        return [{"op": "ARRAY_SPLICE", **here, "start": lead, "removed": len(a) - lead - tail, "values": [_text(x) for x in b[lead:len(b) - tail]]}]
    return [{"op": "SET", **here, "value": _text(b)}]


def diff(pairs: DataFrame, row_key: str | None = None) -> DataFrame:
    """A log (patch_seq 0) for every row (history_id, before, after) whose documents differ."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(LOG)
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                found = differences(json.loads(row["before"]), json.loads(row["after"]), row_key=row_key)
                made += [{"history_id": row["history_id"], "patch_seq": 0, "op_seq": i, **op} for i, op in enumerate(found)]
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return pairs.select("history_id", "before", "after").mapInArrow(run, LOG)


OPERATION = "struct<op:string,path:array<string>,start:bigint,removed:bigint,text:string,idx:array<bigint>,fields:array<string>,values:array<string>,value:string>"


def patch_texts(log: DataFrame) -> DataFrame:
    """history_id, patch_seq, patch: every patch as the JSON text of its operations in order; columns that a kind leaves null are left out."""
    names = [f.name for f in LOG.fields][3:]
    ops = F.array_sort(F.collect_list(F.struct("op_seq", F.struct(*names).alias("o"))))
    return log.groupBy("history_id", "patch_seq").agg(F.to_json(F.transform(ops, lambda x: x["o"])).alias("patch"))


def read_patches(patches: DataFrame) -> DataFrame:
    """The log of patch texts; a text that is no array of operations raises an error."""
    ops = F.from_json("patch", f"array<{OPERATION}>", {"mode": "FAILFAST"})
    rows = patches.select("history_id", "patch_seq", F.posexplode(ops).alias("op_seq", "o"))
    return rows.select("history_id", "patch_seq", F.col("op_seq").cast("bigint"), "o.*")
