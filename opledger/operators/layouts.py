"""Which storage mode a history gets and which layout a patch: the first rule that fits, over facts computed from a log (model.LOG).

Rules and their order follow the modelled format.  Only the operations of one
patch are gathered; what holds for a history is a partial aggregate over its
patches, and a window over each for the cursor of its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import encodings as enc
from .model import NEEDS

LEAST_PATCHES = 8
FIELDS = ("op", "path", "start", "removed", "text", "idx", "fields", "values", "value")
INTEGER = r"^-?(0|[1-9][0-9]{0,17})$"


def patches(log: DataFrame) -> DataFrame:
    """history_id, patch_seq, ops: the operations of each patch in order."""
    ops = F.array_sort(F.collect_list(F.struct("op_seq", F.struct(*FIELDS).alias("o"))))
    return log.groupBy("history_id", "patch_seq").agg(F.transform(ops, lambda x: x["o"]).alias("ops"))


def _keys(objects: Column) -> Column:
    """The sorted keys that all objects (JSON texts) have, as text; null where they differ."""
    sets = F.array_distinct(F.transform(objects, lambda o: F.to_json(F.array_sort(F.json_object_keys(o)))))
    return F.when(F.size(sets) == 1, F.get(sets, F.lit(0)))


def _shape(o: Column) -> Column:
    """What must be equal in all patches for an operation to be a column: its kind, its path and its keys; null where it has no such shape."""
    keys = (
        F.when(o["op"] == "ASSIGN", F.to_json(F.array_sort(o["fields"]))).when(o["op"] == "ARRAY_OBJECT_ASSIGN", _keys(o["values"]))
        .when((o["op"] == "ARRAY_OBJECT_FIELD_ASSIGN") & (F.size(o["values"]) == F.size(o["idx"]) * F.size(o["fields"])), F.to_json(o["fields"]))
        .when(o["op"].isin("SET", "STRING_SPLICE"), "")
    )
    return F.concat(o["op"], F.lit(" "), F.to_json(o["path"]), F.lit(" "), keys)


def _two_integers(o: Column) -> Column:
    """Whether every object has two keys, both with whole numbers."""
    whole = lambda x: F.forall(F.map_values(F.from_json(x, "map<string,string>")), lambda v: F.coalesce(v.rlike(INTEGER), F.lit(False)))
    return F.forall(o["values"], lambda x: (F.size(F.json_object_keys(x)) == 2) & whole(x))


def history_modes(log: DataFrame) -> DataFrame:
    """history_id, patches, mode; patches may have several operations."""
    first, names = F.get("ops", F.lit(0)), F.transform("ops", lambda o: o["op"])
    shapes = F.transform("ops", _shape)
    rest = F.forall(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), lambda n: n == "SET")
    facts = patches(log).select(
        "history_id", "patch_seq", F.when(~F.exists(shapes, F.isnull), F.to_json(shapes)).alias("shape"), F.to_json(F.array_distinct(names)).alias("kinds"),
        first["op"].alias("op"), F.size("ops").alias("n"), rest.alias("rest"), F.coalesce(_two_integers(first), F.lit(False)).alias("integers"),
        first["start"].alias("start"), first["removed"].alias("removed"), F.length(first["text"]).alias("inserted"),
    )
    order = W.partitionBy("history_id").orderBy("patch_seq")
    walked = facts.withColumns({"cursor": F.coalesce(F.sum("inserted").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "first_start": F.first("start").over(order)})
    every = lambda c: F.coalesce(F.every(c), F.lit(False))
    seen = walked.groupBy("history_id").agg(
        F.count("*").alias("patches"), ((F.count("shape") == F.count("*")) & (F.min("shape") == F.max("shape"))).alias("one"), F.min("kinds").alias("kinds"), F.min("op").alias("op"),
        F.max("n").alias("n"), every(F.col("rest")).alias("rest"), every(F.col("integers")).alias("integers"), every((F.col("removed") == 0) & (F.col("start") == F.col("first_start") + F.col("cursor"))).alias("contiguous"),
    )
    is_ = lambda op: F.col("op") == op
    mode = (
        F.when((F.col("patches") < LEAST_PATCHES) | ~F.coalesce("one", F.lit(False)), "GENERIC").when(F.col("kinds") == '["SET"]', "SET_COLUMNS").when(F.col("kinds") == '["ASSIGN"]', "ASSIGN_COLUMNS")
        .when(is_("ARRAY_OBJECT_FIELD_ASSIGN") & F.col("rest"), "ROW_FIELD_ASSIGN").when(is_("ARRAY_OBJECT_ASSIGN") & F.col("rest") & F.col("integers"), "ROW_OBJECT_ASSIGN_INTEGERS")
        .when(is_("ARRAY_OBJECT_ASSIGN") & F.col("rest"), "ROW_OBJECT_ASSIGN").when(is_("STRING_SPLICE") & (F.col("n") == 1) & F.col("contiguous"), "STRING_APPEND")
        .when(is_("STRING_SPLICE") & (F.col("n") == 1), "STRING_SPLICE").otherwise("GENERIC")
    )
    return seen.select("history_id", "patches", mode.alias("mode"))


def _steps(numbers: Column) -> Column:
    more = F.greatest(F.size(numbers) - 1, F.lit(0))
    return F.zip_with(F.slice(numbers, F.lit(2), more), F.slice(numbers, F.lit(1), more), lambda x, y: x - y)


def _whole(texts: Column) -> Column:
    return F.forall(texts, lambda v: F.coalesce(v.rlike(INTEGER), F.lit(False)))


def _scalar(text: Column) -> Column:
    return ~text.rlike(r"^[\[{]")


def _arithmetic(idx: Column) -> Column:
    steps = F.array_distinct(_steps(idx))
    return (F.size(idx) >= 4) & (F.size(steps) == 1) & (F.get(steps, F.lit(0)) > 0)


def _compact_keys(fields: Column) -> Column:
    """Whether all keys are one prefix and a number."""
    pairs = F.array_distinct(F.transform(fields, lambda f: enc.numeric_suffix(f)[0]))
    return (F.size(pairs) == 1) & (F.get(pairs, F.lit(0)) != "")


def _compact_value(text: Column) -> Column:
    return assign_value_kind(text).isin("BOOL_OBJECT", "STRINGS", "INTS")


def patch_layout(ops: Column) -> Column:
    """The layout of one patch, given its operations (array of structs with the columns of a log)."""
    n, at = F.size(ops), lambda i: F.get(ops, F.lit(i))
    names = F.transform(ops, lambda o: o["op"])
    depth = lambda i: F.size(at(i)["path"])
    only = lambda op: (n == 1) & (at(0)["op"] == op)
    kinds = lambda *k: names == F.array(*map(F.lit, k))
    numbers = F.transform(at(0)["values"], lambda v: F.try_to_number(v, F.lit("S999999999999999999")).cast("bigint"))
    run = _whole(at(0)["values"]) & (F.size(at(0)["values"]) >= 4) & F.forall(_steps(numbers), lambda s: s == 1)
    assign = only("ASSIGN") & F.size(at(0)["fields"]).between(1, 32) & (depth(0) <= 8) & (_compact_keys(at(0)["fields"]) | F.exists(at(0)["values"], _compact_value))
    small = (
        kinds("ARRAY_SPLICE", "ASSIGN", "SET") & (depth(0) <= 8) & (depth(1) <= 8) & (depth(2) <= 8) & (at(0)["start"] >= 0) & (at(0)["removed"] >= 0) & (F.size(at(0)["values"]) <= 32)
        & F.forall(at(0)["values"], _scalar) & F.size(at(1)["fields"]).between(1, 16) & F.forall(at(1)["values"], _scalar) & _scalar(at(2)["value"])
    )
    odd, even = F.filter(at(0)["values"], lambda v, i: i % 2 == 1), F.filter(at(0)["values"], lambda v, i: i % 2 == 0)
    by_field = only("ARRAY_OBJECT_FIELD_ASSIGN") & (depth(0) == 0) & (at(0)["fields"] == F.array(F.lit("value"), F.lit("changed"))) & _arithmetic(at(0)["idx"]) & _whole(even) & F.forall(odd, lambda v: v == "true")
    changed = lambda o: (F.size(F.json_object_keys(o)) == 2) & (F.get_json_object(o, "$.changed") == "true") & F.get_json_object(o, "$.value").rlike(INTEGER)
    by_object = only("ARRAY_OBJECT_ASSIGN") & (depth(0) == 0) & _arithmetic(at(0)["idx"]) & F.forall(at(0)["values"], lambda o: F.coalesce(changed(o), F.lit(False)))
    fixed = F.exists(F.sequence(F.lit(0), F.greatest(depth(0) - 1, F.lit(0))), lambda k: F.forall(ops, lambda o: F.get(o["path"], k) == F.get(at(0)["path"], k)))
    sets = (n >= 16) & F.forall(ops, lambda o: (o["op"] == "SET") & (F.size(o["path"]) == depth(0))) & (depth(0) > 0) & fixed
    known = (
        F.when(~F.forall(names, lambda k: k.isin(*NEEDS)), "PLAIN")
        .when(kinds("STRING_SPLICE", "STRING_COPY") & (depth(0) == 0) & (depth(1) == 0), "ROOT_SPLICE_COPY").when(only("STRING_SPLICE") & (depth(0) == 0), "ROOT_SPLICE")
        .when(only("APPEND") & (depth(0) == 0) & run, "ROOT_APPEND_RUN").when(kinds("REMOVE", "ASSIGN") & (depth(1) == 0) & F.size(at(1)["fields"]).between(1, 16), "REMOVE_ASSIGN")
        .when(assign & (depth(0) == 0), "ROOT_ASSIGN").when(assign, "ASSIGN_OBJECT").when(small, "SMALL_STRUCTURAL").when(by_field, "ROWS_BY_FIELD").when(by_object, "ROWS_BY_OBJECT")
        .when(sets & _whole(F.transform(ops, lambda o: o["value"])), "SET_PATHS_INTEGERS").when(sets, "SET_PATHS")
    )
    return F.coalesce(known, F.lit("OP_STREAM"))


def patch_layouts(log: DataFrame) -> DataFrame:
    """history_id, patch_seq, layout of every patch of a log."""
    return patches(log).select("history_id", "patch_seq", patch_layout(F.col("ops")).alias("layout"))


def assign_value_kind(text: Column, most: int = 32) -> Column:
    """The compact form of an assigned value: NULL, BOOL, INT, STRING, BOOL_OBJECT, STRINGS, INTS or OTHER."""
    shape = F.schema_of_variant(F.parse_json(text))
    short = F.coalesce(F.json_array_length(text), F.lit(0)) <= most
    return (
        F.when(shape == "VOID", "NULL").when(shape == "BOOLEAN", "BOOL").when(shape == "BIGINT", "INT").when(shape == "STRING", "STRING")
        .when(shape.rlike("^OBJECT<[^,<]*: BOOLEAN>$"), "BOOL_OBJECT").when((shape == "ARRAY<STRING>") & short, "STRINGS").when((shape == "ARRAY<BIGINT>") & short, "INTS").otherwise("OTHER")
    )
