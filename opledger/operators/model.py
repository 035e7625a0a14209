"""The operation log: one row per operation, and what makes an operation well formed.

Columns of a log: history_id, patch_seq and op_seq (their order is the order of
the history), op (a symbolic name), path (array of segments as text), start,
removed, text, idx, fields, values and value (JSON texts).  Operations use the
columns that their kind needs; others stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("history_id", T.StringType()), T.StructField("patch_seq", T.LongType()), T.StructField("op_seq", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("start", T.LongType()),
    T.StructField("removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("idx", T.ArrayType(T.LongType())),
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.StringType())), T.StructField("value", T.StringType()),
])
#: Kinds of operation and the columns that each must fill.
NEEDS = {
    "SET": ("value",), "REMOVE": (), "TRUNCATE": ("start",), "APPEND": ("values",), "ASSIGN": ("fields", "values"),
    "STRING_SPLICE": ("start", "removed", "text"), "ARRAY_SPLICE": ("start", "removed", "values"), "ARRAY_MOVE": ("start", "removed"),
    "STRING_COPY": ("start", "removed", "idx"), "ARRAY_ASSIGN": ("idx", "values"), "ARRAY_OBJECT_ASSIGN": ("idx", "values"),
    "ARRAY_TUPLE_ASSIGN": ("idx", "fields", "values"), "ARRAY_OBJECT_FIELD_ASSIGN": ("idx", "fields", "values"),
    "SCALAR_ARRAY_REPLACE": ("values",), "ARRAY_TWO_FIELD_INSERT": ("start", "fields", "values"),
}
#: Pairs of columns that must have one length.
EVEN = {"ASSIGN": ("fields", "values"), "ARRAY_ASSIGN": ("idx", "values"), "ARRAY_OBJECT_ASSIGN": ("idx", "values"), "ARRAY_TUPLE_ASSIGN": ("idx", "values")}


def valid_operation(columns: set[str] | None = None) -> Column:
    """Whether a log row is well formed: a known kind, a path, what the kind needs, no negative numbers, lists that fit."""
    good = F.lit(False)
    for op, needs in NEEDS.items():
        if columns is not None and not set(needs) <= columns:
            continue
        fits = F.col("path").isNotNull()
        for c in needs:
            fits &= F.col(c).isNotNull()
            if c in ("start", "removed"):
                fits &= F.col(c) >= 0
            if c == "idx":
                fits &= F.forall("idx", lambda x: x >= 0)
        if op in EVEN:
            fits &= F.size(EVEN[op][0]) == F.size(EVEN[op][1])
        if op == "ARRAY_OBJECT_FIELD_ASSIGN":
            fits &= F.size("values") == F.size("idx") * F.size("fields")
        good = F.when(F.col("op") == op, F.coalesce(fits, F.lit(False))).otherwise(good)
    return good


def checked(log: DataFrame) -> DataFrame:
    """The log; reading the kind of a row that is not well formed raises an error that names it."""
    place = F.concat_ws("/", "history_id", "patch_seq", "op_seq")
    bad = F.raise_error(F.concat(F.lit("bad operation at "), place)).cast("string")
    return log.withColumn("op", F.when(valid_operation(set(log.columns)), F.col("op")).otherwise(bad))


def path_key(path: Column) -> Column:
    """One text per path."""
    return F.to_json(path)
