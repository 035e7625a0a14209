"""Array and text operations of a patch as column expressions.

Where behaviour is ours to define: starts and lengths are clamped to the value,
indexes outside an array change nothing, and positions count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def truncate(a: Column, length) -> Column:
    """The first `length` elements."""
    return F.slice(a, 1, F.greatest(_int(length), F.lit(0)))


def append(a: Column, values: Column) -> Column:
    return F.concat(a, values)


def splice(a: Column, start, removed, values: Column) -> Column:
    """Replaces `removed` elements from `start` on by values."""
    at = F.least(F.greatest(_int(start), F.lit(0)), F.size(a))
    n = F.greatest(_int(removed), F.lit(0))
    return F.concat(F.slice(a, 1, at), values, F.slice(a, at + n + 1, F.greatest(F.size(a) - at - n, F.lit(0))))


def move(a: Column, source, target) -> Column:
    """Takes the element at `source` out and puts it so that it stands at `target`."""
    rest = F.filter(a, lambda x, i: i != _int(source))
    moved = F.array_insert(rest, F.least(_int(target), F.size(rest)) + 1, F.get(a, _int(source)))
    return F.when((_int(source) >= 0) & (_int(source) < F.size(a)) & (_int(target) >= 0), moved).otherwise(a)


def _last(pairs: Column) -> Column:
    """A map of array of struct(key, value) in which the last of repeated keys counts."""
    back = F.reverse(pairs)
    first = F.filter(back, lambda p, i: F.array_position(F.transform(back, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def assign(a: Column, indexes: Column, values: Column) -> Column:
    """values[i] at indexes[i]; of repeated indexes the last one counts.  One lookup for each element."""
    pairs = F.transform(indexes, lambda v, p: F.struct(v.cast("bigint").alias("key"), F.get(values, p).alias("value")))
    last = _last(pairs)
    return F.transform(a, lambda x, i: F.when(F.map_contains_key(last, i.cast("bigint")), F.try_element_at(last, i.cast("bigint"))).otherwise(x))


def tuple_assign(a: Column, indexes: Column, fields: Column, values: Column) -> Column:
    """values[i] at a[indexes[i]][fields[i]] of an array of arrays; the last of repeated places counts."""
    def row(x, i):
        def cell(y, j):
            last = F.array_max(F.transform(indexes, lambda v, p: F.when((v == i) & (F.get(fields, p) == j), p)))
            return F.when(last.isNull(), y).otherwise(F.get(values, last))

        return F.transform(x, cell)

    return F.transform(a, row)


def two_field_insert(a: Column, start, first: Column, second: Column, names: tuple[str, str]) -> Column:
    """Objects made of two columns, inserted at `start` of an array of such objects."""
    made = F.transform(F.arrays_zip(first.alias("x"), second.alias("y")), lambda z: F.struct(z["x"].alias(names[0]), z["y"].alias(names[1])))
    return splice(a, start, 0, made)


def text_splice(text: Column, start, removed, inserted) -> Column:
    """text[:start] + inserted + text[start + removed:]; numbers below 0 count as 0."""
    at = F.least(F.greatest(_int(start), F.lit(0)), F.length(text))
    return F.overlay(text, _int(inserted), at + 1, F.greatest(_int(removed), F.lit(0)))


def text_copy(text: Column, target, source, length) -> Column:
    """Inserts text[source:source + length] at `target`; numbers below 0 count as 0."""
    return text_splice(text, target, 0, F.substring(text, F.greatest(_int(source), F.lit(0)) + 1, F.greatest(_int(length), F.lit(0))))


def text_replay(text: Column, operations: Column) -> Column:
    """Splices in order: array of struct(start, removed, inserted)."""
    return F.aggregate(operations, text, lambda t, o: text_splice(t, o["start"], o["removed"], o["inserted"]))


def field_cells(idx: Column, fields: Column, values: Column) -> Column:
    """array of struct(idx, field, value) of row-major values: values[r * fields + f] goes to field f of row idx[r]."""
    n = F.size(fields)
    return F.transform(values, lambda v, p: F.struct(F.get(idx, F.floor(p / n).cast("int")).alias("idx"), F.get(fields, p % n).alias("field"), v.alias("value")))


def scalars(values: Column, scalar) -> Column:
    """SCALAR_ARRAY_REPLACE: the new array, of scalars (by a test of one); null where a value is none."""
    return F.when(F.forall(values, scalar), values)
