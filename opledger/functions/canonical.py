"""Canonical JSON and stable fingerprints."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = (1 << 53) - 1
# FNV-1a, 64 bits.
FNV_START = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def canonical_struct(**columns: Column) -> Column:
    """Canonical JSON of an object with known fields: keys in order, nulls kept, no blanks.  Stays on the JVM side.

    For strings, booleans, integers and nested values of these; doubles need canonical_json.
    """
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns, key=lambda k: k.encode("utf-16-be"))]), {"ignoreNullFields": "false"})


def number_text(v: float) -> str:
    """A finite double as ECMAScript writes it."""
    if v == 0:
        return "0"
    if v < 0:
        return "-" + number_text(-v)
    mantissa, _, exponent = repr(v).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + ("" if part == "0" else part)
    point = len(whole) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return digits + "0" * (point - n)
    if 0 < point <= 21:
        return digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return "0." + "0" * -point + digits
    e = point - 1
    return digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical_text(value, most_depth: int = 512, interchange: bool = False, path: str = "$", depth: int = 0) -> str:
    """Canonical text of a JSON value: keys in UTF-16 order, no blanks.

    Raises ValueError, which names the path, for values that are too deep, not
    finite, or (interchange) integers beyond 2**53 - 1 and noncharacters.
    """
    if depth > most_depth:
        raise ValueError(f"{path}: nested too deep")
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int):
        if abs(value) <= SAFE:
            return str(value)
        if interchange:
            raise ValueError(f"{path}: integer beyond the safe range")
        return number_text(float(value))
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{path}: not a finite number")
        if interchange and value == int(value) and abs(value) > SAFE:
            raise ValueError(f"{path}: integer beyond the safe range")
        return number_text(value)
    if isinstance(value, str):
        if any(0xD800 <= ord(c) < 0xE000 for c in value):
            raise ValueError(f"{path}: unpaired surrogate")
        if interchange and any(0xFDD0 <= ord(c) <= 0xFDEF or ord(c) & 0xFFFE == 0xFFFE for c in value):
            raise ValueError(f"{path}: noncharacter")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical_text(v, most_depth, interchange, f"{path}[{i}]", depth + 1) for i, v in enumerate(value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(canonical_text(k, most_depth, interchange, path) + ":" + canonical_text(value[k], most_depth, interchange, f"{path}.{k}", depth + 1) for k in keys) + "}"


def _plain(text: Column, most_depth: int) -> Column:
    """Whether the engine's own parser and writer give the canonical text.

    So it is for printable ASCII without escapes, fractions, exponents, negative
    zeros or integers of more than 15 digits, and with fewer brackets than levels
    allowed.  (Objects come back with sorted keys.)
    """
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
    return text.rlike(r"^[ -\[\]-~]*$") & ~text.rlike(r"[0-9][.eE]|-0|[0-9]{16}") & (brackets <= most_depth)


def canonical_json(text: Column, most_depth: int = 512, interchange: bool = False) -> Column:
    """struct(text, error) for JSON texts of any shape; null stays null.

    Most texts stay in the engine; the others go to Python in Arrow batches.
    """

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = []
            for raw in series:
                try:
                    rows.append((None if raw is None else canonical_text(json.loads(raw), most_depth, interchange), None))
                except (ValueError, RecursionError) as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["text", "error"])

    own = F.when(F.coalesce(_plain(text, most_depth), F.lit(False)), F.to_json(F.try_parse_json(text)))
    return F.when(own.isNotNull(), F.struct(own.alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(run(F.when(own.isNull(), text)))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits.

    The state is kept in two 32-bit halves, so that no product leaves a bigint:
    the prime is 2**40 + 435, and a multiplication by 2**40 only moves the low half.
    """
    mask = 0xFFFFFFFF
    low_start, high_start = FNV_START & mask, FNV_START >> 32
    raw = F.hex(text.cast("binary"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(s, i):
        low = s["lo"].bitwiseXOR(F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))
        product = low * 435
        high = (s["hi"] * 435 + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(product.bitwiseAND(mask).alias("lo"), high.alias("hi"))

    start = F.struct(F.lit(low_start).cast("bigint").alias("lo"), F.lit(high_start).cast("bigint").alias("hi"))
    return F.aggregate(places, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def fnv1a64_text(data: bytes) -> str:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def schema_id(schema) -> str:
    """Stable id of a schema given as a JSON value."""
    return "fnv1a64:" + fnv1a64_text(canonical_text(schema).encode())
