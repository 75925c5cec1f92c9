"""Typed values: null, boolean, 64-bit integer, bytes or text under one total order.

A value is STRUCT<tag, b, i, x, s>; comparing the structs compares the tag first
(null < boolean < integer < bytes < text), then the value, and two nulls are equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, BOOL, I64, BYTES, TEXT = range(5)
TYPE = "struct<tag:tinyint,b:boolean,i:bigint,x:binary,s:string>"
UNITS = {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def duration_ns(text: str) -> int:
    """``10ms``, ``5s``, ``2m``, ``1h`` or ``7d`` in nanoseconds."""
    digits = text.rstrip("mshd")
    if not digits.isdigit() or text[len(digits) :] not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(digits) * UNITS[text[len(digits) :]]


def _value(tag: Column, b: Column | None = None, i: Column | None = None, x: Column | None = None, s: Column | None = None) -> Column:
    def part(c: Column | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if c is None else c.cast(kind)

    return F.struct(
        tag.cast("tinyint").alias("tag"), part(b, "boolean").alias("b"), part(i, "bigint").alias("i"), part(x, "binary").alias("x"), part(s, "string").alias("s")
    )


def null() -> Column:
    return _value(F.lit(NULL))


def text(c: Column) -> Column:
    return _value(F.when(c.isNull(), NULL).otherwise(TEXT), s=c)


def i64(c: Column) -> Column:
    return _value(F.when(c.isNull(), NULL).otherwise(I64), i=c)


def boolean(c: Column) -> Column:
    return _value(F.when(c.isNull(), NULL).otherwise(BOOL), b=c)


def bytes_(c: Column) -> Column:
    return _value(F.when(c.isNull(), NULL).otherwise(BYTES), x=c)


def is_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()


def _step(name: str) -> str:
    """One step of a variant path; such a path has no escapes, so a name is put in the quotes that it does not hold."""
    if "'" in name and '"' in name:
        raise ValueError(f"a name with both kinds of quotes cannot be looked up: {name!r}")
    return f'["{name}"]' if "'" in name else f"['{name}']"


def json_value(payload: Column, path: str) -> Column:
    """The value at a dotted path: integers, text and booleans keep their type, all else is null.

    A number counts as an integer only if it is written as one and fits 64 bits.
    """
    at = "$" + "".join(map(_step, path.split(".")))
    found = F.try_variant_get(F.try_parse_json(payload), at, "variant")
    kind = F.schema_of_variant(found)
    tag = F.when(kind == "BOOLEAN", BOOL).when(kind == "BIGINT", I64).when(kind == "STRING", TEXT).otherwise(NULL)
    return _value(
        tag,
        b=F.when(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean")),
        i=F.when(kind == "BIGINT", F.try_variant_get(found, "$", "bigint")),
        s=F.when(kind == "STRING", F.try_variant_get(found, "$", "string")),
    )


def shown(value: Column) -> Column:
    """The value as text: integers in decimal, booleans as words, bytes in base64."""
    return F.coalesce(value["s"], value["i"].cast("string"), value["b"].cast("string"), F.base64(value["x"]))


def key_bytes(value: Column) -> Column:
    """The lookup key of a value; null never matches."""
    return F.coalesce(value["x"], value["s"].cast("binary"), value["i"].cast("string").cast("binary"), value["b"].cast("string").cast("binary"))


def stored_size(value: Column) -> Column:
    """Bytes of a value with its tag: integers take eight, booleans one."""
    size = F.when(value["tag"] == BOOL, 1).when(value["tag"] == I64, 8).otherwise(F.octet_length(key_bytes(value)))
    return size.cast("long") + 1


def key_token(key: Column) -> Column:
    """First 16 bytes of the key's SHA-256, in hex: the place of a key among ranges."""
    return F.substring(F.sha2(key, 256), 1, 32)


def work_window(key: Column) -> Column:
    """One of 256 work windows: the token's eighth byte."""
    return F.conv(F.substring(F.sha2(key, 256), 15, 2), 16, 10).cast("int")


def basis_points(part: Column, total: Column) -> Column:
    """Share of ``part`` in ``total`` in hundredths of a percent, at most 10,000."""
    return F.least(F.try_divide(part * 10000, total).cast("long"), F.lit(10000).cast("long"))


def retry_delay_ms(attempt: Column, base: int, cap: int, hint: Column) -> Column:
    """Doubling delay, at least the server's hint and at most ``cap``."""
    doubled = F.call_function("shiftleft", F.lit(base).cast("long"), F.least(attempt, F.lit(20)).cast("int"))
    return F.least(F.greatest(doubled, F.coalesce(hint, F.lit(0))), F.lit(cap)).cast("long")


def plain_decimal(value: Column) -> Column:
    """A double as text without an exponent, and without a fraction if it has none."""
    digits = F.regexp_replace(value.cast("string").cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(digits)


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two 64-bit integers, held at the ends of their range."""
    return F.coalesce(F.try_add(a, b), F.when(a > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))


def saturating_multiply(a: Column, b: Column) -> Column:
    """The product of two 64-bit integers, held at the ends of their range."""
    return F.coalesce(F.try_multiply(a, b), F.when((a > 0) == (b > 0), F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))


def derived_id(name: str, *parts: Column) -> Column:
    """A UUID that follows from a name and parts; each part's length is part of it, so parts cannot run together."""
    text = [F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    digest = F.sha2(F.concat(F.lit(f"{name}|"), *text), 256)
    return F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
