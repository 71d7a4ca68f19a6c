"""Literals of the source language, versions and bytes as values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the short escapes of a double-quoted text stand for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f", "\\": "\\", "$": "$", '"': '"'}
UNSIGNED = 18446744073709551615


def string_literal(text: str) -> str | None:
    """The value of a quoted text without interpolation; null if it is none."""
    t = text[1:] if text[:1] in "bB" and text[1:2] in "'\"" else text
    if len(t) < 2 or t[0] != t[-1] or t[0] not in "'\"":
        return None
    body = t[1:-1]
    if t[0] == "'":
        return re.sub(r"\\(['\\])", r"\1", body)

    def one(m: re.Match) -> str:
        s = m[1]
        if s in ESCAPES:
            return ESCAPES[s]
        if s[0] == "u":
            n = int(s[2:-1], 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
        if s[0] == "x":
            return chr(int(s[1:], 16))
        return chr(int(s, 8) & 0xFF)

    return re.sub(r"\\([ntrvef\\$\"]|u\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{1,2}|[0-7]{1,3})", one, body)


def decoded(c: Column) -> Column:
    """``string_literal`` of a column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: string_literal(x) if x is not None else None)

    return F.pandas_udf(run, "string")(c)


def integer_literal(c: Column) -> Column:
    """The value of an integer literal of any base, as DECIMAL(20,0); null beyond 64 unsigned bits and for what is none."""
    t = F.lower(F.replace(c, F.lit("_"), F.lit("")))
    base = F.when(t.rlike("^0x[0-9a-f]+$"), 16).when(t.rlike("^0b[01]+$"), 2).when(t.rlike("^0o?[0-7]+$"), 8).when(t.rlike("^(0|[1-9][0-9]*)$"), 10)
    digits = F.regexp_replace(F.regexp_replace(t, "^0[xbo]", ""), "^0+(?=.)", "")
    fits = F.length(digits) <= F.when(base == 16, 16).when(base == 2, 64).when(base == 8, 22).otherwise(20)
    value = F.when(base == 10, digits)
    for b in (16, 8, 2):
        value = F.when(base == b, F.conv(digits, b, 10)).otherwise(value)
    big = (base == 8) & (F.length(digits) == 22) & (F.substring(digits, 1, 1) > "1")
    out = F.when(base.isNotNull() & fits & ~big, value).try_cast("decimal(20,0)")
    return F.when(out <= F.lit(str(UNSIGNED)).cast("decimal(20,0)"), out)


def float_literal(c: Column) -> Column:
    t = F.replace(c, F.lit("_"), F.lit(""))
    return F.when(t.rlike("^([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def number_value(c: Column) -> Column:
    """An integer literal as a float where it does not fit 63 bits, as it is one then."""
    i = integer_literal(c)
    return F.when(i.isNotNull(), i.cast("double")).otherwise(float_literal(c))


def printable(c: Column) -> Column:
    """Bytes with everything but printable ASCII written as escapes."""

    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            short = {9: "\\t", 10: "\\n", 13: "\\r", 92: "\\\\"}
            return "".join(short.get(x) or (chr(x) if 32 <= x < 127 else f"\\x{x:02x}") for x in b)

        return s.map(one)

    return F.pandas_udf(run, "string")(c)


def version_number(c: Column) -> Column:
    """``major.minor.patch`` as one number that sorts: major * 65536 + minor * 256 + patch."""
    parts = F.split(c, "\\.")
    at = lambda i: F.coalesce(F.regexp_extract(F.get(parts, F.lit(i)), "^([0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.when(c.rlike("^[0-9]"), at(0) * 65536 + at(1) * 256 + at(2))


def version(text: str) -> int:
    major, minor, patch, *_ = [*(int(re.match(r"\d*", p)[0] or 0) for p in text.split(".")), 0, 0]
    return major * 65536 + minor * 256 + patch


def in_versions(c: Column, least: str | None = None, below: str | None = None) -> Column:
    out = F.lit(True)
    if least:
        out = out & (version_number(c) >= version(least))
    if below:
        out = out & (version_number(c) < version(below))
    return out
