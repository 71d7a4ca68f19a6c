"""Names: ASCII case folding, naming styles, namespaces and their patterns.

Folding is ASCII only, since symbol names are; Spark's own ``lower`` is not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def constant_key(c: Column) -> Column:
    """The look-up key of a constant: its namespace folded, its own name as it is."""
    own = F.element_at(F.split(c, r"\\"), -1)
    return F.concat(ascii_lower(F.regexp_replace(c, r"[^\\]*$", "")), own)


def last_segment(c: Column, separator: str = "\\") -> Column:
    return F.element_at(F.split(c, re.escape(separator)), -1)


def words(c: Column) -> Column:
    """The words of a name in lower case, cut at separators and at changes of case."""
    cut = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    cut = F.regexp_replace(cut, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(ascii_lower(F.regexp_replace(cut, "[^A-Za-z0-9]+", "_")), "_"), lambda w: w != "")


def _title(w: Column) -> Column:
    return F.concat(ascii_upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))


def to_snake(c: Column) -> Column:
    return F.array_join(words(c), "_")


def to_kebab(c: Column) -> Column:
    return F.array_join(words(c), "-")


def to_constant(c: Column) -> Column:
    return ascii_upper(to_snake(c))


def to_pascal(c: Column) -> Column:
    return F.array_join(F.transform(words(c), _title), "")


def to_camel(c: Column) -> Column:
    p = to_pascal(c)
    return F.concat(ascii_lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def is_snake(c: Column) -> Column:
    return c == to_snake(c)


def is_kebab(c: Column) -> Column:
    return c == to_kebab(c)


def is_constant(c: Column) -> Column:
    return c == to_constant(c)


def is_pascal(c: Column) -> Column:
    return c == to_pascal(c)


def is_camel(c: Column) -> Column:
    return c == to_camel(c)


def braces(pattern: str) -> list[str]:
    """All patterns that ``{a,b}`` alternatives stand for, inner ones first."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [y for x in m[1].split(",") for y in braces(pattern[: m.start()] + x + pattern[m.end() :])]


def namespace_regex(pattern: str, separator: str = "\\", prefix: bool = False) -> str:
    """A regular expression for a namespace pattern.

    ``*`` stands for one segment or a part of one, ``**`` for any number of
    segments, braces for alternatives; letters count in either case.  With
    ``prefix`` whatever lies below matches too.
    """
    sep = re.escape(separator)
    options = []
    for one in braces(pattern.strip(separator)):
        parts, out = one.split(separator), ""
        for i, part in enumerate(parts):
            if part == "**":
                out += f"(?:{sep}[^{sep}]+)*" if i else f"(?:[^{sep}]+{sep})*" if len(parts) > 1 else ".*"
            else:
                lead = sep if i and not (i == 1 and parts[0] == "**") else ""
                out += lead + "".join(f"[^{sep}]*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", part) if x)
        options.append(out)
    body = "|".join(options)
    return f"(?i)^(?:{body})" + (f"(?:{sep}.*)?$" if prefix else "$")


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``*`` and ``?`` within a segment, ``**`` across them, braces and classes."""
    options = []
    for one in braces(pattern):
        out, i = "", 0
        while i < len(one):
            if one.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif one.startswith("**", i):
                out, i = out + ".*", i + 2
            elif one[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif one[i] == "?":
                out, i = out + "[^/]", i + 1
            elif one[i] == "[" and "]" in one[i + 2 :]:
                end = one.index("]", i + 2)
                body = one[i + 1 : end].replace("\\", "\\\\")
                out, i = out + ("[^" + body[1:] if body[0] in "!^" else "[" + body) + "]", end + 1
            else:
                out, i = out + re.escape(one[i]), i + 1
        options.append(out)
    return f"^(?:{'|'.join(options)})$"
