"""Documentation comments and the types in them."""

import pytest

from corpuscope.frontend.docblocks import Types, docblock, docblock_table

DOC = """/**
 * What it does.
 *
 * More of it.
 *
 * @param array<string, int|null> $a the first
 *   goes on
 * @param $b untyped
 * @return ?list<App\\Item>
 * @template T of object
 * @psalm-assert !null $x
 * @throws A|B when broken
 * @deprecated use {@see other()}
 */"""


def test_tags():
    d = docblock(DOC)
    assert d.text == "What it does.\n\nMore of it." and not d.errors
    assert [(t.name, t.type, t.variable, t.description) for t in d.tags] == [
        ("param", "array<string, int|null>", "$a", "the first\n  goes on"), ("param", None, "$b", "untyped"), ("return", "?list<App\\Item>", None, ""), ("template", "object", "T", ""),
        ("psalm-assert", "null", "$x", ""), ("throws", "A|B", None, "when broken"), ("deprecated", None, None, "use {@see other()}"),
    ]
    assert all(DOC[t.start :].startswith("@" + t.name) for t in d.tags)
    assert docblock("/** @var */").errors and docblock("/** {@see x */").errors and docblock("/** ```\n * @x\n */").errors
    assert docblock("/***/").tags == []


@pytest.mark.parametrize(
    "text",
    ["int", "?int", "int|string", "A&B", "array<int, string>", "list<array<string, int>>", "int[]", "(int|string)[]", "array{a: int, b?: string}", "array{int, string, ...}", "callable(int, string): bool", "Closure(A): void", "'a'|'b'", "-1|2", "class-string<T>", "A::X*", "(T is int ? string : bool)", "\\App\\Item", "$this", "int<0, max>", "object{a: int}"],
)
def test_types_read_and_write(text):
    p = Types(text)
    assert p.ok() and p.at == len(text) and str(p.result) == text


def test_types_end_where_they_end():
    for text, end in (("int $a", 3), ("int|null and more", 8), ("A &$b", 1), ("array<int> x", 10)):
        p = Types(text)
        assert p.ok() and p.at == end
    assert not Types("|").ok() and not Types("array<").ok() and not Types("").ok()


def test_table(spark):
    files = spark.createDataFrame([(1, ("<?php\n" + DOC + "\nfunction f() {}").encode()), (2, b"<?php // no"), (3, b"<?php /** text only */")], "file_id bigint, contents binary")
    rows = docblock_table(files).collect()
    assert sum(r.file_id == 1 for r in rows) == 7 and [r.description for r in rows if r.file_id == 3] == ["text only"]
