"""The template language."""

import pytest

from corpuscope.frontend.templates import Broken, Template, pieces, template_table

GOOD = [
    "", "plain { text }", "{{ a }}", "{{- a.b.c(1, x=2)|upper|default('x') -}}", "{{ a ? b : c }}{{ a ?: b }}{{ a ?? b ?? c }}", "{{ not a and b or c is defined }}", "{{ a is not divisible by(3) }}{{ a is same as(b) }}", "{{ [1, 2, ...x][0] }}{{ {a: 1, 'b': 2, (c): 3, d} }}", "{{ a[1:2] }}{{ a[:2] }}",
    "{{ x|map(v => v.y)|filter((v, k) => k > 1)|join(', ') }}", "{{ 1..5 }}{{ 2 ** 3 ** 2 }}{{ a ~ b }}{{ a starts with 'x' }}{{ a not in b }}", "{% if a %}x{% elseif b %}y{% else %}z{% endif %}", "{% for k, v in x|slice(1) %}{{ loop.index }}{% else %}-{% endfor %}", "{% set a, b = 1, 2 %}{% set c %}text{% endset %}",
    "{% block a %}x{% block b %}{% endblock b %}{% endblock %}{% block c 'short' %}", "{% extends 'base' %}", "{% include ['a', 'b'] ignore missing with {x: 1} only %}", "{% embed 'a' %}{% block t %}{% endblock %}{% endembed %}{% block t %}{% endblock %}", "{% macro m(a, b = 2) %}{{ a }}{% endmacro m %}{% import _self as f %}{% from 'x' import m as n, o %}{{ f.m(1) }}",
    "{% verbatim %}{{ not read {% }}{% endverbatim %}", "{# {{ not read }} #}", "{% apply upper|escape('html') %}x{% endapply %}", "{% with {a: 1} only %}{{ a }}{% endwith %}", "{% autoescape 'js' %}x{% endautoescape %}", "{% do f(1) %}{% flush %}{% deprecated 'x' package='a' version='1' %}", "{{ '}}' }}{% if '%}' %}{% endif %}", "{% cache 'k' ttl(300) %}x{% endcache %}", "{% guard function f %}a{% else %}b{% endguard %}",
]
BAD = ["{{ a", "{% if a %}", "{{ a b }}", "{{ }}", "{% unknown %}", "{% endif %}", "{{ (a }}", "{{ a. }}", "{% for a b %}{% endfor %}", "{% set a, b = 1 %}", "{% block a %}{% endblock %}{% block a %}{% endblock %}", "{# x", "{{ 'x }}", "{% block a %}{% endblock b %}", "{% if a %}{% else %}{% elseif b %}{% endif %}", "{{ [1, }}", "{% import 'x' %}"]


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    at = 0
    for _, a, b in pieces(text):
        assert a == at < b
        at = b
    assert at == len(text)
    for n in Template(text).root.walk():
        assert 0 <= n.start <= n.stop <= len(text)


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(Broken):
        Template(text)


def test_shape():
    e = Template("{{ a + b * c|f }}").root.children[0].children[0]
    assert (e.kind, e.value, [c.kind for c in e.children], e.children[1].value, e.children[1].children[1].kind) == ("binary", "+", ["name", "binary"], "*", "filter")


def test_table(spark):
    files = spark.createDataFrame([(1, b"{{ a }}"), (2, b"{{ a"), (3, None)], "file_id bigint, contents binary")
    assert sorted((r.file_id, r.kind) for r in template_table(files).collect()) == [(1, "name"), (1, "print"), (1, "template"), (2, "error"), (3, "template")]
