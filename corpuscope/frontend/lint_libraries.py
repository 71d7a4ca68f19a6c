"""Lint rules for code written against well-known libraries."""

from __future__ import annotations

import re

from .lint import ERROR, FUNCTIONS, HELP, NOTE, USER_INPUT, WARNING, arg, args, called, calls_of, literal, own, rule, string_value
from .syntax import Node

CALLS = ("method_call", "nullsafe_call", "static_call")

#: Functions for which a standard library has its own, by subject.
STANDARD = {
    "psl-array-functions": (WARNING, "array_map array_filter array_keys array_values array_merge array_combine array_flip array_reverse array_slice array_unique array_chunk array_fill array_fill_keys array_diff array_diff_key array_intersect array_intersect_key array_search array_key_exists array_key_first array_key_last in_array sort usort uasort asort arsort ksort krsort rsort uksort range count array_reduce array_sum array_product"),
    "psl-datetime": (WARNING, "time microtime hrtime date gmdate mktime strtotime date_create checkdate"),
    "psl-math-functions": (WARNING, "abs acos asin atan atan2 base_convert bindec ceil cos decbin dechex decoct exp floor fmod hexdec intdiv log log10 log2 max min octdec pi round sin sqrt tan array_sum"),
    "psl-output": (ERROR, "printf vprintf echo print"),
    "psl-randomness-functions": (WARNING, "rand mt_rand random_int random_bytes mt_srand srand lcg_value"),
    "psl-regex-functions": (WARNING, "preg_match preg_match_all preg_replace preg_replace_callback preg_split preg_quote preg_grep"),
    "psl-sleep-functions": (WARNING, "sleep usleep time_nanosleep time_sleep_until"),
    "psl-string-functions": (WARNING, "strlen strtolower strtoupper ucfirst ucwords lcfirst trim ltrim rtrim str_repeat str_replace str_pad str_split strpos stripos strrpos substr substr_count strrev strcmp strcasecmp sprintf vsprintf implode explode nl2br wordwrap mb_strlen mb_substr mb_strtolower mb_strtoupper mb_strpos str_contains str_starts_with str_ends_with chr ord"),
}
for _code, (_level, _names) in STANDARD.items():
    calls_of(_code, _level, set(_names.split()), "Use the standard library's form of {}.")


@rule("psl-data-structures", WARNING, "new")
def _(ctx, n):
    t = n.role("target")
    if t is not None and t.kind == "name" and t.value.lstrip("\\").lower() in {"splstack", "splqueue", "splobjectstorage", "splpriorityqueue", "splfixedarray", "splminheap", "splmaxheap", "arrayobject", "spldoublylinkedlist"}:
        yield n, f"Use the standard library's form of {t.value}."


#: Native functions and what a blog platform has for them.
WORDPRESS = dict(x.split(":") for x in "curl_init:wp_remote_get curl_exec:wp_remote_get file_get_contents:wp_remote_get json_encode:wp_json_encode parse_url:wp_parse_url rand:wp_rand mt_rand:wp_rand strip_tags:wp_strip_all_tags unlink:wp_delete_file mail:wp_mail md5:wp_hash date:wp_date".split())


@rule("use-wp-functions", WARNING, "call")
def _(ctx, n):
    if called(n) in WORDPRESS:
        yield n, f"Call {WORDPRESS[called(n)]}."


def on_variable(n: Node, name: str) -> bool:
    t = n.role("target")
    return t is not None and t.kind == "variable" and t.value == name


@rule("no-direct-db-query", WARNING, "method_call", "nullsafe_call")
def _(ctx, n):
    if on_variable(n, "$wpdb") and n.value in ("query", "get_results", "get_row", "get_var", "get_col"):
        yield n, "The database is not asked directly."


@rule("no-db-schema-change", ERROR, "method_call")
def _(ctx, n):
    t = string_value(arg(n, 0)) or (arg(n, 0).value[1:] if arg(n, 0) is not None and arg(n, 0).kind == "template" else "")
    if on_variable(n, "$wpdb") and re.match(r"\s*(create|alter|drop)\b", t, re.I):
        yield n, "The schema is not changed here."


@rule("prepared-sql", ERROR, "method_call", on=False)
def _(ctx, n):
    a = arg(n, 0)
    if on_variable(n, "$wpdb") and n.value in ("query", "get_results", "get_row", "get_var", "get_col") and a is not None and (a.kind == "template" or a.kind == "binary" and a.value == "." and any(c.kind == "variable" for c in a.walk())):
        yield a, "Prepare the statement."


@rule("no-roles-as-capabilities", WARNING, "call")
def _(ctx, n):
    if called(n) in ("current_user_can", "user_can", "author_can", "add_menu_page", "add_submenu_page"):
        for a in args(n):
            if string_value(a.role("value_")) in ("administrator", "editor", "author", "contributor", "subscriber", "super_admin"):
                yield a, "A role is not a capability."


#: Functions that make a text safe to print.
ESCAPES = frozenset("esc_html esc_attr esc_url esc_js esc_textarea esc_html__ esc_attr__ esc_html_e esc_attr_e wp_kses wp_kses_post wp_json_encode absint intval floatval count strlen htmlspecialchars htmlentities number_format rawurlencode urlencode json_encode".split())


@rule("no-unescaped-output", ERROR, "echo", "echo_tag", "print")
def _(ctx, n):
    for v in [c for c in n.children]:
        for c in [v, *own(v, "call", "method_call", "static_call", "cast", *FUNCTIONS)] if v.kind not in ("call", "cast") else [v]:
            if c.kind in ("variable", "template", "property_access") or c.kind in ("call", *CALLS) and called(c) not in ESCAPES:
                yield c, "Escape what is printed."
                break


@rule("nonce-verification", WARNING, "variable", on=False)
def _(ctx, n):
    scope = ctx.inside(n, *FUNCTIONS)
    if n.value in ("$_POST", "$_GET", "$_REQUEST", "$_FILES") and scope is not None and not any(called(c) in ("wp_verify_nonce", "check_admin_referer", "check_ajax_referer") for c in own(scope)):
        yield n, "Verify the nonce first."


@rule("validated-sanitized-input", ERROR, "variable", on=False)
def _(ctx, n):
    if n.value in USER_INPUT and not any(p.kind in ("isset", "empty", "cast") or called(p) in ("sanitize_text_field", "absint", "intval", "sanitize_key", "sanitize_email", "wp_verify_nonce", "wp_unslash", "esc_url_raw", "filter_var", "array_key_exists") for p in ctx.up(n)):
        yield n, "Sanitise the input."


def extends(c: Node | None, *names: str) -> bool:
    e = c.role("extends") if c is not None else None
    return e is not None and any(x.value.rsplit("\\", 1)[-1] in names for x in e.children)


@rule("middleware-in-routes", WARNING, "method_call")
def _(ctx, n):
    c = ctx.inside(n, "class")
    if on_variable(n, "$this") and n.value == "middleware" and c is not None and c.value.endswith("Controller"):
        yield n, "Middleware belongs to routes."


#: The query methods of an object-relational model.
QUERY = frozenset("where orWhere whereIn orderBy with find first all latest oldest limit join select groupBy having count pluck".split())


@rule("no-implicit-model-query", NOTE, "static_call")
def _(ctx, n):
    t = n.role("target")
    if t is not None and t.kind == "name" and n.value in QUERY - {"all", "find", "count"} and t.value.lower() not in ("self", "static", "parent", "db") and any(u.value.split("|")[1].startswith(("App\\Models", "\\App\\Models")) and u.value.split("|")[1].endswith("\\" + t.value) for u in ctx.root.walk() if u.kind == "use_item"):
        yield n, "Start the query by name."


@rule("prefer-anonymous-migration", WARNING, "class")
def _(ctx, n):
    if extends(n, "Migration"):
        yield n, "Migrations have no names."


@rule("prefer-casts-method", NOTE, "property_item")
def _(ctx, n):
    if n.value == "$casts" and extends(ctx.inside(n, "class"), "Model", "Authenticatable", "Pivot"):
        yield n, "Define casts by a method."


@rule("prefer-fake-helper", NOTE, "property_access")
def _(ctx, n):
    if n.value == "faker" and on_variable(n, "$this") and extends(ctx.inside(n, "class"), "Factory"):
        yield n, "Call fake()."


@rule("prefer-array-validation-rules", WARNING, "element")
def _(ctx, n):
    m = ctx.inside(n, "method", "method_call")
    t = string_value(n.role("value_"))
    if t is not None and "|" in t and m is not None and m.value in ("rules", "validate") and re.match(r"[a-z_]+(:[^|]+)?\|", t):
        yield n, "List the rules."


@rule("prefer-view-array", HELP, "method_call")
def _(ctx, n):
    if n.value == "with" and called(n.role("target")) == "view":
        yield n, "Pass the data to view()."


@rule("no-request-all", WARNING, "method_call", "static_call")
def _(ctx, n):
    t = n.role("target")
    if n.value == "all" and not args(n) and t is not None and (t.value == "$request" or t.kind == "name" and t.value.rsplit("\\", 1)[-1] == "Request" or called(t) == "request"):
        yield n, "Say which inputs are wanted."


#: Status codes with an assertion of their own.
STATUS = {"200": "assertOk", "201": "assertCreated", "204": "assertNoContent", "301": "assertMovedPermanently", "302": "assertFound", "400": "assertBadRequest", "401": "assertUnauthorized", "403": "assertForbidden", "404": "assertNotFound", "409": "assertConflict", "410": "assertGone", "422": "assertUnprocessable", "429": "assertTooManyRequests", "500": "assertInternalServerError"}


@rule("prefer-dedicated-status-assertion", NOTE, "method_call")
def _(ctx, n):
    if n.value == "assertStatus" and arg(n, 0) is not None and arg(n, 0).value in STATUS:
        yield n, f"Call {STATUS[arg(n, 0).value]}."


@rule("prefer-interface", NOTE, "type", "name")
def _(ctx, n):
    if n.value.lstrip("?\\") in {"DateTimeImmutable", "DateTime"} and n.kind == "type":
        yield n, "Ask for the interface."


@rule("prefer-datetimeimmutable-create-from-timestamp", HELP, "new", on=False)
def _(ctx, n):
    t, a = n.role("target"), arg(n, 0)
    if t is not None and t.value.lstrip("\\") == "DateTimeImmutable" and a is not None and (a.kind == "binary" and a.value == "." and string_value(a.role("left")) == "@" or a.kind == "template" and a.value.startswith('"@')):
        yield n, "Make it from the timestamp."


# Tests.


@rule("prefer-test-attribute", WARNING, "method", on=False)
def _(ctx, n):
    if re.match(r"test[A-Z_]", n.value) and "public" in n.flags:
        yield n, "Mark tests by an attribute."


def assertion(n: Node) -> bool:
    t = n.role("target")
    return n.value.startswith("assert") and t is not None and t.value.lower() in ("$this", "self", "static")


@rule("assertion-style", WARNING, "method_call", "static_call")
def _(ctx, n):
    if assertion(n) and n.role("target").value.lower() != "static":
        yield n, "Assertions are called on static."


@rule("strict-assertions", WARNING, "method_call", "static_call")
def _(ctx, n):
    if assertion(n) and n.value in ("assertEquals", "assertNotEquals", "assertAttributeEquals", "assertAttributeNotEquals"):
        yield n, "Assert identity."


@rule("use-specific-assertions", WARNING, "method_call", "static_call")
def _(ctx, n):
    a = arg(n, 0)
    if assertion(n) and n.value in ("assertEquals", "assertSame", "assertNotEquals", "assertNotSame") and a is not None and a.kind == "name" and a.value.lower() in ("null", "true", "false"):
        yield n, f"There is an assertion for {a.value.lower()}."


def expectation(n: Node) -> Node | None:
    """The call of expect() at the start of a chain."""
    t = n.role("target")
    while t is not None and t.kind in ("method_call", "property_access"):
        t = t.role("target")
    return t if t is not None and called(t) == "expect" else None


@rule("no-only", ERROR, "method_call")
def _(ctx, n):
    t = n.role("target")
    while t is not None and t.kind == "method_call":
        t = t.role("target")
    if n.value == "only" and t is not None and called(t) in ("test", "it", "describe"):
        yield n, "All tests are to run."


@rule("use-dedicated-expectation", WARNING, "method_call")
def _(ctx, n):
    e = expectation(n)
    v = arg(e, 0) if e is not None else None
    if v is not None and n.value in ("toBeTrue", "toBeFalse") and called(v) in ("is_array", "is_string", "is_int", "is_bool", "is_float", "is_object", "is_callable", "is_numeric", "is_null", "file_exists", "is_dir", "str_contains", "in_array", "array_key_exists"):
        yield n, "There is a matcher for this."


@rule("use-simpler-expectation", WARNING, "method_call")
def _(ctx, n):
    e = expectation(n)
    v = arg(e, 0) if e is not None else None
    if v is not None and n.value in ("toBeTrue", "toBeFalse") and (v.kind == "prefix" and v.value == "!" or v.kind == "binary" and v.value in ("===", "!==", "==", "!=", "<", ">", "<=", ">=", "instanceof")):
        yield n, "Expect the value itself."


@rule("use-specific-expectations", WARNING, "method_call")
def _(ctx, n):
    a = arg(n, 0)
    if expectation(n) is not None and n.value in ("toBe", "toEqual") and a is not None and (literal(a) and a.kind == "name" or a.kind in ("array", "legacy_array") and not a.children):
        yield n, "There is a matcher for this."
