"""Tokens of PHP source: a list of (kind, start, stop), over bytes decoded as Latin-1, so that offsets are byte offsets."""

from __future__ import annotations

import re

KEYWORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum eval exit die extends final finally fn for foreach "
    "function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use "
    "var while xor yield __halt_compiler".split()
)
#: The operators, the longest first.
OPERATORS = (
    "<<<", "**=", "...", "<=>", "===", "!==", "<<=", ">>=", "??=", "?->", "++", "--", "->", "=>", "::", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "?:", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<", ">>", "**", "|>",
    "+", "-", "*", "/", "%", "=", "<", ">", "!", ".", "(", ")", "[", "]", "{", "}", ",", ";", "?", ":", "&", "|", "^", "~", "@", "$", "\\", "#[",
)

NAME = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
LEX = re.compile(
    rf"""(?P<space>[ \t\r\n\v\f]+)
|(?P<close>\?>\r?\n?)
|(?P<attribute>\#\[)
|(?P<comment>(?://|\#)(?:(?!\?>)[^\r\n])*|/\*.*?(?:\*/|\Z))
|(?P<variable>\${NAME})
|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset|void)[ \t]*\))
|(?P<name>(?!b['"]|b<<<[ \t]*["']?[a-z_\x80-\xff])\\?{NAME}(?:\\{NAME})*)
|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*(?:\.(?![.=A-Za-z_])[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)
|(?P<single>[bB]?'(?:[^'\\]|\\.)*+(?:'|\Z))
|(?P<double>[bB]?"(?:[^"\\]|\\.)*+(?:"|\Z))
|(?P<shell>`(?:[^`\\]|\\.)*+(?:`|\Z))
|(?P<heredoc>[bB]?<<<[ \t]*(?P<q>["']?)(?P<id>{NAME})(?P=q)\r?\n.*?(?:^[ \t]*(?P=id)\b|\Z))
|(?P<operator>{"|".join(map(re.escape, OPERATORS))})
|(?P<other>.)""",
    re.X | re.S | re.M | re.I,
)
OPEN = re.compile(r"<\?php(?=[ \t\r\n]|\Z)|<\?=|<\?(?!xml)", re.I)

Token = tuple[str, int, int]


def tokens(text: str) -> list[Token]:
    """All tokens, white space and comments with them."""
    out: list[Token] = []
    at, n = 0, len(text)
    while at < n:
        m = OPEN.search(text, at)
        if not m:
            out.append(("inline", at, n))
            break
        if m.start() > at:
            out.append(("inline", at, m.start()))
        out.append(("open", m.start(), m.end()))
        at = m.end()
        while at < n:
            t = LEX.match(text, at)
            kind = t.lastgroup
            if kind in ("q", "id"):
                kind = "heredoc"
            if kind == "name" and t[0].lower() in KEYWORDS:
                kind = "keyword"
            out.append((kind, at, t.end()))
            at = t.end()
            if kind == "close":
                break
    return out
