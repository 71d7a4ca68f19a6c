"""HTML extraction by two-pass block rules.

The page is cut into blocks at block-level tags; inline elements never cut one.
The first pass decides blocks by structure (navigation, headers, footers, forms,
adverts, comments and the like are out), link density, stop-word density and
length.  Short blocks that these leave open are decided in the second pass: each
takes the label of the nearest decided block of its section, an article or what
is outside one.

What an element's class or id says takes its text out where the name is made of
words for such parts alone (``NAMES`` and ``NEUTRAL``); names of ``WEAK`` words,
and those on paragraphs, leave long prose in.  Where articles hold at least as
much main text as the rest of the page, the rest is out.

Null and empty pages, and pages without main text, give the empty text.  White
space inside a block (a line break tag counts as such) becomes one space; kept
blocks are joined in page order by one line feed.  Tags that are cut off at the
end of a page are dropped, the text before them stays.  The work is linear in a
page's length, however deep its elements.  Repeated rows and null ids give a row
each; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|math|iframe|select|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<rest2>[^<>]*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?[a-z][^>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z][a-z0-9_-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What these hold is never main text.
OUT = frozenset("nav footer aside form menu dialog button label input fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening block tag of the same kind, or the end of what holds them, closes.
LOOSE = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of parts that are not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter "
    "subscribe subscription signup login pagination pager toolbar skiplink copyright hidden paywall".split()
)
#: Names that also stand on parts of articles.
WEAK = frozenset("related recommend recommended recommendations share sharing shares social tag tags widget widgets disclaimer foot promoted teaser teasers".split())
#: What such names are put together with.
NEUTRAL = frozenset(
    "list lists box boxes wrap wrapper container item items section area block bar link links post posts article articles story stories content top bottom left right main site page global header "
    "body text inner outer unit slot form button buttons icon icons head primary secondary side skip to sub group panel row col column div the js id cta count thread tree feed sticky fixed inline".split()
)
#: On these only a name by itself counts, since they carry what a theme says of the whole page.
WHOLE = frozenset("html body main article".split())
NAME_WORDS = re.compile(r"[a-z]+")
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with by this be at from or an not have has had they which but were their one all we can her his he she you i "
    "der die und das den von zu mit im für ist auf nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so "
    "de la le les et des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais nous vous "
    "el los y del las una por con para su al lo como más pero sus ya o este sí porque esta son entre cuando muy sin sobre me hasta hay donde".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words; two count as a word.
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

#: A block of so many words and such a share of stop words is main text.
LONG_WORDS, STOP_SHARE = 12, 0.12
#: Without stop words, so many words and line-like length make it main text all the same.
VERY_LONG_WORDS = 40
#: A block with at least such a share of its characters in links is a menu; short ones from the lower share.
LINK_SHARE, SHORT_LINK_SHARE = 0.5, 0.34


@dataclass
class Block:
    text: str
    words: int
    stop_share: float
    link_share: float
    out: bool
    weak: bool  # out unless it is long prose
    article: int  # number of the article or main element it is in; 0: none
    heading: bool


@dataclass
class Open:
    tag: str
    out: bool
    weak: bool
    article: int
    heading: bool
    mute: bool  # an inline element whose text goes without cutting its block
    block: Open | None = None  # what such an element stands in


NOTHING = Open("", False, False, 0, False, False)


def by_name(value: str, tag: str) -> tuple[bool, bool]:
    """Whether a class or id says that its element is out, and whether it says so weakly."""
    out = weak = False
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = NAME_WORDS.findall(name)
        strong, soft = any(w in NAMES for w in words), any(w in WEAK for w in words)
        if tag in WHOLE:
            out |= len(words) == 1 and (strong or soft)
        elif (strong or soft) and all(w in NAMES or w in WEAK or w in NEUTRAL for w in words):
            out |= strong and tag not in LOOSE
            weak |= not strong or tag in LOOSE
        else:
            weak |= strong and not {"has", "no", "with", "without"}.intersection(words)
    return out, weak and not out


def is_out(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    if tag in OUT or (tag == "header" and not in_article):
        return True, False
    weak = False
    for name, value, hidden in ATTRIBUTE.findall(rest) if rest.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if hidden and not name:
            return True, False
        if name == "role" and value.lower() in OUT_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name in ("class", "id") and tag not in ("html", "body"):
            out, soft = by_name(value, tag)
            if out:
                return True, False
            weak |= soft
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, weak


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in page order, those without text left out."""
    out: list[Block] = []
    stack: list[Open] = []
    opened: dict[str, list[int]] = {}  # places on the stack by tag
    text: list[str] = []
    linked = links = articles = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            low = LETTERS.findall(words.lower())
            count = len(low) + (0 if words.isascii() else len(DENSE.findall(words)) // 2)
            o = stack[-1] if stack else NOTHING
            o = o.block if o.mute else o
            out.append(Block(words, count, sum(w in STOP_WORDS for w in low) / max(1, len(low)), min(1.0, linked / len(words)), o.out, o.weak, o.article, o.heading))
        text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part and not (stack and stack[-1].mute):
            part = html.unescape(part)
            text.append(part)
            if links:
                linked += len(part)

    def push(tag: str, gone: bool, weak: bool, article: int, mute: bool = False) -> None:
        o = stack[-1] if stack else NOTHING
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, gone or o.out, weak or o.weak, article, tag in HEADINGS or o.heading, mute, (o.block if o.mute else o) if mute else None))

    def pop_to(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, rest = (m["close"] or m["close2"] or "") == "/", m["rest"] or m["rest2"] or ""
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS or tag in OUT:
            flush()
            links = 0
            if closing:
                if opened.get(tag):
                    pop_to(opened[tag][-1])
            elif tag not in VOID and not rest.endswith("/"):
                while stack and (stack[-1].mute or stack[-1].tag in LOOSE and (tag == stack[-1].tag or stack[-1].tag == "p" or tag in ("li", "dt", "dd", "tr") and stack[-1].tag in ("dt", "dd", "td", "th") or stack[-1].tag in HEADINGS)):
                    if stack[-1].mute:  # what holds a block is no inline element
                        stack[-1].mute = False
                        break
                    pop_to(len(stack) - 1)
                if tag == "body":
                    while stack and stack[-1].tag == "head":
                        pop_to(len(stack) - 1)
                inside = stack[-1].article if stack else 0
                if tag in ("article", "main") and not inside:
                    articles += 1
                    inside = articles
                push(tag, *is_out(tag, rest, inside > 0), inside)
        elif not closing and tag not in VOID and rest and not rest.endswith("/") and is_out(tag, rest, True)[0]:
            push(tag, True, False, stack[-1].article if stack else 0, mute=True)
        elif closing and stack and stack[-1].tag == tag:
            if not stack[-1].mute:
                flush()
            pop_to(len(stack) - 1)
    add(page[at:])
    flush()
    return out


def first_pass(b: Block) -> bool | None:
    """True: main text, False: not; None: short and open."""
    if b.out or b.link_share >= LINK_SHARE or (b.link_share >= SHORT_LINK_SHARE and b.words < LONG_WORDS):
        return False
    if not b.heading and (b.words >= LONG_WORDS and b.stop_share >= STOP_SHARE or b.words >= VERY_LONG_WORDS):
        return True
    return False if b.weak else None


def articles_only(blocks: list[Block], labels: list[bool | None]) -> bool:
    """Whether articles hold at least as much main text as the rest, or some text where there is no main text at all."""
    within = sum(b.words for b, x in zip(blocks, labels, strict=True) if x and b.article)
    beside = sum(b.words for b, x in zip(blocks, labels, strict=True) if x and not b.article)
    return within >= beside and any(b.article and x is not False for b, x in zip(blocks, labels, strict=True))


def second_pass(blocks: list[Block], labels: list[bool | None], beside: bool = False) -> list[bool]:
    """Open blocks take the label of the nearest decided block of their section.

    At equal distance the block that follows decides.  Where a section has no
    decided block, an article's blocks are main text, but not ``beside`` a page's
    main text, and so are those of a page without articles.
    """
    before: list[int | None] = []
    last: int | None = None
    for i, (b, x) in enumerate(zip(blocks, labels, strict=True)):
        if last is not None and blocks[last].article != b.article:
            last = None
        before.append(last)
        if x is not None and not b.out:  # what stands in a menu or an advert says nothing of its neighbours
            last = i
    out: list[bool] = []
    following: int | None = None
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if following is not None and blocks[following].article != b.article:
            following = None
        x = labels[i]
        if x is None:
            near = [(j - i, labels[j]) for j in [following] if j is not None] + [(i - j, labels[j]) for j in [before[i]] if j is not None]
            out.append(bool(min(near, key=lambda y: y[0])[1]) if near else not (beside and b.article))
        else:
            out.append(x)
            if not b.out:
                following = i
    return out[::-1]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    labels = [first_pass(b) for b in blocks]
    if articles_only(blocks, labels):
        labels = [x if b.article else False for b, x in zip(blocks, labels, strict=True)]
    keep = second_pass(blocks, labels, any(x and not b.article for b, x in zip(blocks, labels, strict=True)))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and the main ``text`` of each page."""
    rows = pages.select(*(F.col(c) for c in keep), F.col(html_col).cast("string").alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("__html").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return common.map_batches(rows, run, f"{kinds}, text string")
