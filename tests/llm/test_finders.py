"""The parts of the operators that need no Spark, against brute force."""

import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from corpuscope.llm import common, decontam, html_extract, packing, phrase_automata, quality_crf, repeats, simhash, suffix_bwt, token_counts, toxicity

ODD_TEXTS = [" ", "  ", "\n", "\t", "a", "B'", "'s", "'S", "1", "23", "é", "É", "É", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", "　", "\x1c", "\x85", "!?", "日本", "'", "​", "́", " x", ".", ",", "a, ", "Σ"]


def odd_texts(n):
    r = random.Random(1)
    return ["".join(r.choices(ODD_TEXTS, k=r.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("find,join", [(suffix_bwt.recurring_windows, b"".join), (phrase_automata.recurring_windows, b" ".join)])
def test_recurring_windows(find, join):
    r = random.Random(3)
    for _ in range(200):
        length, letters = r.choice([1, 2, 3, 5, 8]), r.choice(["ab", "abcd", "abcdefghijklmnop"])
        texts = list(dict.fromkeys("".join(r.choices(letters, k=r.randint(length, 40))) for _ in range(r.randint(1, 12))))
        weights = [r.choice([1, 1, 2]) for _ in texts]
        count = Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - length + 1):
                count[t[i : i + length]] += w
        want = [repeats.runs_of(np.array([count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)], bool)) for t in texts]
        assert find([join(c.encode() for c in t) for t in texts], weights, length) == want


def test_window_keys_follow_content():
    for unit in (repeats.Unit(False, 20, 5), repeats.Unit(True, 6, 2)):
        r = random.Random(2)
        same = " ".join("".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(40))
        seen: dict[bytes, set[int]] = {}
        for lead in ("", "x ", "yy zz ", "long lead  of\nwords "):
            text = repeats.Text(lead + same, unit)
            for at, keys, _ in repeats.keys_of(text):
                for i, k in enumerate(keys.tolist()):
                    seen.setdefault(text.part(at + i, at + i + unit.length), set()).add(k)
        assert all(len(k) == 1 for k in seen.values())


def test_word_numbers_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(4)
    for _ in range(100):
        words = ["".join(r.choices("abé", k=r.choice([1, 2, 5, 40]))) for _ in range(r.randint(1, 30))]
        text = repeats.Text("".join(r.choice(["", " ", " \n" * 9]) + " " + w for w in words) + r.choice(["", " ", "\t" * 20]), repeats.Unit(True, 3, 2))
        a = r.randrange(len(words))
        b = r.randint(a + 1, len(words))
        whole = text.values(a, b)
        alone = [repeats.Text(w, text.unit).values(0, 1)[0] for w in words[a:b]]
        for piece in (1, 2, 7, 64):
            monkeypatch.setattr(repeats, "PIECE", piece)
            assert (text.values(a, b) == whole).all()
        monkeypatch.undo()
        assert whole.tolist() == alone


@pytest.mark.parametrize("words", [["x" * 4_000_000], [f"{i:040d}" for i in range(100_000)]])
def test_keys_of_long_words_take_bounded_memory(words):
    text = repeats.Text(" ".join([*map(str, range(50)), *words, *map(str, range(50))]), repeats.Unit(True, 35, 8))
    tracemalloc.start()
    for _ in repeats.keys_of(text):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


@pytest.mark.parametrize("unit", [repeats.Unit(False, 20, 5), repeats.Unit(True, 6, 2)])
def test_blocks_hold_each_window_once_and_follow_content(unit):
    r = random.Random(7)
    seen: dict[tuple[int, bytes], set[bytes]] = {}
    for _ in range(60):
        text = repeats.Text(" ".join(r.choices(["a", "bb", "ccc", "d"], k=60)), unit)
        wanted = np.unique(np.concatenate([k for _, k, _ in repeats.keys_of(text)]))
        for h, a, n in repeats.stretches(text, wanted):
            part = text.part(a, a + n + unit.length - 1)
            for block in repeats.blocks_of(unit):
                cut = list(repeats.parted(part, h, block, unit))
                assert [x for _, b, m in cut for x in range(b, b + m)] == list(range(n)) and all(m <= block for *_, m in cut)
                for g, b, m in cut:
                    for x in range(b, b + m):
                        seen.setdefault((block, text.part(a + x, a + x + unit.length)), set()).add(g)
    assert all(len(g) == 1 for g in seen.values()) and len(seen) > 1000


def test_gram_hashes_and_sliding():
    v = np.random.default_rng(0).integers(1, 5, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 48):
        g = repeats.gram_hashes(v, k)
        by = {}
        for i in range(len(v) - k + 1):
            by.setdefault(tuple(v[i : i + k]), set()).add(int(g[i]))
        assert len(g) == len(v) - k + 1 and all(len(x) == 1 for x in by.values()) and len({x for s in by.values() for x in s}) == len(by)
    for w in (1, 2, 5, 28):
        assert (repeats.sliding(v, w, np.minimum) == [v[i : i + w].min() for i in range(len(v) - w + 1)]).all()


def test_fingerprint():
    for t in ("", "one", "One two", "a b c", "The cat sat on the mat the cat sat", "x " * 70000):
        words = t.encode().lower().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_of_a_list_by_tally():
    r = np.random.default_rng(0)
    for n in (40, 400, 3000):
        fps = np.unique(np.uint64(0xABCDEF0000000000) + r.integers(0, 1 << 20, n).astype(np.uint64))
        parent = {int(f): int(f) for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in fps:
            for b in fps[np.bitwise_count(fps ^ a) <= 2]:
                x, y = root(int(a)), root(int(b))
                parent[max(x, y)] = min(x, y)
        assert sorted(simhash.list_links(fps, 2)) == sorted((f, root(f)) for f in parent if root(f) != f)
    a, b = (np.array([x], np.uint64) for x in (0x0102030405060708, 0x0102FF0405060709))
    assert simhash.tally(a, np.concatenate([a, b])).tolist() == [[8, 6]]


def test_token_counts_are_those_of_whole_texts():
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.splits
    texts = odd_texts(4000) + ["the end. " * 3000, "x" * 5000, "it's, a.\nB c,\n d"]
    assert counter.counts(texts) == [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    model = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.counts(["Hello there", ""]) == [len(model.model.encode("Hello there")), 0]


def test_ids_are_those_of_whole_texts():
    r = random.Random(5)
    letters = ["a", "é", "É", "'", "s", "re", "ll", "'t", " ", "1", "—", "’", "!", "x", "...", "ß", "À", "\n", "÷", "×", "ñ", "\u2009", "\u2028", "\x00", "µ"]
    texts = odd_texts(4000) + ["", "The end. " * 500, "x" * 300_000] + ["".join(r.choices(letters, k=r.randint(0, 20))) for _ in range(8000)]
    for path, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = packing.Encoder(public_tokenizers.path(path))
        assert e.by_words == by_words
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_caches_are_bounded_by_bytes():
    cache = common.ByteCache(10_000)
    assert [cache.look_up([k], lambda k: k * 2)[0] for k in map(b"%d".__mod__, range(500))] == [b"%d" % i * 2 for i in range(500)]
    assert 0 < len(cache.young) + len(cache.old) < 60
    assert cache.look_up([b"x" * 1000], lambda k: b"y") == [b"y"] and b"x" * 1000 not in cache.young


@pytest.mark.parametrize("low,high", [(900, 3000), (1, 4096), (1000, 2100), (2500, 4000), (4096, 4097)])
def test_local_search_packs_everything_and_never_worse(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 600)
    start = packing.best_fit(sizes, 4096)
    search = packing.Search(sizes, start, 4096)
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(int(sizes[b].sum()) for b in bins) <= 4096
    least = packing.least_bins(sizes, 4096)
    assert least <= len(bins) <= len(start)
    if len(bins) > least:  # a local optimum: no step is left on any bin
        for a in [k for k, f in enumerate(search.fill) if 0 < f < 4096]:
            own = list(search.bins[a])
            assert not (search.move(a, own) or search.one_for_one(a, own) or search.two_for_one(a, own) or search.one_for_two(a, own))


def test_local_search_is_what_empties_bins():
    sizes = np.minimum(4096, np.random.default_rng(1).lognormal(6.5, 1.1, 8000).astype(int) + 1)
    start = packing.best_fit(sizes, 4096)
    search = packing.Search(sizes, start, 4096)
    assert len(search.run()) == packing.least_bins(sizes, 4096) < len(start)
    assert set(search.steps) == {"move", "one_for_one", "two_for_one", "one_for_two"} and min(search.steps.values()) > 5


def test_each_step_increases_the_squared_fills():
    for sizes, bins, kind in (([6, 4, 3, 7, 5, 5], [[0, 2], [1, 4], [3], [5]], None), ([3, 5, 2], [[0], [1, 2]], "move"), ([4, 5, 3, 2], [[0, 3], [1, 2]], "one_for_one"), ([4, 4, 7, 1], [[0, 1], [2, 3]], "two_for_one"), ([5, 2, 2, 5], [[0], [1, 2, 3]], None)):
        search = packing.Search(np.array(sizes), bins, 10)
        before = int((search.fill**2).sum())
        out = search.run()
        assert sorted(i for b in out for i in b) == list(range(len(sizes))) and (int((search.fill**2).sum()) > before) == bool(search.steps)
        assert len(out) == packing.least_bins(np.array(sizes), 10)


def test_myers():
    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    r = random.Random(0)
    for _ in range(500):
        p, t = "".join(r.choices("abc", k=r.randint(1, 12))), "".join(r.choices("abc", k=r.randint(0, 20)))
        assert decontam.myers(decontam.masks(p), len(p), t)[0] == least(p, t)


def test_matcher_finds_items_within_the_budget():
    r = random.Random(5)
    item = "".join(r.choices("abcdefgh ", k=200)).strip()
    k = decontam.budget(len(item), decontam.RATE)
    m = decontam.Matcher((item, "short one", "ab cd efgh ij klmn"), decontam.RATE)
    for edits in range(k + 1):
        t = list(item)
        for i in r.sample(range(len(t)), edits):
            t[i] = "z"
        assert [x[:1] for x in m.find("lead " + "".join(t) + " tail")] == [(0,)]
    assert m.find("x" * 300) == [] and m.find("") == [] and m.find("short one") == [(1, 0, 9)] and m.find("a short one here") == [(1, 0, 11)]
    assert m.find("ashort one") == [] and m.find("short ones") == [] and m.find("short ones short one") == [(1, 0, 20)]
    assert m.find("so ab cd xfgh ij klmn") == [(2, 1, 21)]
    long = "".join(r.choices("abcdefgh ", k=5000)).strip()
    m = decontam.Matcher((long,), decontam.RATE)
    k = decontam.budget(len(long), decontam.RATE)
    for edits, hit in ((0, True), (k, True), (2 * k, False)):
        t = list(long)
        for i in r.sample(range(len(t)), edits):
            t[i] = "z"
        assert [x[:2] for x in m.find("lead " + "".join(t) + " tail")] == [(0, edits)] * hit
    assert m.find(long[: len(long) // 2]) == []


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies on the site.</div><nav><a href=1>Home</a></nav>
<main><article><h1>My Title</h1><p>The quick brown fox of the world is in a house &amp; it was on the hill with a dog.<br>And   more.</p><pre>code a
 b</pre><div class="ad">Buy the of and to in a is that for it was on are</div><p>Short.</p><form><p>Subscribe to the</p></form>
<section class="comments"><p>The comment of a reader is in the page and it is that for it was on.</p></section></article></main><aside>Related the of and to in</aside><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "My Title\nThe quick brown fox of the world is in a house & it was on the hill with a dog. And more.\ncode a b\nShort."
    for page, text in ((None, ""), ("", ""), ("<p>abc</p><a href=\"x", "abc"), ("<script>var a='<p>x</p>'", ""), ("a &lt;b&gt; &#233;", "a <b> é"), ("<<<>>", "<<<>>")):
        assert html_extract.main_text(page) == text
    assert html_extract.main_text("<p>" + "the word of it " * 50000 + "</p>").count("word") == 50000


LONG = "The quick brown fox of the world is in a house and it was on the hill with a dog."
PROSE = "It was the best of the times that they had in this town, and all of them were on the hill for an hour."
PAGES = [
    (f"<article><p>{LONG}</p><article class='comment'><p>{PROSE}</p></article></article><article class='advert'><p>{PROSE}</p></article>", LONG),
    (f"<main><div class='related-work'><p>{LONG}</p></div></main>", LONG),
    (f"<article><p class='foot-note share'>{LONG}</p></article>", LONG),
    (f"<div class='post'><p>{LONG}</p><p>{PROSE}</p></div><article><p>Short teaser.</p></article>", f"{LONG}\n{PROSE}"),
    (f"<article><p>one <span class='tags'>two</span> three {LONG}</p></article>", f"one two three {LONG}"),
    (f"<article><p>one <span hidden>two</span>three {LONG}</p></article>", f"one three {LONG}"),
    (f"<article><p>{LONG} <span hidden><div>{PROSE}</div></span></p><p>{PROSE}</p></article>", f"{LONG}\n{PROSE}"),
    (f"<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><p>{LONG}</p>", LONG),
    (f"<body class='has-sidebar comments-open'><article class='post has-comments sidebar-right'><p>{LONG}</p></article></body>", LONG),
    (f"<article><h1>Title</h1><p>{LONG}</p><h2>Part</h2><p>{PROSE}</p></article>", f"Title\n{LONG}\nPart\n{PROSE}"),
    (f"<article><p>{LONG}</p><section id='comments'><h2>2 comments</h2><p>{PROSE}</p></section></article>", LONG),
    (f"<div class='cookie-notice'><p>{PROSE}</p></div><article><p>{LONG}</p></article>", LONG),
    (f"<div class='ad-box'>{PROSE}</div><p>{LONG}</p><div id='newsletter-signup'>{PROSE}</div>", LONG),
    (f"<article><p>{LONG}</p><div class='share-buttons'><a href=1>Post</a> <a href=2>Mail</a></div><ul class='tags'><li>fox<li>dog</ul></article>", LONG),
    (f"<article><ul><li>{LONG}<li>{PROSE}</ul></article>", f"{LONG}\n{PROSE}"),
    (f"<article><table><tr><td>{LONG}<td>Fox</table><p>{PROSE}</p></article>", f"{LONG}\nFox\n{PROSE}"),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer>By me</footer></article>", f"Title\n{LONG}"),
    (f"<header><h1>Site</h1><p>{PROSE}</p></header><p>{LONG}</p><footer><p>{PROSE}</p></footer>", LONG),
    (f"<article><p>{LONG}</p><div style='display: none'>{PROSE}</div><div aria-hidden=true>{PROSE}</div><div role=dialog>{PROSE}</div></article>", LONG),
    (f"<article><p>A &lt;b&gt; &amp;amp; caf&eacute; &#x27;x&#39; {LONG}</p></article>", f"A <b> &amp; café 'x' {LONG}"),
    (f"<article><p>{LONG}<br>{PROSE}</p><form><label>Name</label><textarea>{PROSE}</textarea></form></article>", f"{LONG} {PROSE}"),
    (f"<article><p>{LONG}</p><!-- {PROSE} --><script>'<p>{PROSE}</p>'</script><style>p {{}}</style><noscript>{PROSE}</noscript></article>", LONG),
    (f"<article><p>{LONG}</p><aside><p>{PROSE}</p></aside><div class='related'><p><a href=1>{PROSE}</a></p></div></article>", LONG),
    (f"<article><p>{'漢字の文章です' * 12}</p></article><p>短い</p>", "漢字の文章です" * 12),
    (f"<blockquote>{LONG}</blockquote><pre>a  b\n c</pre><p>{PROSE}</p>", f"{LONG}\na b c\n{PROSE}"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text_of_pages(page, text):
    assert html_extract.main_text(page) == text
    assert html_extract.main_text(f"<html><head><title>T</title></head><body>\n{page}\n</body></html>") in (text, html_extract.main_text(page))


def test_deep_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>a" * 100_000, "<span hidden>" * 50_000 + "<p>a", "<div class=x>" * 50_000 + "</p>" * 50_000):
        html_extract.main_text(page)
    assert time.process_time() - began < 20


def test_rules():
    def brute(t):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if __import__("re").search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)

    r = random.Random(4)
    for _ in range(500):
        t = "".join(r.choices(["a", "b", " ", "  ", "\n", "é", "#", "|", "\x85", "\xa0", "\x1f", "a b a b ", "\r\n"], k=r.randint(0, 40)))
        assert quality_crf.rules(t) == brute(t)


def test_field_decodes_the_likeliest_labels():
    r = np.random.default_rng(1)
    f = quality_crf.Field()
    f.emit, f.move = r.normal(size=f.emit.shape), r.normal(size=(2, 2))
    on = np.stack([quality_crf.OFFSETS[:-1] + r.integers(0, 2, len(quality_crf.CUTS)) for _ in range(7)])
    s = f.scores(on)

    def value(y):
        return sum(s[i, a] for i, a in enumerate(y)) + sum(f.move[a, b] for a, b in zip(y, y[1:]))

    labels = [[k >> i & 1 for i in range(7)] for k in range(128)]
    assert f.decode(on) == max(labels, key=value)
    z = np.logaddexp.reduce([value(y) for y in labels])
    p, pair = f.marginals(s, [np.array([k]) for k in range(7)], np.zeros(7, int), np.ones(1))
    assert np.isclose(p[3, 1], sum(np.exp(value(y) - z) for y in labels if y[3]))
    assert np.isclose(pair[0, 1], sum(np.exp(value(y) - z) * sum(a < b for a, b in zip(y, y[1:])) for y in labels))


def test_field_learns_lines_from_labels_of_mixed_texts():
    r = random.Random(6)
    words = "the house of a man is in the town and it was on the hill with an old tree by the river".split()

    def content():
        return " ".join(r.choices(words, k=r.randint(12, 30))).capitalize() + "."

    def boilerplate():
        return r.choice(["Home | About | Contact", "LOGIN REGISTER CART 0", "$$$ *** ###", "http://x.example/a?b=1 | 12345", "SHARE: FB | TW | 99"])

    def text(good):
        body, rest = [content() for _ in range(r.randint(6, 90))], [boilerplate() for _ in range(r.randint(2, 5))]
        if good:
            return [(x, 1) for x in body] + [(x, 0) for x in rest]
        return [(boilerplate(), 0) for _ in range(r.randint(30, 200))] + [(content(), 1) for _ in range(2)]

    texts = [(text(k % 2), k % 2) for k in range(240)]
    rows = [(quality_crf.features([x for x, _ in t]), np.array([len(x.split()) for x, _ in t]), y) for t, y in texts[:160]]
    field = quality_crf.Field().fit(rows)
    right = total = 0
    for t, y in texts[160:]:
        got = field.decode(quality_crf.features([x for x, _ in t]))
        right += sum(a == b for a, (_, b) in zip(got, t))
        total += len(t)
        assert (quality_crf.content_share(field, "\n".join(x for x, _ in t)) >= 0.5) == bool(y)
    assert right >= 0.95 * total
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]


def test_counterfactual_penalty_frees_identity_terms():
    rows, labels, pairs = [], [], []
    for i in range(200):
        toxic = i % 2
        text = f"{'muslim' if i % 4 < 3 and toxic or not toxic and i % 8 == 0 else 'christian'} people {'are idiot' if toxic else 'are kind'} word{i % 7}."
        rows.append(toxicity.slots(toxicity.words_of(text)))
        labels.append(toxic)
        pairs += toxicity.pairs_of(text)
    model = toxicity.train(rows, labels, pairs)
    assert model.score("christian people are idiot") > 0.7 > 0.5 > model.score("christian people are kind")
    assert abs(model.score("muslim people walk") - model.score("christian people walk")) < 0.02
    assert toxicity.train([], [], []).score("x") == 0.0


def test_slot_is_stable():
    assert toxicity.slot("word") == zlib.crc32(b"word") % toxicity.WIDTH
