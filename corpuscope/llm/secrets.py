"""Secret scans by patterns and a battery of randomness tests, all in Spark's own functions.

Three fixed patterns give the base spans.  The method adds spans of kind
``random``: runs of at least ``SHORTEST`` encoding characters whose encoding can
be inferred (hexadecimal, base 32 and 36 in either case, letters of both cases,
base 64); runs that decode to printable text have none.  The battery gives each
run four numbers, standard normal where characters are drawn evenly from the
alphabet and large for words: chi-squared for the counts of characters, a runs
test of their classes (upper case, lower case, digits, signs), the size of the
lag-one serial correlation, and the likelihood ratio of adjacent letters.

The null hypothesis is that a run is a word, a name or a path.  It is fitted on
the corpus: adjacent letters are counted over the words of all texts, and the
``VOCABULARY`` most frequent words, put together in the styles of identifiers,
give the battery's mean and spread by encoding and length class.  A run's
p-value is the chance that such a name looks as random as it does; the
Benjamini-Hochberg rule settles within each length class which runs are
discoveries, at a false-discovery rate of ``FALSE_RATE``.  A discovery that the
battery tells from evenly drawn characters (``MOST_UNEVEN``) is dropped.

What the driver gets is bounded by its keys: pairs of letters, encodings,
length classes and tenths of -ln p.

Null and empty texts have no spans.  Offsets count code points, the end is
exclusive.  Random spans that overlap a base span are not added.  Repeated rows
and null ids give a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What every match of ``ASSIGN`` holds in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = 6

SHORTEST = 20
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
#: Share of the discoveries that may be names.
FALSE_RATE = 0.05
#: The battery's sum from which characters are not evenly drawn; one in a hundred random strings is beyond it.
MOST_UNEVEN = 5.2
#: Most frequent words that names are put together from.
VOCABULARY = 2048
#: Words that count once beside those of the corpus.
WORDS = (
    "about", "access", "account", "address", "after", "again", "application", "array", "before", "between", "buffer", "button", "change", "character", "check", "class", "client", "close", "code", "column",
    "command", "component", "config", "connection", "content", "context", "control", "count", "create", "current", "data", "database", "date", "default", "delete", "description", "device", "document", "element", "error",
    "event", "example", "export", "field", "file", "filter", "first", "format", "function", "general", "group", "handler", "header", "image", "import", "index", "information", "input", "install", "interface",
    "internal", "item", "label", "language", "length", "level", "library", "light", "line", "list", "local", "location", "manager", "message", "method", "model", "module", "name", "network", "number",
    "object", "option", "order", "output", "package", "page", "parameter", "parent", "parser", "path", "point", "position", "process", "project", "property", "provider", "public", "query", "question", "record",
    "report", "request", "resource", "response", "result", "return", "screen", "search", "section", "select", "server", "service", "session", "setting", "source", "start", "state", "status", "string", "style",
    "system", "table", "target", "template", "test", "text", "time", "title", "type", "update", "user", "value", "version", "view", "window", "world",
)
#: Buckets of a tenth of -ln p; the last holds all beyond.
BUCKETS = 4000
MASK = "[SECRET]"

KINDS = ("assign", "access", "hex", "random")
SPAN = "struct<start:int,kind_no:int,kind:string,stop:int>"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Where a new class of characters starts in each alphabet.
CLASSES = {"hex": (10,), "base32": (26,), "base36": (26,), "letters": (26,), "base64": (26, 52, 62)}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of encoded text: printable ones, tabs and line ends.
PRINTABLE = "^(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E])+$"
#: Matches whose places are summed together.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is made once."""
    return F.transform(F.array(value), use)[0]


def places(text: Column, pattern: str, found: Column) -> Column:
    """Start and end of each of ``found``, all matches of ``pattern`` in ``text``, in code points.

    What stands between matches comes from splitting at the same pattern.
    Sums are made chunk by chunk, so the work does not grow with the square of
    the number of matches.
    """
    both = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("own"))
    kind = "array<struct<start:int,stop:int>>"

    def inner(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["own"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["own"]).alias("stop")))).cast(kind).alias("out"))

    def outer(both: Column, acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(both, k * CHUNK + 1, F.least(F.lit(CHUNK), F.size(found) - k * CHUNK)), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), inner)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).cast(f"array<{kind}>").alias("out"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))

    def whole(both: Column) -> Column:
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), lambda acc, k: outer(both, acc, k), lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(found) > 0, F.transform(F.array(both), whole)[0]).otherwise(F.array().cast(kind))  # the array binds both, which is then made once


def erfc_tail(z: Column) -> Column:
    """1 - Φ(z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    poly = bound(1 / (1 + 0.2316419 * z), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def lower_tail(z: Column) -> Column:
    return F.when(z <= 0, erfc_tail(F.least(-z, F.lit(37.0)))).otherwise(1 - erfc_tail(F.least(z, F.lit(37.0))))


def encoding(run: Column) -> Column:
    """The narrowest alphabet that a run fits; null: none, or plain text in base 64 or hexadecimal."""
    low, up = run.rlike("[a-z]"), run.rlike("[A-Z]")
    bare = F.rtrim(F.translate(run, "=-_", " +/"))
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    text = F.hex(F.try_to_binary(padded, F.lit("base64"))).rlike(PRINTABLE)
    return (
        F.when(run.rlike("[0-9]") & (low != up) & F.upper(run).rlike("^[0-9A-F]+$"), F.when(~F.upper(run).rlike(PRINTABLE), F.lit("hex")))
        .when((low != up) & F.upper(run).rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
        .when((low != up) & F.upper(run).rlike("^[A-Z0-9]+$"), F.lit("base36"))
        .when(~F.coalesce(text, F.lit(False)) & up & low & run.rlike("^[A-Za-z]+=*$"), F.lit("letters"))
        .when(~F.coalesce(text, F.lit(False)) & (up | low), F.lit("base64"))
    )


def expected(code: str) -> Column:
    """An alphabet, the chances that two and three characters are of one class, and where classes start."""
    k = len(ALPHABETS[code])
    ends = [0, *CLASSES[code], k]
    shares = [(b - a) / k for a, b in zip(ends, ends[1:], strict=False)]
    starts = [*CLASSES[code], k, k][:3]
    return F.struct(
        F.lit(ALPHABETS[code]).alias("alphabet"),
        F.lit(sum(p**2 for p in shares)).alias("two"),
        F.lit(sum(p**3 for p in shares)).alias("three"),
        F.array(*(F.lit(float(x)) for x in starts)).alias("starts"),
    )


def doubles(values: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{x:.17e}D' for x in values)})")


class Pairs:
    """Likelihood ratios of adjacent letters, words against evenly drawn ones, from the counts of pairs."""

    def __init__(self, counts: dict[str, int]):
        k = len(LETTERS)
        self.scores = []
        for a in LETTERS:
            row = [counts.get(a + b, 0) + 1 for b in LETTERS]
            self.scores += [math.log(k * n / sum(row)) for n in row]
        self.mean = sum(self.scores) / k**2
        self.spread = math.sqrt(max(1e-9, sum(x * x for x in self.scores) / k**2 - self.mean**2))

    def table(self) -> Column:
        return doubles(self.scores)


def battery(run: Column, code: Column, pairs: Pairs) -> Column:
    """The sum of the four tests' numbers for one run of inferred encoding ``code``."""
    bare = F.translate(run, "=", "")
    own = F.when(code == "base64", F.translate(bare, "-_", "+/")).when(code == "letters", bare).when(code == "hex", F.lower(bare)).otherwise(F.upper(bare))
    law = expected("base64")
    for c in ("hex", "base32", "base36", "letters"):
        law = F.when(code == c, expected(c)).otherwise(law)

    def places_in(chars: Column, alphabet: Column) -> Column:
        return F.transform(chars, lambda c: F.call_function("locate", c, alphabet).cast("double") - 1)

    def beside(x: Column) -> Column:
        return F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def moments(x: Column, n: Column) -> Column:
        def about(mean: Column) -> Column:
            spread = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
            lag = total(F.transform(beside(x), lambda p: (p["a"] - mean) * (p["b"] - mean)))
            return bound(F.struct(spread.alias("spread"), lag.alias("lag")), lambda m: F.when(m["spread"] > 0, F.abs((m["lag"] / m["spread"] + 1 / n) * F.sqrt(n))).otherwise(F.sqrt(n)))

        return bound(total(x) / n, about)

    def ratios(met: Column) -> Column:
        return F.when(F.size(met) > 0, (total(met) - F.size(met) * pairs.mean) / (F.sqrt(F.size(met).cast("double")) * pairs.spread)).otherwise(0.0)

    def tests(s: Column) -> Column:
        x, law = s["x"], s["law"]
        k, n = F.length(law["alphabet"]).cast("double"), F.size(x).cast("double")
        squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
        chi, df = squares * k / n - n, k - 1
        counts = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        starts = law["starts"]
        sort = F.transform(x, lambda v: F.when(v < starts[0], 0).when(v < starts[1], 1).when(v < starts[2], 2).otherwise(3))
        same = F.size(F.filter(beside(sort), lambda p: p["a"] == p["b"]))
        two, three = law["two"], law["three"]
        runs = (same - (n - 1) * two) / F.sqrt((n - 1) * (two - two * two) + 2 * (n - 2) * (three - two * two))
        met = F.filter(beside(s["letters"]), lambda p: (p["a"] > 0) & (p["b"] > 0) & ~((p["a"] < 100) & (p["b"] > 100)))  # no pair where a new word starts in upper case
        scores = F.transform(met, lambda p: F.element_at(s["table"], (p["a"] % 100 - 1) * len(LETTERS) + p["b"] % 100))
        return counts + runs + moments(x, n) + bound(scores, ratios)

    def letters(chars: Column) -> Column:
        """1 to 26 for a to z, 101 to 126 for A to Z, 0 for others."""
        return F.transform(chars, lambda c: bound(F.call_function("locate", c, F.lit(LETTERS + LETTERS.upper())), lambda i: F.when(i > len(LETTERS), i - len(LETTERS) + 100).otherwise(i)))

    def chars(text: Column) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    packed = F.struct(places_in(chars(own), law["alphabet"]).alias("x"), letters(chars(bare)).alias("letters"), law.alias("law"), pairs.table().alias("table"))
    return bound(packed, tests)


def length_class(n: Column) -> Column:
    """Quarter steps of the logarithm of the length: 17 at 20 characters, at most 124."""
    return F.floor(4 * F.log2(n.cast("double"))).cast("int")


@dataclass
class Null:
    """What names look like: counts of adjacent letters, and mean and spread of the battery by encoding and length class."""

    pairs: Pairs
    by_class: dict[tuple[str | None, int | None], tuple[float, float]]

    def minus_log_p(self, score: Column, code: Column, size: Column) -> Column:
        """-ln of the chance that a name of that encoding and length looks as random."""
        classes = [c for k, c in self.by_class if k is None and c is not None]
        low, high = min(classes, default=0), max(classes, default=0)
        laws = [self.law(k, c) for k in ALPHABETS for c in range(low, high + 1)]
        known = F.array(*map(F.lit, ALPHABETS))
        place = ((F.array_position(known, code) - 1) * (high - low + 1) + F.least(F.lit(high), F.greatest(F.lit(low), size)) - low + 1).cast("int")
        mean, spread = (F.element_at(doubles([x[i] for x in laws]), place) for i in (0, 1))
        return bound((score - mean) / spread, lambda z: -F.log(F.greatest(lower_tail(z), F.lit(1e-170))))

    def law(self, code: str, size: int) -> tuple[float, float]:
        for key in ((code, size), (None, size), (None, None)):
            if key in self.by_class:
                return self.by_class[key]
        return 0.0, 1.0


#: Names of one encoding and length class from which they have a law of their own.
LEAST_NAMES = 40


def names(words: DataFrame) -> DataFrame:
    """Identifiers (``run``) in several styles, put together from the ``word`` of all rows."""
    n = max(1, words.count() // 8)
    lists = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(n)).alias("g")).agg(F.array_sort(F.collect_list("word")).alias("ws"))  # VOCABULARY words in all
    parts = lists.select("g", "ws", F.explode(F.sequence(F.lit(1), F.size("ws"), F.lit(3))).alias("at")).select("g", "ws", "at", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("many"))
    some = parts.where(F.col("at") + F.col("many") <= F.size("ws") + 1).select("g", F.slice("ws", F.col("at"), F.col("many")).alias("ws"))
    own, caps = F.col("ws"), F.transform("ws", lambda w: F.initcap(w))
    number = F.pmod(F.xxhash64("ws"), F.lit(10000)).cast("string")
    styles = (
        F.array_join(own, ""), F.array_join(caps, ""), F.upper(F.array_join(own, "")), F.array_join(own, "_"), F.array_join(own, "-"), F.array_join(own, "/"), F.array_join(caps, "/"),
        F.concat(F.array_join(own, ""), number), F.concat(caps[0], F.substring(number, 1, 2), F.array_join(F.slice(caps, 2, 9), "")), F.concat(F.upper(own[0]), F.lit("_"), number, F.lit("_"), F.array_join(F.slice(caps, 2, 9), "_")),
    )
    return some.select(F.explode(F.array(*styles)).alias("run")).where(F.length("run") >= SHORTEST)


def fit(docs: DataFrame, text_col: str = "text") -> Null:
    """The law of names, from the words of all texts of ``docs``."""
    spark = docs.sparkSession
    split = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z0-9]+")
    own = docs.select(F.explode(split).alias("word")).where(F.col("word").rlike(f"^[a-z]{{2,{SHORTEST - 1}}}$"))
    some = own.groupBy("word").count().unionAll(spark.range(1).select(F.explode(F.split(F.lit(" ".join(WORDS)), " ")).alias("word"), F.lit(1).cast("bigint").alias("count")))
    words = common.stored(some.groupBy("word").agg(F.sum("count").alias("count")), "words")
    pairs = words.select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word", "count").groupBy(F.substring("word", F.col("i"), F.lit(2)).alias("pair")).agg(F.sum("count").alias("n"))
    counted = Pairs({r["pair"]: r["n"] for r in pairs.collect()})  # 676 rows at most
    top = words.orderBy(F.desc("count"), "word").limit(VOCABULARY)
    made = names(top).withColumn("code", encoding(F.col("run"))).where("code is not null")
    seen = made.select("code", length_class(F.length("run")).alias("class"), battery(F.col("run"), F.col("code"), counted).alias("s"))
    rows = seen.groupBy("code", "class").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q")).collect()
    common.discard(words)
    sums: dict[tuple[str | None, int | None], list[float]] = {}
    for r in rows:
        for key in ((r["code"], r["class"]), (None, r["class"]), (None, None)):
            old = sums.get(key, [0, 0.0, 0.0])
            sums[key] = [old[0] + r["n"], old[1] + r["s"], old[2] + r["q"]]
    return Null(counted, {k: (s / n, math.sqrt(max(0.25, q / n - (s / n) ** 2))) for k, (n, s, q) in sums.items() if n >= LEAST_NAMES or k == (None, None)})


def scanned(docs: DataFrame, text_col: str, null: Null, base: str = "base_spans", runs: str = "runs") -> DataFrame:
    """``docs`` with its base spans and its tested runs."""
    t, a, v, x, h, r = (common.free_name(docs, c) for c in ("scan_text", "scan_assign", "scan_value", "scan_access", "scan_hex", "scan_run"))
    none = F.array().cast("array<string>")
    text = F.col(t)
    low = F.lower(text)
    assigns = low.contains(ASSIGN_WORDS[0])
    for w in ASSIGN_WORDS[1:]:
        assigns = assigns | low.contains(w)
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({
        a: F.when(assigns, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))).otherwise(none),
        x: F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(none),
        h: F.when(text.rlike(HEX), F.regexp_extract_all(text, F.lit(HEX), F.lit(0))).otherwise(none),
        r: F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).otherwise(none),
    })
    df = df.withColumn(v, F.when(F.size(a) > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none))

    def spans(column: str, pattern: str, kind: str, keep: Column | None = None) -> Column:
        at = places(text, pattern, F.col(column))
        if keep is not None:
            at = F.transform(F.filter(F.arrays_zip(at.alias("p"), F.transform(keep, F.length).alias("n")), lambda s: s["n"] >= ASSIGN_VALUE), lambda s: s["p"])
        return F.transform(at, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))).cast(f"array<{SPAN}>")

    df = df.withColumns({base: F.concat(spans(a, ASSIGN, "assign", F.col(v)), spans(x, ACCESS, "access"), spans(h, HEX, "hex")), runs: F.arrays_zip(places(text, RUN, F.col(r)).alias("p"), F.col(r).alias("s"))})
    coded = F.filter(F.transform(F.col(runs), lambda s: F.struct(s["p"]["start"].alias("start"), s["p"]["stop"].alias("stop"), s["s"].alias("run"), encoding(s["s"]).alias("code"))), lambda s: s["code"].isNotNull())
    free = F.filter(coded, lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    df = df.withColumn(runs, free)

    def tested(s: Column) -> Column:
        size = length_class(F.length(s["run"]))
        score = battery(s["run"], s["code"], null.pairs)
        bucket = bound(score, lambda z: F.when(z < MOST_UNEVEN, F.least(F.lit(BUCKETS), F.floor(10 * null.minus_log_p(z, s["code"], size)).cast("int"))).otherwise(F.lit(0)))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), size.alias("class"), bucket.alias("bucket"), F.xxhash64(s["run"]).alias("key"))

    tested = F.transform(F.col(runs), tested)
    return df.withColumn(runs, tested).drop(t, a, v, x, h, r)


def thresholds(tests: DataFrame) -> dict[int, int]:
    """For each length class of ``tests`` (``class``, ``bucket``, ``key``) the least bucket that is a discovery; none, no entry.

    Benjamini-Hochberg on the bucketed p-values of the different runs, each
    counted once however often it occurs: the names expected at or
    beyond a bucket, as many as its largest p says of all runs, may be no more
    than ``FALSE_RATE`` of the runs found there.  The driver gets one row a
    class, 124 at most.
    """
    counts = tests.distinct().groupBy("class", "bucket").count().withColumn("beyond", F.expr("sum(count) OVER (PARTITION BY class ORDER BY bucket DESC)")).withColumn("total", F.expr("sum(count) OVER (PARTITION BY class)"))
    found = counts.where((F.col("bucket") > 0) & (F.exp(-F.col("bucket") / 10) * F.col("total") <= FALSE_RATE * F.col("beyond")))
    return {r["class"]: r["least"] for r in found.groupBy("class").agg(F.min("bucket").alias("least")).collect()}


def judged(df: DataFrame, limits: dict[int, int], base: str = "base_spans", runs: str = "runs", spans: str = "spans") -> DataFrame:
    """Puts ``spans``, base and random ones by start and kind, in the place of ``runs``."""

    def least(s: Column) -> Column:
        out = F.lit(BUCKETS + 1)
        for c, b in limits.items():
            out = F.when(s["class"] == c, F.lit(b)).otherwise(out)
        return out

    good = F.filter(F.col(runs), lambda s: s["bucket"] >= least(s))
    extra = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind_no"), F.lit("random").alias("kind"), s["stop"].alias("stop"))).cast(f"array<{SPAN}>")
    return df.withColumns({base: F.sort_array(base), spans: F.sort_array(F.concat(F.col(base), extra))}).drop(runs)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base_spans`` and all ``spans`` of each row."""
    null = fit(docs, text_col)
    own = common.stored(scanned(docs.select(F.col(id_col), F.col(text_col).alias("scan_source")), "scan_source", null).drop("scan_source"), "secrets")
    limits = thresholds(own.select(F.explode("runs").alias("r")).select("r.class", "r.bucket", "r.key"))
    return judged(own, limits)


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with each span of its texts, overlapping ones as one, turned into ``MASK``; rows and columns stay.

    ``count_col``, if ``docs`` has it, gets the length of a text that changed.
    Texts are scanned twice, once for the thresholds and once to be masked, so
    that no copy of them is stored.
    """
    base, runs, spans, source = (common.free_name(docs, c) for c in ("base_spans", "runs", "spans", "scan_source"))
    null = fit(docs, text_col)
    seen = scanned(docs.withColumn(source, F.col(text_col).cast("string")), source, null, base, runs)
    limits = thresholds(seen.select(F.explode(runs).alias("r")).select("r.class", "r.bucket", "r.key"))
    found = judged(seen, limits, base, runs, spans)
    kind = "array<struct<a:int,b:int>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("a"), s["start"].alias("b"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when((s["start"] >= acc["at"]), F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).cast(kind).alias("out"))

    gaps = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), F.length(source).alias("b")))).cast(kind))
    text = F.array_join(F.transform(gaps, lambda g: F.substring(F.col(source), g["a"] + 1, g["b"] - g["a"])), MASK)
    new = found.withColumn(text_col, F.when(F.size(spans) > 0, text).otherwise(F.col(text_col)))
    if count_col in docs.columns:
        new = new.withColumn(count_col, F.when(F.size(spans) > 0, F.length(text_col).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return new.select(*(F.col(f"`{c}`") for c in docs.columns))
