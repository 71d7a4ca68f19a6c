"""The registered queries and their SQL.

Each is an operator applied to whole tables; the SQL says the same for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import baseline, catalog, edits, guard, issues, lookups, metrics, references
from ..sources import files, sinks
from ..streaming import changes
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text rules over lines: the flagship.


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents),
found AS (SELECT 'trailing-space' AS code, 2 AS level FROM lines WHERE regexp_matches(content, '[ \\t]+$') UNION ALL SELECT 'long-line', 1 FROM lines WHERE length(content) > 120
 UNION ALL SELECT 'tab', 0 FROM lines WHERE contains(content, chr(9)) UNION ALL SELECT 'unfinished', 0 FROM lines WHERE regexp_matches(content, '(?i)\\b(todo|fixme)\\b'))
SELECT code, count(*) AS issues, CASE max(level) WHEN 0 THEN 'note' WHEN 1 THEN 'help' WHEN 2 THEN 'warning' ELSE 'error' END AS highest FROM found GROUP BY code""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("content"))
    rules = (("trailing-space", 2, F.col("content").rlike("[ \\t]+$")), ("long-line", 1, F.length("content") > 120), ("tab", 0, F.col("content").contains("\t")), ("unfinished", 0, F.col("content").rlike("(?i)\\b(todo|fixme)\\b")))
    hits = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, on in rules)))
    return issues.count_by_code(lines.select(F.explode(hits).alias("x")).select("x.*"))


# The issue table.

LEVEL = "CASE {} WHEN 0 THEN 'note' WHEN 1 THEN 'help' WHEN 2 THEN 'warning' ELSE 'error' END"


@query(f"WITH {b.ISSUES} SELECT {LEVEL.format('level')} AS level, count(*) AS issues FROM issues GROUP BY 1")
def count_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.count_by_level(b.issues(spark, sf_dir))


@query(f"WITH {b.ISSUES} SELECT coalesce(code, '<unknown>') AS code, count(*) AS issues, {LEVEL.format('max(level)')} AS highest FROM issues GROUP BY 1")
def count_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.count_by_code(b.issues(spark, sf_dir))


@query(f"WITH {b.ISSUES} SELECT level, code, file_id, start, stop, ordinal FROM issues ORDER BY level, code NULLS FIRST, start IS NULL, file_id, start, stop, ordinal LIMIT 100")
def issue_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.top(b.issues(spark, sf_dir), 100).select("level", "code", "file_id", "start", "stop", "ordinal")


@query(f"WITH {b.ISSUES} SELECT ordinal, code, level FROM issues WHERE level >= 1 AND level <= 2 AND code IN ('error', 'click')")
def level_and_code_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.with_codes(issues.at_most(issues.at_least(b.issues(spark, sf_dir), 1), 2), ["error", "click"]).select("ordinal", "code", "level")


@query(f"""WITH {b.ISSUES} SELECT ordinal, code, file FROM issues WHERE NOT (code = 'view' OR (code = 'click' AND (file = 'src/u1.x' OR starts_with(file, 'src/u2.x/') OR file = 'src/u2.x'))
 OR regexp_matches(message, 'k": 7') OR (code = 'error' AND regexp_matches(message, '[0-4]\\}}$')))""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    I = issues.Ignore
    entries = [I("view"), I("click", ("src/u1.x", "src/u2.x")), I(text='k": 7'), I("error", text="[0-4]\\}$"), I(text="(broken")]
    return issues.without_ignored(b.issues(spark, sf_dir), entries).select("ordinal", "code", "file")


# Baselines.

OLD, NEW = f"ts < TIMESTAMP '{b.SPLIT}'", f"ts >= TIMESTAMP '{b.SPLIT}'"
LOOSE = f"{b.ISSUES}, old AS (SELECT file, code, message, count(*) AS count FROM issues WHERE {OLD} GROUP BY ALL), now AS (SELECT file, code, message, count(*) AS count FROM issues WHERE {NEW} GROUP BY ALL)"
STRICT = f"{b.ISSUES}, old AS (SELECT DISTINCT file, code, start_line, stop_line FROM issues WHERE {OLD}), now AS (SELECT DISTINCT file, code, start_line, stop_line FROM issues WHERE {NEW})"


@query(f"WITH {LOOSE} SELECT * FROM old")
def loose_baseline_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.loose(b.old(b.issues(spark, sf_dir)))


@query(f"""WITH {LOOSE}, n AS (SELECT *, row_number() OVER (PARTITION BY file, code, message ORDER BY ordinal) AS n FROM issues WHERE {NEW})
SELECT n.ordinal, n.file, n.code, n.message FROM n LEFT JOIN old USING (file, code, message) WHERE n.n > coalesce(old.count, 0)""")
def loose_baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.loose_filter(b.new(i), baseline.loose(b.old(i))).select("ordinal", "file", "code", "message")


@query(f"""WITH {LOOSE} SELECT file, code, message, CASE WHEN coalesce(now.count, 0) > coalesce(old.count, 0) THEN 'new' ELSE 'removed' END AS state, abs(coalesce(now.count, 0) - coalesce(old.count, 0)) AS count
FROM now FULL OUTER JOIN old USING (file, code, message) WHERE coalesce(now.count, 0) <> coalesce(old.count, 0)""")
def loose_baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.loose_compare(b.new(i), baseline.loose(b.old(i)))


@query(f"WITH {LOOSE} SELECT file, code, message, least(old.count, now.count) AS count FROM old JOIN now USING (file, code, message)")
def loose_baseline_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.loose_prune(baseline.loose(b.old(i)), b.new(i))


@query(f"WITH {STRICT} SELECT * FROM old")
def strict_baseline_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.strict(b.old(b.issues(spark, sf_dir)))


@query(f"WITH {STRICT} SELECT ordinal, file, code, start_line, stop_line FROM issues i WHERE {NEW} AND NOT EXISTS (SELECT 1 FROM old o WHERE o.file = i.file AND o.code = i.code AND o.start_line = i.start_line AND o.stop_line = i.stop_line)")
def strict_baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.strict_filter(b.new(i), baseline.strict(b.old(i))).select("ordinal", "file", "code", "start_line", "stop_line")


@query(f"WITH {STRICT} SELECT *, 'new' AS state FROM (SELECT * FROM now EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM now)")
def strict_baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.strict_compare(b.new(i), baseline.strict(b.old(i)))


@query(f"WITH {STRICT} SELECT * FROM old INTERSECT SELECT * FROM now")
def strict_baseline_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    return baseline.strict_prune(baseline.strict(b.old(i)), b.new(i))


@query(f"WITH {STRICT} SELECT count(DISTINCT file) AS files FROM (SELECT * FROM (SELECT * FROM now EXCEPT SELECT * FROM old) UNION ALL SELECT * FROM (SELECT * FROM old EXCEPT SELECT * FROM now))")
def baseline_files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.files_changed(strict_baseline_compare(spark, sf_dir))


@query(f"WITH {LOOSE} SELECT code, file, CAST(sum(count) AS BIGINT) AS count, CAST(grouping_id(code, file) AS BIGINT) AS grouping FROM old GROUP BY ROLLUP (code, file)")
def inspect_baseline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.rollup(baseline.loose(b.old(b.issues(spark, sf_dir))))


RANKED = """WITH {loose}, parts AS (SELECT {g}, {m}, CAST(sum(count) AS BIGINT) AS count FROM old GROUP BY ALL), sums AS (SELECT {g}, CAST(sum(count) AS BIGINT) AS group_count FROM parts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}),
r AS (SELECT parts.*, group_count, CAST(row_number() OVER (PARTITION BY {g} ORDER BY count DESC, {m}) AS INTEGER) AS rank FROM parts JOIN sums USING ({g})) SELECT * FROM r WHERE rank <= {k}"""


@query(RANKED.format(loose=LOOSE, g="code", m="file", n=3, k=5))
def inspect_baseline_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.ranked(baseline.loose(b.old(b.issues(spark, sf_dir))), "code", "file", 3, 5)


@query(RANKED.format(loose=LOOSE, g="file", m="code", n=20, k=3))
def inspect_baseline_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.ranked(baseline.loose(b.old(b.issues(spark, sf_dir))), "file", "code", 20, 3)


# Reports.


def report(form: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sinks.FORMATS[form](b.issues(spark, sf_dir))

    run.__name__ = f"report_{form}"
    return run


PLACE = "(line + 1) || ':' || (col + 1)"
NAMED = LEVEL.format("level")
REPORTS = {
    "short": f"file || ':' || {PLACE} || ': ' || {NAMED} || '[' || code || ']: ' || message",
    "medium": f"{NAMED} || '[' || code || ']: ' || message || chr(10) || '  at ' || file || ':' || {PLACE}",
    "emacs": f"file || ':' || {PLACE} || ':' || {NAMED} || ' - ' || message",
    "github": "'::' || CASE level WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'notice' END || ' file=' || file || ',line=' || (line + 1) || ',col=' || (col + 1) || ',title=' || code || '::' || replace(message, '%', '%25')",
}
for form, sql in REPORTS.items():
    query(f"WITH {b.ISSUES} SELECT {sql} AS value FROM issues")(report(form))
query(f"WITH {b.ISSUES} SELECT {NAMED} || ': ' || count(*) AS value FROM issues GROUP BY level")(report("count"))
query(f"WITH {b.ISSUES} SELECT {LEVEL.format('max(level)')} || '[' || code || ']: ' || count(*) AS value FROM issues GROUP BY code")(report("code_count"))
ESCAPED = "replace(message, '\"', '&quot;')"
query(f"""WITH {b.ISSUES} SELECT '<file name="' || file || '">' || string_agg('<error line="' || (line + 1) || '" column="' || (col + 1) || '" severity="' || CASE level WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'info' END || '" message="' || {ESCAPED} || '" source="' || code || '"/>', '' ORDER BY line, col,
 '<error line="' || (line + 1) || '" column="' || (col + 1) || '" severity="' || CASE level WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'info' END || '" message="' || {ESCAPED} || '" source="' || code || '"/>') || '</file>' AS value FROM issues GROUP BY file""")(report("checkstyle"))
STRUCTS = {
    "json": f"{{'level': {NAMED}, 'code': code, 'message': message, 'file': file, 'line': line, 'column': col}}",
    "gitlab": (
        "{'description': message, 'check_name': code, 'fingerprint': md5(concat_ws('|', file, code, line + 1, message)), "
        "'severity': CASE level WHEN 2 THEN 'minor' WHEN 3 THEN 'major' ELSE 'info' END, 'location': {'path': file, 'lines': {'begin': line + 1}}}"
    ),
    "sarif": (
        "{'ruleId': code, 'level': CASE level WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'note' END, 'message': {'text': message}, "
        "'locations': [{'physicalLocation': {'artifactLocation': {'uri': file}, 'region': {'startLine': line + 1, 'startColumn': col + 1}}}]}"
    ),
}
for form, sql in STRUCTS.items():
    query(f"WITH {b.ISSUES} SELECT CAST(to_json({sql}) AS VARCHAR) AS value FROM issues")(report(form))


# Files.

LINES = """lines AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, content
 FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""


@query(f"WITH {LINES} SELECT doc_id, line, start, CAST(strlen(content) AS INTEGER) AS n_bytes FROM lines")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_table(b.table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", "start", F.octet_length("content").alias("n_bytes"))


@query(f"""WITH {LINES}, points AS (SELECT doc_id, CAST(k AS BIGINT) AS point, CAST(strlen(text) * k // 4 AS BIGINT) AS "offset" FROM documents, (VALUES (0), (1), (2), (3)) v(k))
SELECT p.doc_id, p.point, p."offset", max(l.line) AS line, any_value(p."offset") - max(l.start) AS "column" FROM points p JOIN lines l ON l.doc_id = p.doc_id AND l.start <= p."offset" GROUP BY p.doc_id, p.point, p."offset" """)
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    points = docs.select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"), F.octet_length("text").cast("bigint").alias("n")).select("doc_id", F.col("k").cast("bigint").alias("point"), F.expr("n * k DIV 4").alias("offset"))
    return files.line_of(files.line_table(docs, "doc_id", "text"), points, "doc_id")


TIER_RULES = [files.Tier("en", "host"), files.Tier("en/src1", "vendored"), files.Tier("de", "host"), files.Tier("de/src2", "patch"), files.Tier("de/**", "patch"), files.Tier("fr/src*/*", "vendored"), files.Tier("fr/src3/*", "patch"), files.Tier("fr", "host")]


@query(f"""WITH {b.FILES}, w AS (SELECT file_id, name,
 CASE WHEN starts_with(name, 'en/') OR starts_with(name, 'de/') OR starts_with(name, 'fr/') THEN 100 ELSE -1 END AS host,
 CASE WHEN starts_with(name, 'en/src1/') THEN 200 WHEN regexp_matches(name, '^fr/src[^/]*/[^/]*$') THEN 10 ELSE -1 END AS vendored,
 CASE WHEN starts_with(name, 'de/src2/') THEN 200 WHEN starts_with(name, 'de/') THEN 10 WHEN regexp_matches(name, '^fr/src3/[^/]*$') THEN 20 ELSE -1 END AS patch FROM files)
SELECT file_id, CASE WHEN patch >= 0 AND (host <= vendored OR patch > host) THEN 'patch' WHEN vendored >= 0 AND vendored >= host THEN 'vendored' WHEN host >= 0 THEN 'host' END AS tier FROM w""")
def tier_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_tier(b.files(spark, sf_dir), TIER_RULES).select("file_id", "tier")


@query(f"WITH {b.FILES} SELECT file_id, name FROM files WHERE (starts_with(name, 'en/') OR regexp_matches(name, '^de/src[0-4]/[^/]*$')) AND NOT (starts_with(name, 'en/src1/') OR regexp_matches(name, '^.*/[^/]*7\\.txt$'))")
def scan_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chosen(b.files(spark, sf_dir), ["en", "de/src[0-4]/*"], ["txt"], ["en/src1", "**/*7.txt"]).select("file_id", "name")


# The catalog.

SYMBOLS = "symbols AS (SELECT p_name AS name, p_partkey AS file_id, p_size % 2 = 0 AS is_own, p_size % 3 = 0 AS is_patch, p_size % 5 = 0 AS is_external, p_size % 7 = 0 AS is_builtin, p_size % 11 = 0 AS is_polyfill, p_size AS start, p_size + 3 AS stop, p_type AS \"constraint\" FROM part)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    return b.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("file_id"), *((p % n == 0).alias(f"is_{k}") for k, n in (("own", 2), ("patch", 3), ("external", 5), ("builtin", 7), ("polyfill", 11))), p.alias("start"), (p + 3).alias("stop"), F.col("p_type").alias("constraint"))


@query(f"""WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_own DESC, is_patch DESC, is_external DESC, is_builtin DESC, is_polyfill, file_id, start, stop) AS n FROM symbols),
c AS (SELECT name, string_agg(x, ',' ORDER BY x) AS constraints FROM (SELECT DISTINCT name, "constraint" AS x FROM symbols) GROUP BY name) SELECT r.name, r.file_id, r.start, c.constraints FROM r JOIN c USING (name) WHERE n = 1""")
def symbol_merge_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge(symbols(spark, sf_dir)).select("name", "file_id", "start", F.array_join("constraints", ",").alias("constraints"))


@query("SELECT s_suppkey, 'NATION_' || (s_suppkey % 40) AS name, n_name IS NULL AS orphan, coalesce(n_regionkey % 2 = 0, false) AS refused FROM supplier LEFT JOIN nation ON n_name = 'NATION_' || (s_suppkey % 40)")
def patch_left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = b.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), F.col("s_suppkey") % 40).alias("name"))
    targets = b.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("is_own"))
    return catalog.patched(patches, targets).select("s_suppkey", "name", "orphan", "refused")


@query(f"WITH RECURSIVE {b.CLASS_EDGES} SELECT descendant, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM pairs GROUP BY ALL")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.closure(b.class_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {b.CLASS_EDGES} SELECT ancestor, count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS total FROM pairs GROUP BY ancestor")
def descendant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.descendants(catalog.closure(b.class_edges(spark, sf_dir)))


MEMBERS = "members AS (SELECT 'n' || n_nationkey AS owner, 'm' || (n_nationkey % 3) AS member FROM nation UNION ALL SELECT 'r' || r_regionkey, 'm' || (r_regionkey % 2) FROM region UNION ALL SELECT 'root', m FROM (VALUES ('m0'), ('m9')) v(m) UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'm0' ELSE 'm5' END FROM customer)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("owner"), F.concat(F.lit("m"), F.col("n_nationkey") % 3).alias("member"))
    r = b.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("m"), F.col("r_regionkey") % 2))
    c = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "m0").otherwise("m5"))
    return n.unionAll(r).unionAll(spark.createDataFrame([("root", "m0"), ("root", "m9")], "owner string, member string")).unionAll(c)


@query(f"""WITH RECURSIVE {b.CLASS_EDGES}, {MEMBERS}, seen AS (SELECT owner AS class, member, owner AS declared_by, 0 AS depth FROM members UNION ALL SELECT descendant, member, owner, depth FROM members JOIN pairs ON owner = ancestor),
r AS (SELECT *, row_number() OVER (PARTITION BY class, member ORDER BY depth, declared_by) AS n FROM seen) SELECT class, member, declared_by, CAST(depth AS INTEGER) AS depth FROM r WHERE n = 1""")
def member_inheritance_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.nearest_members(members(spark, sf_dir), catalog.closure(b.class_edges(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS definitions FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def too_many_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.too_many(b.table(spark, sf_dir, "lineitem"), "l_orderkey", 5)


# References.


@query(f"WITH {b.REFS} SELECT dst, count(*) AS refs, count(DISTINCT src) AS sources FROM refs GROUP BY dst")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.counts(b.refs(spark, sf_dir))


@query(f"WITH {b.REFS} SELECT 'p' || p_partkey AS symbol FROM part WHERE 'p' || p_partkey NOT IN (SELECT dst FROM refs WHERE in_signature)")
def unused_defs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = b.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("symbol"))
    return references.unused(defs, b.refs(spark, sf_dir).where("in_signature"))


@query(f"WITH {b.REFS} SELECT src, dst, in_signature FROM refs WHERE dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 10) AND starts_with(dst, 'p')")
def undefined_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = b.table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("symbol"))
    return references.undefined(b.refs(spark, sf_dir).where(F.col("dst").startswith("p")), defs).select("src", "dst", "in_signature")


HALF = "1998-04-01"


@query(f"""WITH o AS (SELECT o_custkey AS symbol, CAST(sum(o_orderkey) AS BIGINT) AS hash, count(*) AS sig FROM orders WHERE o_orderdate < TIMESTAMP '{HALF}' GROUP BY 1), n AS (SELECT o_custkey AS symbol, CAST(sum(o_orderkey) AS BIGINT) AS hash, count(*) AS sig FROM orders WHERE o_orderdate >= TIMESTAMP '{HALF}' GROUP BY 1)
SELECT symbol, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.sig <> n.sig THEN 'signature' WHEN o.hash <> n.hash THEN 'body' ELSE 'keep' END AS state FROM o FULL OUTER JOIN n USING (symbol)""")
def signature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")

    def side(part: DataFrame) -> DataFrame:
        return part.groupBy(F.col("o_custkey").alias("symbol")).agg(F.sum("o_orderkey").alias("hash"), F.count("*").alias("signature_hash"))

    split = F.lit(HALF).cast("timestamp")
    return references.diff(side(o.where(F.col("o_orderdate") < split)), side(o.where(F.col("o_orderdate") >= split)))


@query(f"""WITH RECURSIVE {b.REFS}, reached AS (SELECT 'p' || p_partkey AS symbol FROM part WHERE p_size = 1 UNION SELECT r.src FROM reached x JOIN refs r ON r.dst = x.symbol AND r.in_signature)
SELECT symbol FROM reached UNION SELECT r.src FROM reached x JOIN refs r ON r.dst = x.symbol""")
def invalidation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = b.table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("symbol"))
    return references.cascade(changed, b.refs(spark, sf_dir), most=None)


DEAD = """d{next} AS (SELECT owner, member FROM can WHERE (owner, member) NOT IN
 (SELECT (owner, member) FROM used WHERE (src_owner, src_member) NOT IN (SELECT (owner, member) FROM d{last}) OR src_owner <> owner))"""
#: An order has at most seven line numbers, so no chain of references takes more steps.
STEPS = ", ".join(DEAD.format(next=n + 1, last=n) for n in range(8))


@query(f"""WITH li AS (SELECT DISTINCT 'c' || (l_partkey % 50) AS owner, l_orderkey || '_' || l_linenumber AS member, l_orderkey, l_linenumber FROM lineitem),
used AS (SELECT DISTINCT a.owner, a.member, b.owner AS src_owner, b.member AS src_member FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1),
can AS (SELECT DISTINCT owner, member FROM li WHERE length(member) % 2 = 0),
d0 AS (SELECT owner, member FROM can WHERE (owner, member) NOT IN (SELECT (owner, member) FROM used)), {STEPS} SELECT owner, member FROM d8""")
def unused_members_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as members of their part's class; each is referred to by the line that follows it in its order."""
    li = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_partkey") % 50).alias("owner"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("member"), "l_orderkey", "l_linenumber", "l_shipdate").dropDuplicates(["owner", "member"])
    back = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("owner").alias("src_owner"), F.col("member").alias("src_member"))
    refs = li.join(back, ["l_orderkey", "l_linenumber"]).select("owner", "member", "src_owner", "src_member")
    return references.unused_members(li.select("owner", "member", (F.length("member") % 2 == 0).alias("checkable")), refs)


# Look-ups.


@query(f"WITH RECURSIVE {b.CLASS_EDGES} SELECT descendant AS name, count(DISTINCT ancestor) AS place FROM pairs GROUP BY 1 UNION ALL SELECT DISTINCT ancestor, 0 FROM pairs WHERE ancestor NOT IN (SELECT descendant FROM pairs)")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.topological(catalog.closure(b.class_edges(spark, sf_dir)))


def symbol_rows(df: DataFrame, name: str, kind: str, owner: str = "CAST(NULL AS STRING)", file_id: str = "CAST(0 AS BIGINT)") -> DataFrame:
    """Rows as the front end's symbols, from SQL expressions."""
    return df.select(F.expr(name).alias("name"), F.expr(kind).alias("kind"), F.expr(owner).alias("owner"), F.array().cast("array<string>").alias("flags"), F.expr(file_id).alias("file_id"), F.lit(0).alias("start"), F.lit(0).alias("stop"))


@query("SELECT l_orderkey, l_linenumber, coalesce(p_size % 3 < 2, false) AS \"exists\" FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def lookup_class_like_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbol_rows(b.table(spark, sf_dir, "part"), "concat('Parts\\\\P', p_partkey)", "element_at(array('class', 'interface', 'function'), CAST(p_size % 3 + 1 AS INT))")
    asked = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("\\PARTS\\p"), "l_partkey").alias("name"))
    return lookups.Catalog(found, b.class_edges(spark, sf_dir).limit(0)).class_like_exists(asked).select("l_orderkey", "l_linenumber", "exists")


@query("SELECT c_custkey, c_custkey % 3 < 2 AS \"exists\" FROM customer")
def lookup_namespace_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer")
    asked = c.selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('SHOP\\\\', lower(c_mktsegment)) WHEN 1 THEN '\\\\Shop' ELSE concat('Shop\\\\', c_mktsegment, '\\\\C', c_custkey) END AS name")
    found = symbol_rows(c, "concat('Shop\\\\', c_mktsegment, '\\\\C', c_custkey)", "'class'")
    return lookups.Catalog(found, b.class_edges(spark, sf_dir).limit(0)).namespace_exists(asked).select("c_custkey", "exists")


@query("""WITH f AS (SELECT p_partkey, 'lib\\f' || p_partkey AS full_name, 0 AS rank FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'f' || p_partkey, 1 FROM part WHERE p_size % 3 = 0),
asked AS (SELECT DISTINCT l_partkey FROM lineitem) SELECT 'Lib\\F' || l_partkey AS name, arg_min(full_name, rank) AS full_name, l_partkey AS file_id FROM asked JOIN f ON p_partkey = l_partkey GROUP BY l_partkey""")
def lookup_function_or_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    found = symbol_rows(part.where("p_size % 2 = 0"), "concat('lib\\\\f', p_partkey)", "'function'", file_id="p_partkey").unionAll(symbol_rows(part.where("p_size % 3 = 0"), "concat('f', p_partkey)", "'function'", file_id="p_partkey"))
    asked = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Lib\\F"), "l_partkey").alias("name")).distinct()
    return lookups.Catalog(found, b.class_edges(spark, sf_dir).limit(0)).get_function(asked).select("name", "full_name", "file_id")


@query(f"""WITH RECURSIVE {b.CLASS_EDGES}, p AS (SELECT DISTINCT descendant, ancestor FROM pairs) SELECT c_custkey, ancestor IS NOT NULL AS is_instance FROM customer LEFT JOIN p ON descendant = 'c' || c_custkey AND ancestor = 'r' || (c_custkey % 5)""")
def lookup_is_instance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("name"), F.concat(F.lit("R"), F.col("c_custkey") % 5).alias("other"))
    pairs = catalog.closure(b.class_edges(spark, sf_dir))
    return lookups.Catalog(symbol_rows(asked, "name", "'class'"), pairs).is_instance_of(asked).select("c_custkey", "is_instance")


@query(f"""WITH RECURSIVE {b.CLASS_EDGES}, {MEMBERS} SELECT DISTINCT m.owner, m.member FROM members m JOIN pairs p ON p.descendant = m.owner JOIN members o ON o.owner = p.ancestor AND o.member = m.member""")
def lookup_overriding(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = symbol_rows(members(spark, sf_dir), "member", "'method'", "owner")
    return lookups.Catalog(methods, catalog.closure(b.class_edges(spark, sf_dir))).overriding()


@query(f"WITH {b.REFS} SELECT DISTINCT * FROM refs")
def refs_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.refs(spark, sf_dir)
    return lookups.extend(r.where("in_signature"), r)


@query(f"WITH {b.REFS} SELECT * FROM refs WHERE src NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def refs_without_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.without_invalid(b.refs(spark, sf_dir), b.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src")))


@query(f"WITH {b.REFS} SELECT * FROM refs WHERE in_signature OR src NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def refs_without_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.without_bodies(b.refs(spark, sf_dir), b.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))).select("src", "dst", "in_signature")


@query(f"WITH {b.REFS} SELECT * FROM refs WHERE in_signature UNION SELECT * FROM refs WHERE NOT in_signature AND src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def refs_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.refs(spark, sf_dir)
    safe = b.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    return lookups.restored(r.where("in_signature"), r.where("not in_signature"), safe)


USES = "uses AS (SELECT 's' || l_suppkey AS src, l_linestatus AS src_member, 'p' || l_partkey AS dst, 'm' || (l_linenumber % 3) AS dst_member, CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' ELSE 'call' END AS kind FROM lineitem)"


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").otherwise("call")
    return b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_linestatus").alias("src_member"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("dst_member"), kind.alias("kind"))


@query(f"WITH {USES} SELECT dst, dst_member, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind = 'write') AS writes, count(DISTINCT (src, src_member)) AS sources FROM uses GROUP BY dst, dst_member")
def member_reads_and_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.reads_and_writes(uses(spark, sf_dir))


@query(f"WITH {USES} SELECT dst, dst_member FROM uses GROUP BY dst, dst_member HAVING bool_or(kind = 'write') AND NOT bool_or(kind = 'read')")
def member_write_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.write_only(uses(spark, sf_dir))


# The guard.

EDGES = "edges AS (SELECT c_custkey, 'Shop\\Seg_' || c_mktsegment || '\\Order' AS source, 'Nation\\R' || n_regionkey || '\\N' || n_nationkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "nation")
    return b.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("Shop\\Seg_"), "c_mktsegment", F.lit("\\Order")).alias("source"), F.concat(F.lit("Nation\\R"), "n_regionkey", F.lit("\\N"), "n_nationkey").alias("target"))


PERIMETER = guard.Guard(
    rules=(guard.Rule("Shop", ("Nation\\R0\\**", "Nation\\R{1,2}")), guard.Rule("Shop\\Seg_BUILDING", ("@all",)), guard.Rule("Shop\\Seg_MACH*", ("@self",))),
    restrictions=(guard.Restriction("Nation\\R4", allow_from=("Shop\\Seg_AUTO*",)), guard.Restriction("Nation\\R1\\N1", deny_from=("Shop\\Seg_HOUSE*",))),
)


@query(f"""WITH {EDGES}, v AS (SELECT c_custkey, CASE WHEN (regexp_matches(target, '^Nation\\\\R4\\\\') AND NOT regexp_matches(source, '^Shop\\\\Seg_AUTO')) OR (target = 'Nation\\R1\\N1' AND regexp_matches(source, '^Shop\\\\Seg_HOUSE')) THEN 'restricted'
 WHEN regexp_matches(source, '^Shop\\\\Seg_MACH') THEN 'forbidden_by_rule' WHEN regexp_matches(source, '^Shop\\\\Seg_BUILDING\\\\') THEN NULL WHEN regexp_matches(target, '^Nation\\\\R[012]\\\\') THEN NULL ELSE 'forbidden_by_rule' END AS reason FROM edges) SELECT * FROM v WHERE reason IS NOT NULL""")
def guard_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.perimeter(edges(spark, sf_dir), PERIMETER).select("c_custkey", "reason")


@query("""WITH v AS (SELECT c_custkey, n_regionkey AS a, CAST(c_custkey % 6 AS INTEGER) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN a < 4 AND b < 4 THEN 'layering' ELSE 'no_matching_rule' END AS reason FROM v WHERE NOT (a < 4 AND b < 4 AND a >= b)""")
def guard_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "nation")
    both = b.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("L\\R"), "n_regionkey", F.lit("\\X")).alias("source"), F.concat(F.lit("L\\R"), F.col("c_custkey") % 6, F.lit("\\Y")).alias("target"))
    return guard.perimeter(both, guard.Guard(layers=tuple((f"r{i}", f"L\\R{i}") for i in range(4)))).select("c_custkey", "reason")


@query("""WITH s AS (SELECT p_partkey, 'Parts\\' || p_type || '\\' || p_name AS name, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'enum' END AS kind, p_size % 2 = 0 AS is_final, p_size % 5 = 0 AS is_readonly, p_brand FROM part)
SELECT name, kind, 0 AS rule, 'must_be_final' AS flaw FROM s WHERE kind = 'class' AND NOT is_final UNION ALL SELECT name, kind, 0, 'must_extend' FROM s WHERE kind = 'class' AND NOT regexp_matches(p_brand, '^Brand#1')
UNION ALL SELECT name, kind, 1, 'must_be' FROM s WHERE starts_with(name, 'Parts\\SMALL\\') AND kind = 'interface' UNION ALL SELECT name, kind, 1, 'must_not_be_readonly' FROM s WHERE starts_with(name, 'Parts\\SMALL\\') AND is_readonly
UNION ALL SELECT name, kind, 1, 'must_be_named' FROM s WHERE starts_with(name, 'Parts\\SMALL\\') AND NOT regexp_matches(name, ' (ring|bolt)$')""")
def guard_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    syms = b.table(spark, sf_dir, "part").select(F.concat(F.lit("Parts\\"), "p_type", F.lit("\\"), "p_name").alias("name"), F.element_at(F.array(*map(F.lit, ("class", "interface", "enum"))), p % 3 + 1).alias("kind"), (p % 2 == 0).alias("is_final"), F.lit(False).alias("is_abstract"), (p % 5 == 0).alias("is_readonly"), F.array("p_brand").alias("extends"))
    shapes = [guard.Shape("Parts\\**", kinds=("class",), must_be_final=True, must_extend=(("Brand#1*",),)), guard.Shape("Parts\\SMALL\\*", must_be=("class", "enum"), must_be_readonly=False, must_be_named="{* ring,* bolt}")]
    return guard.structural(syms, shapes)


@query("""SELECT page_id, regexp_matches(path, '(?i)^[^/]*example\\.com(/.*)?$') AS com, regexp_matches(path, '(?i)^[^/]+(/[^/]+)*/de/[^/]*$') AS german, regexp_matches(path, '(?i)^(?:blog\\.[^/]*|m\\.[^/]*)/(?:en|fr)/[^/]*$') AS some FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)""")
def namespace_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return b.table(spark, sf_dir, "pages").select("page_id", path.rlike(names.namespace_regex("*example.com", "/", prefix=True)).alias("com"), path.rlike(names.namespace_regex("*/**/de/*", "/")).alias("german"), path.rlike(names.namespace_regex("{blog.*,m.*}/{en,fr}/*", "/")).alias("some"))


# Spans and edits.


@query(f"WITH {b.ISSUES} SELECT ordinal, coalesce(max(stop) OVER (PARTITION BY file_id ORDER BY start, stop, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) AS overlaps FROM issues")
def edit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.overlapping(b.issues(spark, sf_dir).withColumn("issue", F.col("ordinal"))).select("ordinal", "overlaps")


@query(f"""WITH {b.ISSUES}, scopes AS (SELECT file_id, start, start + 60 AS stop FROM issues WHERE code = 'signup')
SELECT i.ordinal, count(s.file_id) AS scopes FROM issues i LEFT JOIN scopes s ON s.file_id = i.file_id AND s.start <= i.start AND i.start < s.stop WHERE i.code = 'error' GROUP BY 1""")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = b.issues(spark, sf_dir)
    scopes = i.where("code = 'signup'").select("file_id", "start", (F.col("start") + 60).alias("stop"))
    return metrics.enclosing(i.where("code = 'error'").select("file_id", F.col("ordinal").alias("point"), F.col("start").alias("at")), scopes).select(F.col("point").alias("ordinal"), "scopes")


# Functions.

WORDS = "list_filter(string_split(translate(regexp_replace(regexp_replace(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_'), lambda w: w <> '')"


@query(f"""WITH n AS (SELECT DISTINCT x FROM (SELECT p_name AS x FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT 'parse' || replace(initcap_ish, ' ', '') || 'HTTPCode' FROM (SELECT upper(p_type) AS initcap_ish FROM part))),
w AS (SELECT x, {WORDS.format(c='x')} AS w FROM n), t AS (SELECT x, array_to_string(w, '_') AS snake, array_to_string(w, '-') AS kebab, array_to_string(list_transform(w, lambda y: upper(y[1:1]) || y[2:]), '') AS pascal FROM w)
SELECT x AS name, snake, kebab, upper(snake) AS constant, pascal, lower(pascal[1:1]) || pascal[2:] AS camel, x = snake AS is_snake, x = pascal AS is_pascal FROM t""")
def casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = b.table(spark, sf_dir, "part")
    x = part.select(F.col("p_name").alias("name")).unionAll(part.select("p_brand")).unionAll(b.table(spark, sf_dir, "customer").select("c_name")).unionAll(part.select(F.concat(F.lit("parse"), F.replace(F.upper("p_type"), F.lit(" "), F.lit("")), F.lit("HTTPCode")))).distinct()
    n = F.col("name")
    return x.select("name", names.to_snake(n).alias("snake"), names.to_kebab(n).alias("kebab"), names.to_constant(n).alias("constant"), names.to_pascal(n).alias("pascal"), names.to_camel(n).alias("camel"), names.is_snake(n).alias("is_snake"), names.is_pascal(n).alias("is_pascal"))


@query("""SELECT md5(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+', ' ', 'g')) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def structural_fingerprint_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.md5(F.regexp_replace(names.ascii_lower(F.col("text")), "[ \\t\\n\\r]+", " "))
    return b.table(spark, sf_dir, "documents").groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# Metrics.


@query("""WITH m AS (SELECT l_orderkey AS owner, count(*) AS n, count(DISTINCT l_returnflag || l_linestatus) AS n1, count(DISTINCT l_suppkey % 5) AS n2 FROM lineitem GROUP BY 1),
v AS (SELECT owner, n, n1, n2, (n + n) * log2(n1 + n2) AS v, (n1 / 2) * (n / n2) AS d FROM m) SELECT owner, n1, n2, round(v, 2) AS volume, round(d, 2) AS difficulty, round(v * d, 2) AS effort FROM v""")
def halstead(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat("l_returnflag", "l_linestatus").alias("operator"), (F.col("l_suppkey") % 5).alias("operand"))
    return metrics.halstead(li).select("owner", "n1", "n2", "volume", "difficulty", "effort")


TAGS = "tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS kind FROM pages)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("owner"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("kind"))


@query(f"WITH {TAGS} SELECT kind, count(*) AS nodes, count(DISTINCT page_id) AS files FROM tags GROUP BY kind")
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("nodes"), F.countDistinct("owner").alias("files"))


@query(f"WITH {TAGS} SELECT page_id AS owner, CAST(sum(CASE kind WHEN 'p' THEN 1 WHEN 'b' THEN 2 WHEN 'li' THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM tags GROUP BY 1 HAVING sum(CASE kind WHEN 'p' THEN 1 WHEN 'b' THEN 2 WHEN 'li' THEN 1 ELSE 0 END) > 15")
def weighted_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted(tags(spark, sf_dir), {"p": 1, "b": 2, "li": 1}, 15)


# Change feeds.

OP = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    return b.table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("file_id"), op.alias("op"), F.col("props").alias("payload"))


@query(f"SELECT user_id AS file_id, max(ts) AS ts, arg_max({OP}, ts) AS op, arg_max(props, ts) AS payload FROM events GROUP BY 1")
def latest_change_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(feed(spark, sf_dir))


@query(f"""WITH l AS (SELECT user_id AS file_id, arg_max({OP}, ts) AS op, arg_max(props, ts) AS payload FROM events GROUP BY 1)
SELECT c_custkey AS file_id, c_name AS payload FROM customer WHERE c_custkey NOT IN (SELECT file_id FROM l) UNION ALL SELECT file_id, payload FROM l WHERE op <> 'delete'""")
def change_log_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("payload"))
    return changes.applied(state, feed(spark, sf_dir))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s)
SELECT user_id, min(ts) AS "first", max(ts) AS "last", count(*) AS changes FROM g GROUP BY user_id, n""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sessions(b.table(spark, sf_dir, "events"), "6 hours", "user_id")
