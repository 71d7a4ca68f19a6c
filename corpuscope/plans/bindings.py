"""The engine's tables, bound by shape to the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From here on events count as the present, before as recorded.
SPLIT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("value").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".x")).alias("file"), F.col("event_type").alias("code"), (n % 4).alias("level"), F.col("props").alias("message"),
        (n % 50).alias("start_line"), (n % 50 + 1).alias("stop_line"), (n % 50).alias("line"), (n % 7).alias("column"), (F.col("event_id") * 7 % 1000).cast("int").alias("start"), (F.col("event_id") * 7 % 1000 + n % 20).cast("int").alias("stop"), F.col("event_id").alias("ordinal"), "ts",
    )


#: The same as SQL, to stand in a WITH clause.
ISSUES = """issues AS (SELECT user_id AS file_id, 'src/u' || user_id || '.x' AS file, event_type AS code, CAST(floor(value) AS INTEGER) % 4 AS level, props AS message,
 CAST(floor(value) AS INTEGER) % 50 AS start_line, CAST(floor(value) AS INTEGER) % 50 + 1 AS stop_line, CAST(floor(value) AS INTEGER) % 50 AS line, CAST(floor(value) AS INTEGER) % 7 AS col,
 CAST(event_id * 7 % 1000 AS INTEGER) AS start, CAST(event_id * 7 % 1000 + CAST(floor(value) AS INTEGER) % 20 AS INTEGER) AS stop, event_id AS ordinal, ts FROM events)"""


def old(df: DataFrame) -> DataFrame:
    return df.where(F.col("ts") < F.lit(SPLIT).cast("timestamp"))


def new(df: DataFrame) -> DataFrame:
    return df.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"), "text")


FILES = "files AS (SELECT doc_id AS file_id, lang || '/' || source || '/' || doc_id || '.txt' AS name, text FROM documents)"


def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))

    def pair(df: DataFrame, a: str, x: str, b: str, y: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(x)).alias("child"), F.concat(F.lit(b), F.col(y)).alias("parent"))

    return pair(c, "c", "c_custkey", "n", "c_nationkey").unionAll(pair(s, "s", "s_suppkey", "n", "s_nationkey")).unionAll(pair(n, "n", "n_nationkey", "r", "n_regionkey")).unionAll(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))


CLASS_EDGES = """class_edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
pairs AS (SELECT child AS descendant, parent AS ancestor, 1 AS depth FROM class_edges UNION ALL SELECT p.descendant, e.parent, p.depth + 1 FROM pairs p JOIN class_edges e ON p.ancestor = e.child)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to suppliers and suppliers to parts; some of it in signatures."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("in_signature"))
    return a.unionAll(li.select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_discount") == 0.05))


REFS = "refs AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag = 'R' AS in_signature FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey, l_discount = 0.05 FROM lineitem)"
