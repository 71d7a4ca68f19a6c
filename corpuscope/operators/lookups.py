"""Look-ups against the symbol catalog, for all names of a DataFrame at once.

``symbols`` is the table of the front end (``name``, ``kind``, ``owner``,
``flags`` …).  Each look-up takes rows with a ``name`` (and a ``member``, where
one is looked for) and adds a column or joins what is found.  Names fold ASCII
case; constants keep their own name's case, properties all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ascii_lower, constant_key
from . import catalog

CLASS_KINDS = ("class", "interface", "trait", "enum")
MEMBER_KINDS = ("method", "property", "class_constant", "enum_case")


def key(kind: str, c: Column) -> Column:
    if kind == "constant":
        return constant_key(c)
    return c if kind in ("property", "class_constant", "enum_case") else ascii_lower(c)


@dataclass
class Catalog:
    """The merged symbols of a project and the closure of its hierarchy (``descendant``, ``ancestor``, ``depth``)."""

    symbols: DataFrame
    pairs: DataFrame

    def of(self, *kinds: str) -> DataFrame:
        return self.symbols.where(F.col("kind").isin(*kinds)).withColumn("key", key(kinds[0], F.col("name")))

    # Whether there is such a symbol.

    def exists(self, rows: DataFrame, *kinds: str, into: str = "exists") -> DataFrame:
        """A column that says whether ``name`` is of one of ``kinds``."""
        there = self.of(*kinds).select("key").distinct().withColumn(into, F.lit(True))
        return rows.withColumn("key", key(kinds[0], F.ltrim(F.col("name"), F.lit("\\")))).join(there, "key", "left").withColumn(into, F.coalesce(into, F.lit(False))).drop("key")

    def class_like_exists(self, rows: DataFrame) -> DataFrame:
        return self.exists(rows, *CLASS_KINDS)

    def namespace_exists(self, rows: DataFrame) -> DataFrame:
        """Whether some symbol stands in the namespace ``name`` or below it."""
        cut = F.split(ascii_lower(F.col("name")), r"\\")
        spaces = self.of(*CLASS_KINDS, "function", "constant").where(F.size(cut) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda n: F.array_join(F.slice(cut, F.lit(1), n), "\\"))).alias("key")).distinct().withColumn("exists", F.lit(True))
        return rows.withColumn("key", ascii_lower(F.trim(F.col("name"), F.lit("\\")))).join(spaces, "key", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).drop("key")

    # The symbol.

    def get(self, rows: DataFrame, *kinds: str) -> DataFrame:
        """``rows`` with what is found of ``name``; those without it go."""
        return rows.select("name", key(kinds[0], F.ltrim(F.col("name"), F.lit("\\"))).alias("key")).join(self.of(*kinds).withColumnRenamed("name", "full_name"), "key").drop("key")

    def get_function(self, rows: DataFrame) -> DataFrame:
        """The function of the name, or else the global one of its last part."""
        f = self.of("function").select("key", F.col("name").alias("full_name"), "file_id", "start", "stop")
        asked = rows.select("name", ascii_lower(F.ltrim(F.col("name"), F.lit("\\"))).alias("own"), ascii_lower(F.element_at(F.split("name", r"\\"), -1)).alias("global"))
        both = asked.select("name", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("own").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("global").alias("key")))).alias("x")).select("name", "x.rank", "x.key")
        return both.join(f, "key").groupBy("name").agg(F.min(F.struct("rank", "full_name", "file_id", "start", "stop")).alias("x")).select("name", "x.full_name", "x.file_id", "x.start", "x.stop")

    # Members, with inheritance.

    def members(self, *kinds: str) -> DataFrame:
        """For each class the nearest declaration of each member: ``class``, ``member``, ``declared_by``, ``depth``, ``flags``."""
        own = self.symbols.where(F.col("kind").isin(*kinds) & F.col("owner").isNotNull()).select(ascii_lower(F.col("owner")).alias("owner"), key(kinds[0], F.col("name")).alias("member"), "flags")
        near = catalog.nearest_members(own.select("owner", "member").distinct(), self.pairs)
        flags = own.groupBy("owner", "member").agg(F.first("flags").alias("flags")).withColumnRenamed("owner", "declared_by")
        return near.join(flags, ["declared_by", "member"])

    def get_member(self, rows: DataFrame, *kinds: str) -> DataFrame:
        """``rows`` (``name``, ``member``) with the member's declaration; methods by default."""
        kinds = kinds or ("method",)
        asked = rows.select("name", "member", ascii_lower(F.ltrim(F.col("name"), F.lit("\\"))).alias("class"), key(kinds[0], F.col("member")).alias("m"))
        return asked.join(self.members(*kinds).withColumnRenamed("member", "m"), ["class", "m"]).select("name", "member", "declared_by", "depth", "flags")

    def member_exists(self, rows: DataFrame, *kinds: str) -> DataFrame:
        found = self.get_member(rows, *kinds).select("name", "member").distinct().withColumn("exists", F.lit(True))
        return rows.join(found, ["name", "member"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

    @staticmethod
    def is_abstract(flags: Column) -> Column:
        return F.array_contains(flags, "abstract")

    @staticmethod
    def is_final(flags: Column) -> Column:
        return F.array_contains(flags, "final")

    @staticmethod
    def visibility(flags: Column) -> Column:
        return F.when(F.array_contains(flags, "private"), "private").when(F.array_contains(flags, "protected"), "protected").otherwise("public")

    def overriding(self) -> DataFrame:
        """Methods that an ancestor declares too."""
        m = self.symbols.where("kind = 'method'").select(ascii_lower(F.col("owner")).alias("owner"), ascii_lower(F.col("name")).alias("member")).distinct()
        up = m.withColumnRenamed("owner", "ancestor").join(self.pairs.select("descendant", "ancestor"), "ancestor").select(F.col("descendant").alias("owner"), "member").distinct()
        return m.join(up, ["owner", "member"], "left_semi")

    # The hierarchy.

    def is_instance_of(self, rows: DataFrame) -> DataFrame:
        """Whether ``name`` is ``other`` or inherits from it."""
        up = self.pairs.select(F.col("descendant").alias("a"), F.col("ancestor").alias("b")).distinct().withColumn("found", F.lit(True))
        asked = rows.withColumns({"a": ascii_lower(F.col("name")), "b": ascii_lower(F.col("other"))})
        return asked.join(up, ["a", "b"], "left").withColumn("is_instance", F.coalesce("found", F.lit(False)) | (F.col("a") == F.col("b"))).drop("a", "b", "found")

    def ancestors(self, rows: DataFrame) -> DataFrame:
        return rows.select("name", ascii_lower(F.col("name")).alias("descendant")).join(self.pairs, "descendant").select("name", "ancestor", "depth")

    def descendants(self, rows: DataFrame) -> DataFrame:
        return rows.select("name", ascii_lower(F.col("name")).alias("ancestor")).join(self.pairs, "ancestor").select("name", "descendant", "depth")

    def inheritable(self) -> DataFrame:
        """Classes that others may extend."""
        return self.symbols.where("kind = 'class' AND NOT array_contains(flags, 'final')").select("name")


# Operations on the reference table (``file_id``, ``src``, ``src_member``, ``dst``, ``dst_member``, ``kind``, ``in_signature``).


def extend(refs: DataFrame, more: DataFrame) -> DataFrame:
    """The union as a set."""
    return refs.unionByName(more).distinct()


def without_files(refs: DataFrame, changed: DataFrame) -> DataFrame:
    return refs.join(changed.select("file_id").distinct(), "file_id", "left_anti")


def of_files(refs: DataFrame, kept: DataFrame) -> DataFrame:
    return refs.join(kept.select("file_id").distinct(), "file_id", "left_semi")


def without_invalid(refs: DataFrame, invalid: DataFrame) -> DataFrame:
    """References that start at symbols (``src``) which stand."""
    return refs.join(invalid.select("src").distinct(), "src", "left_anti")


def restored(refs: DataFrame, before: DataFrame, safe: DataFrame) -> DataFrame:
    """``refs`` with those that skipped symbols (``src``) had before."""
    return extend(refs, before.join(safe.select("src").distinct(), "src", "left_semi"))


def without_bodies(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Drops what the bodies of ``symbols`` (``src``) refer to; their signatures' references stay."""
    return refs.join(symbols.select("src").distinct().withColumn("in_signature", F.lit(False)), ["src", "in_signature"], "left_anti")


def to_symbol(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(ascii_lower(F.col("dst")) == name.lower())


def reads_and_writes(refs: DataFrame) -> DataFrame:
    """Reads, writes and referring symbols of each member."""
    return refs.groupBy("dst", "dst_member").agg(F.count_if(F.col("kind") == "read").alias("reads"), F.count_if(F.col("kind") == "write").alias("writes"), F.countDistinct("src", "src_member").alias("sources"))


def write_only(refs: DataFrame) -> DataFrame:
    return reads_and_writes(refs).where("writes > 0 AND reads = 0").select("dst", "dst_member")
