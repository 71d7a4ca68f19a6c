"""Whole-project checks: joins of the symbol, reference and hierarchy tables.

Every check is an anti join, a semi join or a group over tables that the front
end gives; none needs the sources again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ascii_lower
from ..frontend import tables
from ..operators import catalog

ERROR, WARNING, HELP = 3, 2, 1
CLASS_KINDS = ("class", "interface", "trait", "enum")


def issue(df: DataFrame, code: str, level: int, message: Column) -> DataFrame:
    return df.select("file_id", F.lit(code).alias("code"), F.lit(level).alias("level"), message.alias("message"), "start", "stop")


class Project:
    """The tables of a project, each parsed once and stored."""

    def __init__(self, files: DataFrame, known: DataFrame | None = None):
        """``known``: symbols (``name``, ``kind``) that stand outside of the files, as built-in ones do."""
        from ..operators.iterate import stored

        self.symbols = stored(tables.symbol_table(files))
        self.refs = stored(tables.reference_table(files))
        self.known = known
        self.closed: DataFrame | None = None
        self.edges = tables.class_edges(self.symbols).select(ascii_lower(F.col("child")).alias("child"), ascii_lower(F.col("parent")).alias("parent"), "edge_kind").distinct()

    def pairs(self) -> DataFrame:
        """Descendants and ancestors, made once."""
        if self.closed is None:
            self.closed = catalog.closure(self.edges.select("child", "parent"))
        return self.closed

    def classes(self) -> DataFrame:
        return self.symbols.where(F.col("kind").isin(*CLASS_KINDS)).withColumn("key", ascii_lower(F.col("name")))

    def names(self, *kinds: str) -> DataFrame:
        own = self.symbols.where(F.col("kind").isin(*kinds)).select(ascii_lower(F.col("name")).alias("key"))
        if self.known is not None:
            own = own.unionAll(self.known.where(F.col("kind").isin(*kinds)).select(ascii_lower(F.col("name"))))
        return own.distinct()

    def missing(self, vectors: tuple[str, ...], kinds: tuple[str, ...], code: str, what: str) -> DataFrame:
        used = self.refs.where(F.col("vector").isin(*vectors)).withColumn("key", ascii_lower(F.col("target")))
        return issue(used.join(self.names(*kinds), "key", "left_anti"), code, ERROR, F.concat(F.lit(f"No {what} "), "target", F.lit(".")))

    def non_existent_class_like(self) -> DataFrame:
        return self.missing(("instantiation", "extends", "implements", "trait_use", "static_call", "static_property", "class_constant", "parameter_type", "property_type", "return_type", "catch"), CLASS_KINDS, "non-existent-class-like", "class")

    def non_existent_function(self) -> DataFrame:
        """A function of the namespace, or else the global one of the same name."""
        used = self.refs.where("vector = 'function_call'").withColumns({"key": ascii_lower(F.col("target")), "global_key": ascii_lower(F.element_at(F.split("target", r"\\"), -1))})
        there = self.names("function")
        left = used.join(there, "key", "left_anti").join(there.withColumnRenamed("key", "global_key"), "global_key", "left_anti")
        return issue(left, "non-existent-function", ERROR, F.concat(F.lit("No function "), "target", F.lit(".")))

    def duplicate_definitions(self) -> DataFrame:
        """All definitions of a name but the first by file and place."""
        own = self.symbols.where(F.col("kind").isin(*CLASS_KINDS, "function")).withColumns({"key": ascii_lower(F.col("name")), "group": F.when(F.col("kind") == "function", "f").otherwise("c")})
        first = own.groupBy("key", "group").agg(F.min(F.struct("file_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        return issue(own.join(first, ["key", "group"]).where("struct(file_id, start) != first"), "duplicate-definition", ERROR, F.concat("name", F.lit(" is defined already.")))

    def kind_of_parents(self) -> DataFrame:
        """Extending, implementing and using what is of another kind."""
        c = self.classes()
        pairs = c.select("file_id", "name", F.col("kind").alias("own"), "start", "stop", F.explode(F.array(*(F.struct(F.lit(k).alias("how"), F.col(k).alias("ps")) for k in ("extends", "implements", "uses")))).alias("x")).select("file_id", "name", "own", "start", "stop", "x.how", F.explode("x.ps").alias("parent")).withColumn("key", ascii_lower(F.col("parent")))
        joined = pairs.join(c.select("key", F.col("kind").alias("other"), F.array_contains("flags", "final").alias("is_final")), "key")
        wanted = F.when(F.col("how") == "uses", "trait").when((F.col("how") == "implements") | (F.col("own") == "interface"), "interface").otherwise("class")
        bad = joined.where(wanted != F.col("other"))
        final = joined.where("how = 'extends' and is_final")
        return issue(bad, "invalid-parent-kind", ERROR, F.concat("parent", F.lit(" is of kind "), "other", F.lit("."))).unionAll(issue(final, "extend-final-class", ERROR, F.concat("parent", F.lit(" is final."))))

    def abstract_instantiation(self) -> DataFrame:
        made = self.refs.where("vector = 'instantiation'").withColumn("key", ascii_lower(F.col("target")))
        no = self.classes().where("kind != 'class' or array_contains(flags, 'abstract')").select("key").distinct()
        return issue(made.join(no, "key", "left_semi"), "abstract-instantiation", ERROR, F.concat("target", F.lit(" cannot be made.")))

    def unimplemented_methods(self) -> DataFrame:
        """Abstract methods that a class which is not abstract gets and neither it nor a nearer ancestor implements."""
        pairs = self.pairs()
        c = self.classes()
        m = self.symbols.where("kind = 'method'").withColumns({"owner": ascii_lower(F.col("owner")), "member": ascii_lower(F.col("name"))}).join(c.select(F.col("key").alias("owner"), F.col("kind").alias("owner_kind")).distinct(), "owner")
        is_abstract = (F.col("owner_kind") == "interface") | F.array_contains("flags", "abstract")
        members = m.select("owner", "member", is_abstract.alias("is_abstract"))
        got = members.join(pairs, members["owner"] == pairs["ancestor"]).select(F.col("descendant").alias("key"), "member", "is_abstract").unionAll(members.select(F.col("owner").alias("key"), "member", "is_abstract"))
        left = got.groupBy("key", "member").agg(F.min(F.col("is_abstract").cast("int")).alias("all_abstract")).where("all_abstract = 1")
        solid = c.where("kind in ('class', 'enum') and not array_contains(flags, 'abstract')")
        return issue(solid.join(left, "key"), "unimplemented-abstract-method", ERROR, F.concat("name", F.lit(" lacks "), "member", F.lit(".")))

    def circular_inheritance(self) -> DataFrame:
        """Classes that reach themselves: an edge whose parent has the child among its ancestors."""
        pairs = self.pairs()
        loops = self.edges.join(pairs, (F.col("parent") == F.col("descendant")) & (F.col("child") == F.col("ancestor")), "left_semi").select(F.col("child").alias("key")).unionAll(self.edges.where("child = parent").select("child")).distinct()
        return issue(self.classes().join(loops, "key", "left_semi"), "circular-inheritance", ERROR, F.concat("name", F.lit(" is its own ancestor.")))

    def all(self) -> DataFrame:
        parts = [self.non_existent_class_like(), self.non_existent_function(), self.duplicate_definitions(), self.kind_of_parents(), self.abstract_instantiation(), self.unimplemented_methods(), self.circular_inheritance()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
