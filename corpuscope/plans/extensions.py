"""Extension points: rules, hooks, filters, providers and reducers of one's own.

A plugin is registered once on the driver; what it brings is looked up by name
and runs where the data is: node hooks on the node table, file hooks within the
Arrow batch that parses a file, reducers as partial states that are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frontend.lint import RULES, Rule
from ..frontend.syntax import Node, parse

NodeHook = Callable[[DataFrame], DataFrame]
FileHook = Callable[[Node, bytes], Iterable[tuple[str, int, str, int, int]]]
IssueFilter = Callable[[DataFrame], DataFrame]
Provider = Callable[[list[list[str]]], list[str]]


class Reducer(Protocol):
    """Collects over files and merges what it has; ``merge`` does not depend on order."""

    def start(self) -> Any: ...
    def collect(self, state: Any, root: Node) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> Iterable[tuple[str, int, str]]: ...


@dataclass
class Registry:
    """What plugins have brought."""

    node_hooks: dict[str, tuple[tuple[str, ...], NodeHook]] = field(default_factory=dict)
    file_hooks: dict[str, FileHook] = field(default_factory=dict)
    filters: dict[str, IssueFilter] = field(default_factory=dict)
    providers: dict[str, dict[str, Provider]] = field(default_factory=dict)
    reducers: dict[str, Reducer] = field(default_factory=dict)

    def on_nodes(self, name: str, *kinds: str) -> Callable[[NodeHook], NodeHook]:
        def add(f: NodeHook) -> NodeHook:
            self.node_hooks[name] = kinds, f
            return f

        return add

    def rule(self, rule: Rule) -> None:
        RULES[rule.code] = rule

    def provide(self, what: str, target: str, f: Provider) -> None:
        """A function of a call's argument types, by target: return types, assertions, thrown types."""
        self.providers.setdefault(what, {})[target.lower()] = f

    # How it runs.

    def run_node_hooks(self, nodes: DataFrame) -> DataFrame | None:
        """All hooks' issues; each hook sees the nodes of its kinds."""
        out = None
        for kinds, f in self.node_hooks.values():
            found = f(nodes.where(F.col("kind").isin(*kinds))).select("file_id", "code", "level", "message", "start", "stop")
            out = found if out is None else out.unionByName(found)
        return out

    def run_file_hooks(self, files: DataFrame) -> DataFrame:
        hooks = list(self.file_hooks.values())

        def run(batches):
            for batch in batches:
                out = []
                for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    root, _ = parse(c or b"")
                    out += [(i, *issue) for f in hooks for issue in f(root, c or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["file_id", "code", "level", "message", "start", "stop"])

        return files.select(F.col("file_id").cast("bigint"), F.col("contents").cast("binary")).mapInArrow(run, "file_id bigint, code string, level int, message string, start int, stop int")

    def filtered(self, issues: DataFrame) -> DataFrame:
        for f in self.filters.values():
            issues = f(issues)
        return issues

    def provided(self, calls: DataFrame, what: str) -> DataFrame:
        """``calls`` (``target``, ``arguments``: a type each) with ``provided``; null where nobody knows."""
        found = dict(self.providers.get(what, {}))

        def answer(target: pd.Series, arguments: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(target), dtype="object")
            low = target.str.lower()
            for name, f in found.items():
                at = low.index[low == name]
                if len(at):
                    out.loc[at] = f([list(x) for x in arguments.loc[at]])
            return out

        return calls.withColumn("provided", F.pandas_udf(answer, "string")("target", "arguments"))

    def reduced(self, files: DataFrame, name: str, width: int = 64) -> DataFrame:
        """A reducer's rows (``code``, ``level``, ``message``).

        Each batch gives one state; states are merged ``width`` at a time until
        one is left, so no task holds more than ``width`` of them.
        """
        r = self.reducers[name]

        def partial(batches):
            for batch in batches:
                state = r.start()
                for c in batch.column(0).to_pylist():
                    state = r.collect(state, parse(c or b"")[0])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            state = r.start()
            for s in part["state"]:
                state = r.merge(state, pickle.loads(s))
            return pd.DataFrame({"state": [pickle.dumps(state)]})

        from ..operators.iterate import stored

        now = stored(files.select(F.col("contents").cast("binary")).mapInArrow(partial, "state binary"))
        while (n := now.count()) > 1:
            groups = -(-n // width)
            now = stored(now.withColumn("g", F.pmod(F.xxhash64("state", F.monotonically_increasing_id()), F.lit(groups))).groupBy("g").applyInPandas(merge, "state binary"))
        last = now.first()
        rows = list(r.finish(pickle.loads(last["state"]) if last else r.start()))
        return files.sparkSession.createDataFrame(rows, "code string, level int, message string")
