"""Planning and running of flows: one lazy DataFrame graph, one action for each sink."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from ..errors import FlowError
from ..functions import Expressions
from ..sources import Tables
from ..types import literal, parameter_type
from .flow import Flow, Node, Package

log = logging.getLogger(__name__)


@dataclass
class Split:
    """What a conditional split reads, and the number of the port of each row."""

    df: DataFrame
    route: Column


@dataclass
class Branch:
    """A port of a split, and the columns that were added to it since, step by step."""

    split: Split
    port: int
    added: list[dict[str, Column]] = field(default_factory=list)


@dataclass
class Rel:
    """A data set on its way, the order that a sink directly after a sort applies, and the split that it is a branch of."""

    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=list)
    branch: Branch | None = None


@dataclass
class Context:
    spark: SparkSession
    tables: Tables
    compat: str = "reference"
    variables: dict[tuple[str, str], tuple[Column, T.DataType]] = field(default_factory=dict)
    values: dict[tuple[str, str], str | None] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    observed: dict[str, Observation] = field(default_factory=dict)
    package: str = ""
    strict: bool = False

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)
            log.warning(text)

    def expressions(self, df: DataFrame) -> Expressions:
        return Expressions(df.schema, self.variables, self.compat, self.warn)


@dataclass
class Sink:
    node: Node
    rel: Rel


@dataclass
class Result:
    """Lazy data sets by "node.port", sinks by node name, warnings, and row counts after the sinks have run."""

    ports: dict[str, Rel]
    sinks: dict[str, Sink]
    context: Context
    last: str = ""

    def df(self, name: str) -> DataFrame:
        """What arrives at a sink (sorted as the sink would), or what a port holds."""
        if name in self.sinks:
            rel = self.sinks[name].rel
            return rel.df.orderBy(*[_sorted(rel.df, c, up) for c, up in rel.order]) if rel.order else rel.df
        return self.ports[name if "." in name else f"{name}.out"].df

    def preview(self) -> DataFrame:
        """Of a flow without a destination: what the last node without a reader holds."""
        return self.ports[self.last].df

    def count(self, name: str) -> int:
        """A row count's variable: rows seen by the first action that ran through it."""
        return int(self.context.observed[name].get["rows"])


def _sorted(df: DataFrame, column: str, up: bool) -> Column:
    c = df["`" + column.replace("`", "``") + "`"]
    return c.asc_nulls_first() if up else c.desc_nulls_last()


Operator = Callable[[Context, Node, list[tuple[str, Rel]]], dict[str, Rel]]
OPERATORS: dict[str, Operator] = {}


def operator(*kinds: str) -> Callable[[Operator], Operator]:
    """Register an operator for node kinds; also the extension point for users."""

    def add(f: Operator) -> Operator:
        OPERATORS.update(dict.fromkeys(kinds, f))
        return f

    return add


def context(spark: SparkSession, tables: Tables, package: Package | None = None, compat: str = "reference", **more: Any) -> Context:
    out = Context(spark, tables, compat, **more)
    for key, (text, code) in (package.variables if package else {}).items():
        t = parameter_type(code)
        out.values[key] = text
        out.variables[key] = (literal(text, t, key in package.sensitive), t)
    out.package = package.name if package else out.package
    return out


def plan(flow: Flow, ctx: Context) -> Result:
    """Build every node once.  A node that fails or lacks an input is left out with a warning, unless ``ctx.strict``."""
    from .. import operators  # noqa: F401  registers the operators

    ports: dict[str, Rel] = {}
    sinks: dict[str, Sink] = {}
    for node in flow.order():
        missing = [x for _, x in node.inputs if x not in ports]
        if missing:
            ctx.warn(f"{node.name}: not fully connected ({', '.join(missing)}); skipped")
            continue
        ins = [(name, ports[x]) for name, x in node.inputs]
        try:
            build = OPERATORS.get(node.kind)
            if build is None:
                raise FlowError(f"no operator for kind {node.kind!r}")
            made = build(ctx, node, ins)
        except Exception as e:
            if ctx.strict:
                raise
            ctx.warn(f"{node.name}: {e}")
            continue
        if node.kind == "destination":
            sinks[node.name] = Sink(node, made["out"])
        ports |= {f"{node.name}.{port}": rel for port, rel in made.items()}
    for w in flow.warnings:
        ctx.warn(w)
    read = {x for node in flow.nodes.values() for _, x in node.inputs}
    ends = [p for p in ports if p not in read and not p.endswith(".error")]
    if not sinks and ends:
        ctx.warn(f"{flow.name}: no destination; the rows of {ends[-1]} are a preview")
    return Result(ports, sinks, ctx, ends[-1] if ends else "")


def run(flow: Flow, ctx: Context) -> Result:
    """Plan the flow and write each sink that has a target: one action a sink.

    Ports that several sinks share are kept on disk between the actions, so an expensive
    source is read once; Spark recomputes a lost part from its lineage.
    """
    result = plan(flow, ctx)
    written = [s for s in result.sinks.values() if s.node.options.get("table") or s.node.options.get("path")]
    shared = _shared(flow, [s.node.name for s in written]) if len(written) > 1 else []
    if shared:
        from pyspark import StorageLevel

        for port in shared:
            ports = result.ports.get(port)
            if ports:
                ports.df.persist(StorageLevel.DISK_ONLY)
    try:
        for s in written:
            ctx.tables.write(result.df(s.node.name), s.node.options)
    finally:
        for port in shared:
            if port in result.ports:
                result.ports[port].df.unpersist()
    return result


def _shared(flow: Flow, sinks: list[str]) -> list[str]:
    """The last ports that more than one of the sinks need: inputs of nodes with several consumers."""
    readers: dict[str, set[str]] = {}
    for node in flow.nodes.values():
        for _, x in node.inputs:
            readers.setdefault(x, set()).add(node.name)
    needed: dict[str, set[str]] = {}

    def visit(name: str, sink: str) -> None:
        if sink in needed.setdefault(name, set()) or name not in flow.nodes:
            return
        needed[name].add(sink)
        for _, x in flow.nodes[name].inputs:
            visit(x.rsplit(".", 1)[0], sink)

    for sink in sinks:
        visit(sink, sink)
    several = lambda port: len({s for r in readers.get(port, ()) for s in needed.get(r, ())}) > 1
    return [p for p, rs in readers.items() if len(rs) > 1 and several(p) and flow.nodes.get(p.rsplit(".", 1)[0]) and flow.nodes[p.rsplit(".", 1)[0]].kind != "source"]
