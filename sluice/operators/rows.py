"""Routing, aggregation, sorting, unions and pass-through operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..errors import ExpressionError
from ..plans.flow import Node
from ..plans.run import Branch, Context, Rel, Split, operator
from .endpoints import column, names


@operator("conditional_split")
def conditional_split(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``conditions``: port to expression, in order; each row goes to the first that holds, else to ``default``.

    In reference mode a row whose earlier condition is unknown goes nowhere; in ssis mode unknown counts as false.
    """
    rel = ins[0][1]
    compiler, holds = ctx.expressions(rel.df), {}
    for port, text in node.options["conditions"].items():
        try:
            p = compiler.condition(text)
        except ExpressionError as e:
            if ctx.strict:
                raise
            ctx.warn(f"{node.name}.{port}: {e}; the condition is false")
            p = F.lit(False)
        holds[port] = F.coalesce(p, F.lit(False)) if ctx.compat == "ssis" else p
    default = node.options.get("default", "default")
    ports, before = {}, []
    for k, (port, p) in enumerate([*holds.items(), (default, None)]):
        row = [~q for q in before] + ([] if p is None else [p])
        ports[port] = Rel(rel.df.where(reduce(lambda a, b: a & b, row)) if row else rel.df)
        before.append(p)
    # Which port a row goes to, for unions of these branches: null where a condition is unknown.
    route = F.lit(len(holds))
    for k, p in reversed(list(enumerate(holds.values()))):
        route = F.when(p, k).when(~p, route)
    split = Split(rel.df, route)
    for k, r in enumerate(ports.values()):
        r.branch = Branch(split, k)
    return ports


@operator("aggregate")
def aggregate(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``by``: group columns (null is a group); ``values``: name to (function, column).  Integer averages are doubles.

    A column with an unknown function is a group column, with a warning.
    """
    rel, o = ins[0][1], node.options
    have = names(rel.df)
    known = {"count", "count_all", "count_distinct", "sum", "avg", "min", "max"}
    odd = {name: source for name, (what, source) in (o.get("values") or {}).items() if what not in known}
    for name in odd:
        ctx.warn(f"{node.name}.{name}: unknown aggregation {o['values'][name][0]!r}; it is a group column")
    o = o | {"by": [*o.get("by", []), *((source or name, name) for name, source in odd.items())], "values": {k: v for k, v in (o.get("values") or {}).items() if k not in odd}}
    group = {c if isinstance(c, str) else c[1]: have[(c if isinstance(c, str) else c[0]).lower()] for c in o.get("by", [])}
    if not group and not o.get("values"):
        ctx.warn(f"{node.name}: nothing to aggregate; rows pass unchanged")
        return {"out": rel}
    how = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    made = []
    for name, (what, source) in (o.get("values") or {}).items():
        if what == "count_all" or what == "count" and source is None:
            made.append(F.count(F.lit(1)).alias(name))
        elif source is None:
            made.append(F.first(F.lit(None).cast("string")).alias(name))
        else:
            made.append(how[what](column(have[source.lower()])).alias(name))
    if not group:
        return {"out": Rel(rel.df.agg(*made))}
    keys = [column(old).alias(new) for new, old in group.items()]
    return {"out": Rel(rel.df.groupBy(*keys).agg(*made) if made else rel.df.select(*keys).distinct())}


@operator("sort")
def sort(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``keys``: (column, ascending); applied by a destination that follows directly.

    ``distinct`` drops repeated rows; in ssis mode repeated keys, of which the least row by its other columns stays.
    """
    rel, o = ins[0][1], node.options
    have = names(rel.df)
    keys = [(have[c.lower()], up) for c, up in o["keys"]]
    df = rel.df
    if o.get("distinct"):
        by = [c for c, _ in keys]
        rest = [c for c in df.columns if c not in by]
        if ctx.compat == "ssis" and rest:
            least = df.groupBy(*map(column, by)).agg(F.min(F.struct(*map(column, rest))).alias("__least"))
            df = least.select(*(column(c) if c in by else F.col("__least")[c].alias(c) for c in df.columns))
        else:
            df = df.distinct()
    return {"out": Rel(df, keys)}


@operator("union_all", "merge")
def union_all(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """Rows of all inputs by column name (``columns``, or those of the first input); missing columns are null.

    A merge sorts by ``keys`` at the sink in ssis mode; otherwise its interleaving is not kept.
    """
    wanted = node.options.get("columns") or ins[0][1].df.columns
    types: dict[str, object] = {}
    for _, rel in ins:
        for f in rel.df.schema:
            types.setdefault(f.name.lower(), f.dataType)
    order = []
    if node.kind == "merge":
        ctx.warn(f"{node.name}: the interleaving order of a merge is not kept")
        order = [tuple(k) for k in node.options.get("keys", [])] if ctx.compat == "ssis" else []
    for name, rel in ins:
        for c in wanted:
            if c.lower() not in names(rel.df):
                ctx.warn(f"{node.name}: {name} has no column {c!r}; it is null")
    met = _met([rel for _, rel in ins], wanted)
    if met is not None:
        return {"out": Rel(met, order)}
    parts = []
    for name, rel in ins:
        have, out = names(rel.df), []
        for c in wanted:
            out.append(column(have[c.lower()]).alias(c) if c.lower() in have else F.lit(None).cast(types.get(c.lower(), "string")).alias(c))
        parts.append(rel.df.select(*out))
    return {"out": Rel(reduce(lambda a, b: a.unionByName(b), parts), order)}


def _met(rels: list[Rel], wanted: list[str]):
    """Branches of one split that only gained columns, in one pass over what was split; None if the inputs are others.

    Each new column is computed for the rows of its branch only, so the split's source, and
    all joins before it, are read once and not once a branch.
    """
    branches = [r.branch for r in rels]
    if len(rels) < 2 or any(b is None or b.split is not branches[0].split for b in branches) or len({b.port for b in branches}) < len(branches):
        return None
    if any({f.name: f.dataType for f in rels[0].df.schema} != {f.name: f.dataType for f in r.df.schema} or any(c.lower() not in names(r.df) for c in wanted) for r in rels):
        return None  # columns of other names or types: the union decides them
    df = branches[0].split.df.withColumn("__route", branches[0].split.route).where(F.col("__route").isin([b.port for b in branches]))
    for b in branches:
        for new in b.added:
            have = names(df)
            df = df.withColumns({have.get(k.lower(), k): F.when(F.col("__route") == b.port, v).otherwise(column(have[k.lower()]) if k.lower() in have else F.lit(None)) for k, v in new.items()})
    have, first = names(df), names(rels[0].df)
    if any(df.schema[have[c.lower()]].dataType != rels[0].df.schema[first[c.lower()]].dataType for c in wanted):
        return None  # a column that was replaced by one of another type
    return df.select(*(column(have[c.lower()]).alias(c) for c in wanted))


@operator("multicast")
def multicast(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    return dict.fromkeys(["out", *node.options.get("ports", [])], ins[0][1])


@operator("row_count")
def row_count(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """Rows pass; ``Result.count(variable)`` has their number after the first action."""
    rel, name = ins[0][1], node.options.get("variable", node.name)
    seen = Observation(f"{node.name}-{id(rel)}")
    ctx.observed[name] = seen
    return {"out": Rel(rel.df.observe(seen, F.count(F.lit(1)).alias("rows")), rel.order)}


@operator("pivot")
def pivot(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``by``, ``on`` (with its ``values``) and ``value``; without them rows pass unchanged, with a warning."""
    o, rel = node.options, ins[0][1]
    if not o.get("on"):
        return passing(ctx, node, ins)
    return {"out": Rel(rel.df.groupBy(*o["by"]).pivot(o["on"], o["values"]).agg(F.first(o["value"])))}


@operator("unpivot")
def unpivot(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``ids``, ``values``, ``name_column`` and ``value_column``; rows with a null value go, as in the package runtime."""
    o, rel = node.options, ins[0][1]
    if not o.get("values"):
        return passing(ctx, node, ins)
    return {"out": Rel(rel.df.unpivot(o["ids"], o["values"], o["name_column"], o["value_column"]).where(column(o["value_column"]).isNotNull()))}


@operator("script")
def script(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``batches``: a function for ``mapInPandas`` with ``schema``; without it rows pass unchanged, with a warning."""
    if not node.options.get("batches"):
        return passing(ctx, node, ins)
    return {"out": Rel(ins[0][1].df.mapInPandas(node.options["batches"], node.options["schema"]))}


@operator("slowly_changing_dimension", "oledb_command", "unknown")
def passing(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    ctx.warn(f"{node.name}: a {node.kind} is not carried out; rows pass unchanged")
    return dict.fromkeys(["out", *node.options.get("ports", [])], ins[0][1])
