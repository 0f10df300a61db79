"""Sources and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FlowError
from ..plans.flow import Node
from ..plans.run import Context, Rel, operator
from ..sources import strip_order


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def names(df: DataFrame) -> dict[str, str]:
    """Actual names by lower-case name."""
    return {c.lower(): c for c in df.columns}


def _projected(df: DataFrame, columns) -> DataFrame:
    """Declared columns: names, or pairs (name in the table, name in the flow)."""
    if not columns:
        return df
    return df.select(*(column(c).alias(c) if isinstance(c, str) else column(c[0]).alias(c[1]) for c in columns))


@operator("source")
def source(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``sql`` (wins), ``variable`` holding SQL, or ``table``; projects the declared ``columns``."""
    o = node.options
    sql = o.get("sql") or (ctx.values.get(tuple(o["variable"])) if o.get("variable") else None)
    if sql:
        text, cut = strip_order(sql)
        if cut:
            ctx.warn(f"{node.name}: the order of the source query is not kept")
        df = ctx.tables.query(text)
    elif o.get("table"):
        df = ctx.tables.read(o["table"], o.get("database", ""))
    else:
        raise FlowError("the source has neither SQL nor a table")
    return {"out": Rel(_projected(df, o.get("columns")))}


@operator("flat_source")
def flat_source(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    return {"out": Rel(_projected(ctx.tables.csv(node.options), node.options.get("columns")))}


@operator("destination")
def destination(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``mapping`` of input to target names; without one all columns by name, with a warning.  Keeps a direct sort's order."""
    rel, mapping = ins[0][1], node.options.get("mapping")
    if not node.options.get("table") and not node.options.get("path"):
        ctx.warn(f"{node.name}: the destination has no target; its rows are returned only")
    if not mapping:
        ctx.warn(f"{node.name}: no column is mapped; all are written by name")
        return {"out": rel}
    have = names(rel.df)
    absent = [c for c in mapping if c.lower() not in have]
    if absent:
        raise FlowError(f"no column {', '.join(absent)}")
    df = rel.df.select(*(column(have[a.lower()]).alias(b) for a, b in mapping.items()))
    target = {a.lower(): b for a, b in mapping.items()}
    order = [(target[c.lower()], up) for c, up in rel.order if c.lower() in target]
    return {"out": Rel(df, order if len(order) == len(rel.order) else [])}
