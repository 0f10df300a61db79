"""Operators that add or replace columns; each is one projection over the input row."""

from __future__ import annotations

import socket
import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.flow import Node
from ..plans.run import Branch, Context, Rel, operator
from ..types import cast, kind_of, spark_type
from .endpoints import column, names


def merged(rel: Rel, new: dict[str, Column]) -> Rel:
    """Replace columns of the same name in place, whatever their case, and append the others."""
    have = names(rel.df)
    new = {have.get(k.lower(), k): v for k, v in new.items()}
    branch = Branch(rel.branch.split, rel.branch.port, [*rel.branch.added, new]) if rel.branch else None
    return Rel(rel.df.withColumns(new) if new else rel.df, branch=branch)


def _ports(ctx: Context, node: Node, rel: Rel, new: dict[str, Column], lenient: dict[str, tuple[Column, Column]]) -> dict[str, Rel]:
    """The output, and in ssis mode under ``on_error="redirect"`` the port "error" with the rows whose values do not convert.

    ``lenient``: name to (value before the conversion, result that is null instead of an error).
    """
    if ctx.compat != "ssis" or node.options.get("on_error") != "redirect" or not lenient:
        return {"out": merged(rel, new)}
    bad = reduce(lambda a, b: a | b, (value.isNotNull() & result.isNull() for value, result in lenient.values()))
    good = rel.df.where(~bad)
    return {"out": merged(Rel(good), new | {k: result for k, (_, result) in lenient.items()}), "error": Rel(rel.df.where(bad))}


@operator("derived_column")
def derived_column(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``expressions``: name to text, or to (text, type code, length, precision, scale).  All see the input row."""
    rel = ins[0][1]
    compiler, new, lenient = ctx.expressions(rel.df), {}, {}
    for name, spec in node.options["expressions"].items():
        text, *typed = spec if isinstance(spec, tuple | list) else (spec,)
        if not text:
            continue
        try:
            value = compiler.value(text)
            new[name] = cast(value, *typed) if typed and typed[0] else value
            if typed and typed[0]:
                lenient[name] = (value, cast(value, *typed, lenient=True))
        except Exception as e:
            if ctx.strict:
                raise
            ctx.warn(f"{node.name}.{name}: {e}; the column is null")
            new[name] = F.lit(None).cast(spark_type(*([typed[0]] if typed else ["wstr"])))
    return _ports(ctx, node, rel, new, lenient)


@operator("data_conversion")
def data_conversion(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``conversions``: name to (source column, type code, length, precision, scale)."""
    rel, new, lenient = ins[0][1], {}, {}
    have = names(rel.df)
    for name, (source, code, *size) in node.options["conversions"].items():
        found = have.get(source.lower())
        if found is None:
            ctx.warn(f"{node.name}.{name}: no column {source!r}; it is null")
            new[name] = F.lit(None).cast(spark_type(code))
        else:
            kind = kind_of(rel.df.schema[found].dataType)
            new[name] = cast(column(found), code, *size, kind=kind)
            lenient[name] = (column(found), cast(column(found), code, *size, kind=kind, lenient=True))
    return _ports(ctx, node, rel, new, lenient)


@operator("copy_column")
def copy_column(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``copies``: new name to source column."""
    rel = ins[0][1]
    have = names(rel.df)
    return {"out": merged(rel, {new: column(have[old.lower()]) for new, old in node.options["copies"].items()})}


@operator("audit")
def audit(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``columns``: name to what it holds.  Identifiers differ by row, in ssis mode by run."""
    rel, new = ins[0][1], {}
    ident = F.expr("uuid()") if ctx.compat == "reference" else None
    values = {
        "package_name": lambda: F.lit(ctx.package), "start_time": F.localtimestamp, "machine": lambda: F.lit(socket.gethostname()),
        "user": F.current_user, "task_name": lambda: F.lit(node.options.get("task", "Data Flow Task")),
    }
    for name, what in node.options["columns"].items():
        if what in values:
            new[name] = values[what]()
        elif what in ("execution_id", "package_id", "version_id", "task_id"):
            new[name] = ident if ident is not None else F.lit(str(uuid.uuid4()))
        else:
            ctx.warn(f"{node.name}.{name}: unknown audit value {what!r}; it is null")
            new[name] = F.lit(None).cast("string")
    return {"out": merged(rel, new)}


@operator("character_map")
def character_map(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``maps``: name to (source, upper | lower | reverse); without them the rows pass as they are, with a warning."""
    rel = ins[0][1]
    if not node.options.get("maps"):
        ctx.warn(f"{node.name}: nothing is mapped; rows pass unchanged")
        return {"out": rel}
    how = {"upper": F.upper, "lower": F.lower, "reverse": F.reverse}
    return {"out": merged(rel, {new: how[what](column(old)) for new, (old, what) in node.options["maps"].items()})}
