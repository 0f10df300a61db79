"""Lookup and merge join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..errors import FlowError
from ..plans.flow import Node
from ..plans.run import Context, Rel, operator
from ..sources import strip_order
from .endpoints import names

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20  # a lookup declared small may be sent to all executors up to so many rows and bytes (as text)


def _is_small(ref) -> bool:
    """Whether all rows of the reference fit the limits; more rows than that are not read."""
    size = ref.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES


@operator("lookup")
def lookup(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``keys``: input to reference column; ``take``: new name to reference column; ports "match" and "nomatch".

    Reference mode keeps rows without a partner in "match" with nulls and multiplies rows
    whose key repeats.  In ssis mode "match" holds the first partner only (by ``order``),
    and rows without one are in "nomatch", or fail the run under ``on_missing="fail"``.
    Spark broadcasts the reference if its statistics allow; ``small=True`` asks for it and is checked by count and bytes.
    """
    rel, o = ins[0][1], node.options
    if not o.get("keys"):
        ctx.warn(f"{node.name}: the lookup has no keys; rows pass unchanged")
        return {"match": rel, "out": rel}
    if not (o.get("table") or o.get("sql")):
        raise FlowError("the lookup has no reference")
    ref = ctx.tables.query(strip_order(o["sql"])[0]) if o.get("sql") else ctx.tables.read(o["table"])
    have, there = names(rel.df), names(ref)
    keys = [(have[a.lower()], there[b.lower()]) for a, b in o["keys"].items()]
    take = {new: there[old.lower()] for new, old in (o.get("take") or {}).items()}
    needed = list(dict.fromkeys([*(y for _, y in keys), *take.values(), *(there[c.lower()] for c in o.get("order", []))]))
    ref = ref.select(*(F.col(f"`{c}`") for c in needed))
    if ctx.compat == "ssis":
        # The first row of each key: the least by its order, found before the shuffle already.
        by = list(dict.fromkeys(y for _, y in keys))
        ranked = list(dict.fromkeys([*(there[c.lower()] for c in o.get("order", [])), *needed]))
        least = F.min(F.struct(*(F.col(f"`{c}`") for c in ranked))).alias("__first")
        ref = ref.where(" and ".join(f"`{y}` is not null" for y in by)).groupBy(*(F.col(f"`{y}`") for y in by)).agg(least)
        ref = ref.select(*(F.col(f"`{c}`") if c in by else F.col("__first")[c].alias(c) for c in needed))
    left, right = rel.df.alias("l"), ref.alias("r")
    if o.get("small") and _is_small(ref):
        right = F.broadcast(right)
    clash = [n for n in take if n.lower() in have]
    if clash:
        ctx.warn(f"{node.name}: {', '.join(clash)} replaced by reference values")
    replaced = {n.lower(): src for n, src in take.items()}
    picked = [F.col(f"r.`{replaced[c.lower()]}`").alias(c) if c.lower() in replaced else F.col(f"l.`{c}`").alias(c) for c in rel.df.columns]
    picked += [F.col(f"r.`{src}`").alias(n) for n, src in take.items() if n.lower() not in have]
    on = reduce(lambda a, b: a & b, (F.col(f"l.`{x}`") == F.col(f"r.`{y}`") for x, y in keys))
    how = "left" if ctx.compat == "reference" or o.get("on_missing") in ("ignore", "fail") else "inner"
    if how == "left" and o.get("on_missing") == "fail" and ctx.compat == "ssis":
        first = F.col(f"r.`{keys[0][1]}`")
        on_left = left.join(right, on, "left").withColumn("__ok", F.when(first.isNull(), F.raise_error(F.lit(f"{node.name}: a row has no match"))).otherwise(F.lit(True)))
        match = on_left.where("__ok").select(*picked)
    else:
        match = left.join(right, on, how).select(*picked)
    missing = left.join(right, on, "left_anti")
    return {"match": Rel(match), "out": Rel(match), "nomatch": Rel(missing.select(*(F.col(f"l.`{c}`").alias(c) for c in rel.df.columns)))}


@operator("merge_join")
def merge_join(ctx: Context, node: Node, ins) -> dict[str, Rel]:
    """``how``: inner, left or full on ``keys`` (default: the first ``n_keys`` common columns); null keys never match.

    ``columns``: names, taken from the left input first.  Keys of rows that only the right
    input has are null.  Without common columns every row meets every other, with a warning.
    """
    o = node.options
    sides = {("left" if "left" in n.lower() else "right" if "right" in n.lower() else n): r for n, r in ins}
    left = (sides.get("left") or ins[0][1]).df
    right = (sides.get("right") or ins[1][1]).df
    mine, yours = names(left), names(right)
    common = [(mine[c], yours[c]) for c in (x.lower() for x in left.columns) if c in yours]
    keys = o.get("keys") or (common[: o["n_keys"]] if o.get("n_keys") else common)
    how = {0: "full", 1: "left", 2: "inner"}.get(o.get("how", "inner"), o.get("how", "inner"))
    left, right = left.alias("l"), right.alias("r")
    if keys:
        both = left.join(right, reduce(lambda a, b: a & b, (F.col(f"l.`{x}`") == F.col(f"r.`{y}`") for x, y in keys)), how)
    else:
        ctx.warn(f"{node.name}: no common column; every row meets every other")
        both = left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    wanted = o.get("columns") or [*left.columns, *(c for c in right.columns if c.lower() not in mine)]
    out = []
    for c in wanted:
        new, old = (c, c) if isinstance(c, str) else c
        if old.lower() in mine:
            out.append(F.col(f"l.`{mine[old.lower()]}`").alias(new))
        elif old.lower() in yours:
            out.append(F.col(f"r.`{yours[old.lower()]}`").alias(new))
        else:
            ctx.warn(f"{node.name}: no column {old!r}; it is null")
            out.append(F.lit(None).cast("string").alias(new))
    return {"out": Rel(both.select(*out))}
