"""Comparison of a result with an expected data set, as distributed aggregations.

Columns follow a policy: "exact", ("near", tolerance) for numbers and times (seconds),
"non_null" (only whether there is a value) or "exclude".  Rows are multisets: exact columns
form keys that must occur equally often; within a key, near columns are matched in sorted
order, which pairs values best for one near column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Verdict:
    equal: bool
    missing: int  # rows expected but absent
    extra: int
    off: int  # pairs outside a tolerance


def compare(actual: DataFrame, expected: DataFrame, policy: dict[str, object] | None = None, order: list[str] | None = None) -> Verdict:
    """``order`` names columns that give each row its position in both; else rows are multisets."""
    policy = {c: (policy or {}).get(c, "exact") for c in expected.columns}
    exact = [c for c, p in policy.items() if p in ("exact", "non_null")]
    near = {c: p[1] for c, p in policy.items() if isinstance(p, tuple)}

    def placed(df: DataFrame, name: str) -> DataFrame:
        keys = [(F.col(f"`{c}`").isNotNull() if policy[c] == "non_null" else F.col(f"`{c}`").cast("string")).alias(f"k{i}") for i, c in enumerate(exact)]
        number = lambda c: F.col(f"`{c}`").cast("timestamp").cast("double") if dict(df.dtypes)[c].startswith(("timestamp", "date")) else F.col(f"`{c}`").cast("double")
        df = df.select(*keys, *(number(c).alias(f"{name}{i}") for i, c in enumerate(near)), *(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order or [])))
        by = [f"k{i}" for i in range(len(exact))] or [F.lit(0)]
        rank = Window.partitionBy(*by).orderBy(*([f"o{i}" for i in range(len(order))] if order else [f"{name}{i}" for i in range(len(near))] or [F.lit(0)]))
        return df.withColumn("place", F.row_number().over(rank)).drop(*(f"o{i}" for i in range(len(order or []))))

    if not near:  # counts of equal rows are enough, and no group is ordered
        keys = lambda df, sign: df.select(*((F.col(f"`{c}`").isNotNull() if policy[c] == "non_null" else F.col(f"`{c}`").cast("string")).alias(f"k{i}") for i, c in enumerate(exact)), F.lit(sign).alias("n"))
        r = keys(expected, 1).unionByName(keys(actual, -1)).groupBy(*(f"k{i}" for i in range(len(exact)))).agg(F.sum("n").alias("n"))
        r = r.agg(F.sum(F.greatest("n", F.lit(0))), F.sum(F.greatest(-F.col("n"), F.lit(0)))).first()
        missing, extra = int(r[0] or 0), int(r[1] or 0)
        return Verdict(not missing and not extra, missing, extra, 0)
    a, b = placed(actual, "a").withColumn("in_a", F.lit(True)), placed(expected, "b").withColumn("in_b", F.lit(True))
    on = [a[f"k{i}"].eqNullSafe(b[f"k{i}"]) for i in range(len(exact))] + [a["place"] == b["place"]]
    both = a.join(b, on, "full")
    off = F.lit(False)
    for i, tolerance in enumerate(near.values()):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        off = off | F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
    r = both.agg(F.sum(F.col("in_a").isNull().cast("int")), F.sum(F.col("in_b").isNull().cast("int")), F.sum((F.col("in_a") & F.col("in_b") & off).cast("int"))).first()
    missing, extra, wrong = (int(v or 0) for v in r)
    return Verdict(not (missing or extra or wrong), missing, extra, wrong)
