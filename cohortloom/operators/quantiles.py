"""Exact quantiles of groups without holding a group's values in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(long: DataFrame, by: list[str], value: str, shares: list[float], slices: int = 256) -> DataFrame:
    """(by, q0, q1, ...): the quantiles ``shares`` of each group, between two values in proportion; nulls and NaN don't count.

    Equal values are counted first. Approximate cuts divide each group's values into slices; the slices' counts, at most
    ``slices`` numbers a group, tell which of them hold the places asked for, and only the counts of those slices are added up
    in order. Groups without a value are left out.
    """
    v = F.col(value).cast("double")
    counts = long.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_k"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    # one row of cuts for each group
    cut = _joined(counts, cuts, by)
    cut = cut.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    sums = cut.groupBy(*by, "_slice").agg(F.sum("_k").alias("_s"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    sums = sums.select(*by, "_slice", (F.sum("_s").over(whole.orderBy("_slice")) - F.col("_s")).alias("_before"), "_s", F.sum("_s").over(whole).alias("_n"))
    at = lambda s: (F.col("_n") - 1) * F.lit(float(s))
    places = [(low, F.floor(at(s)) if low else F.ceil(at(s))) for s in shares for low in (True, False)]
    holds = reduce(lambda x, y: x | y, [(p >= F.col("_before")) & (p < F.col("_before") + F.col("_s")) for _, p in places])
    inside = _joined(cut, sums.filter(holds).drop("_s"), [*by, "_slice"])
    upto = F.sum("_k").over(Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    inside = inside.withColumn("_upto", upto)
    here = lambda p: F.max(F.when((p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_k")), F.col("_v")))
    found = inside.groupBy(*by).agg(F.max("_n").alias("_n"), *[here(p).alias(f"_p{i}") for i, (_, p) in enumerate(places)])
    part = lambda s: at(s) - F.floor(at(s))
    return found.select(*by, *[(F.col(f"_p{2 * i}") + (F.col(f"_p{2 * i + 1}") - F.col(f"_p{2 * i}")) * part(s)).alias(f"q{i}") for i, s in enumerate(shares)])


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        # the right side is one row
        return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")
    same: Column = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    return left.alias("l").join(right.alias("r"), same).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in by])


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column, None for columns without a value."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    found = {r["feature"]: [r[f"q{i}"] for i in range(len(shares))] for r in exact_quantiles(df.select(F.inline(each)), ["feature"], "v", shares).collect()}
    return {c: found.get(c, [None] * len(shares)) for c in columns}
