"""Code lists and drug orders: frequencies, flags per entity, prevalence, top codes, duplicate flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def valid_ids(df: DataFrame, key: str, tokens: tuple[str, ...]) -> DataFrame:
    """Rows with a real id, the id trimmed."""
    return df.filter(C.present(F.col(key), tokens)).withColumn(key, C.strip(F.col(key)))


def frequency(df: DataFrame, key: str, codes: Column, total: int | None = None, label: Column | None = None) -> DataFrame:
    """(code, n_entities, pct_of_entities, rank[, example]): distinct entities per code among all entities of ``df``.

    ``codes`` is an array per row. The example is the label most often seen with the code, the smallest on ties. Ranked
    by entities, then code; the ranking runs over codes only.
    """
    total = df.select(key).distinct().count() if total is None else total
    rows = df.select(F.col(key).alias("_k"), (label if label is not None else F.lit(None).cast("string")).alias("_l"), F.explode(codes).alias("code"))
    out = rows.select("_k", "code").distinct().groupBy("code").agg(F.count("*").alias("n_entities"))
    if label is not None:
        seen = rows.filter(F.col("_l").isNotNull()).groupBy("code", "_l").count()
        out = out.join(seen.groupBy("code").agg(F.min(F.struct((-F.col("count")).alias("n"), "_l"))["_l"].alias("example")), "code", "left")
    rank = F.row_number().over(Window.orderBy(F.desc("n_entities"), "code")).cast("long")
    return out.withColumns({"pct_of_entities": F.round(100.0 * F.col("n_entities") / F.lit(max(total, 1)), 2), "rank": rank})


def flags(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """One row per entity, an int flag for each test that some row of the entity passes; entities without hits stay, as zeros."""
    return df.groupBy(key).agg(*[F.max(t.cast("int")).alias(name) for name, t in tests.items()])


def category_flags(df: DataFrame, key: str, codes: Column, mapping: DataFrame) -> DataFrame:
    """(key, category): categories that an entity's codes map to exactly; ``mapping`` has code, category."""
    return df.select(key, F.explode(codes).alias("code")).distinct().join(mapping, "code").select(key, "category").distinct()


def pivot_flags(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """0/1 for each of the values that an entity has in the column."""
    return df.groupBy(key).pivot(column, values).agg(F.max(F.lit(1))).fillna(0, subset=values)


def prevalence(wide: DataFrame, names: list[str]) -> DataFrame:
    """(flag, prevalence_pct): share of entities with each flag."""
    means = wide.agg(*[F.avg(n).alias(n) for n in names])
    return means.unpivot([], names, "flag", "mean").select("flag", F.round(100 * F.col("mean"), 1).alias("prevalence_pct"))


def top_codes(freq: DataFrame, least_pct: float = 20) -> list[str]:
    """Codes whose rounded (half to even) share reaches the threshold: a bounded list, at most 100 / least_pct per entity's code."""
    return [r[0] for r in freq.filter(F.bround("pct_of_entities") >= least_pct).select("code").orderBy("code").collect()]


def standalone_meds(freq: DataFrame, groups: dict[str, list[str]], least_pct: float = 20) -> dict[str, str]:
    """Flag name -> generic for frequent generics that no drug group covers; of those with one name the first stays."""
    out: dict[str, str] = {}
    for g in top_codes(freq, least_pct):
        name = "med_" + re.sub("^_+|_+$", "", re.sub("[^0-9a-z]+", "_", g.lower()))
        if name not in out and name not in groups and not any(d in g.lower() for many in groups.values() for d in many):
            out[name] = g
    return out


def keyword_categories(mapping: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """(code, category) from a code list with descriptions: all flags one of whose words is in the description."""
    tests = F.array_compact(F.array(*[F.when(C.contains_any(F.lower(F.col("description")), many), F.lit(k)) for k, many in words.items()]))
    return mapping.select("code", F.explode(tests).alias("category")).distinct()


def varying(df: DataFrame, names: list[str]) -> list[str]:
    """Columns with at least two different values; nulls don't count."""
    row = df.agg(*[(F.min(n) < F.max(n)).alias(n) for n in names]).collect()[0]
    return [n for n in names if row[n]]


def duplicates(df: DataFrame, curated: list[str], auto: list[str], least: float = 0.95) -> list[tuple[str, str, float]]:
    """Curated flags that say the same as an automatic one: |r| at least ``least``; constant ones only if identical."""
    moving = set(varying(df, [*curated, *auto]))
    tests = {}
    for a in curated:
        for b in auto:
            tests[a, b] = F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))) if {a, b} <= moving else F.min((F.col(a) == F.col(b)).cast("double"))
    if not tests:
        return []
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests.values())]).collect()[0]
    return [(a, b, row[i]) for i, (a, b) in enumerate(tests) if row[i] is not None and row[i] >= least]


def found_flags(df: DataFrame, key: str, value: str, prefix: str = "", most: int = 2_000) -> DataFrame:
    """One row per entity and a 0/1 column for every different value found, in order; over ``most`` values raise ValueError."""
    values = sorted(r[0] for r in df.filter(F.col(value).isNotNull()).select(value).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"more than {most} different values make no columns")
    wide = df.groupBy(key).pivot(value, values).agg(F.lit(1)) if values else df.select(key).distinct()
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(prefix + v) for v in values])
