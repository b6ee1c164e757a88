"""Best reading per entity and measure, pivot, median imputation, unit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import column_quantiles, exact_quantiles
from .series import modal


def best_row(df: DataFrame, keys: list[str], distance: Column, day: str, last: list[str], take: list[str]) -> DataFrame:
    """One row per group: smallest distance (unknown last), then latest day (unknown last), then the sort columns."""
    order = F.struct(F.coalesce(distance, F.lit(999999)).alias("d"), F.col(day).isNull().alias("n"), (-F.col(day)).alias("l"), *last)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*take), order).alias("b")).select(*keys, "b.*")


def pivot_values(df: DataFrame, key: str, kind: str, value: str, kinds: list[str], suffix: str = "_value") -> DataFrame:
    """One row per entity, a column for each kind in the order given, null where there is none."""
    wide = df.groupBy(key).pivot(kind, kinds).agg(F.first(value, ignorenulls=True))
    return wide.select(key, *[F.col(k).alias(k + suffix) for k in kinds])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}


def impute_median(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's exact median, with ``<column>_missing_before`` flags; a column of nulls stays so."""
    m = medians(wide, columns)
    return wide.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing_before") for c in columns]).withColumns({c: F.coalesce(F.col(c), F.lit(m[c]).cast("double")) for c in columns})


def imputation_summary(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, total, with_value, missing_before, median_used, missing_after)."""
    each = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    s = wide.select(F.inline(each)).groupBy("measure").agg(F.count("*").alias("total"), F.count("v").alias("with_value"))
    s = s.join(exact_quantiles(wide.select(F.inline(each)), ["measure"], "v", [0.5]).withColumnRenamed("q0", "median_used"), "measure", "left")
    return s.select("measure", "total", "with_value", (F.col("total") - F.col("with_value")).alias("missing_before"), "median_used", F.when(F.col("median_used").isNull(), F.col("total")).otherwise(0).alias("missing_after"))


def missing_per_entity(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    n = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return wide.select(key, n.alias("n_missing"), F.round(100.0 * n / len(columns), 2).alias("pct_missing"))


def unit_summary(long: DataFrame, kind: str, key: str, unit: Column) -> DataFrame:
    """Per kind: rows, entities, rows and entities with an empty unit, share of such entities, modal unit and its rows, units seen."""
    df = long.withColumn("_u", unit)
    base = df.groupBy(kind).agg(
        F.count("*").alias("total_rows"), F.countDistinct(key).alias("total_entities"), F.count_if(F.col("_u").isNull()).alias("rows_empty_unit"),
        F.countDistinct(F.when(F.col("_u").isNull(), F.col(key))).alias("entities_empty_unit"),
    )
    each = df.filter(F.col("_u").isNotNull()).groupBy(kind, "_u").count()
    most = each.groupBy(kind).agg(
        F.min(F.struct((-F.col("count")).alias("n"), "_u")).alias("m"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "_u", F.col("count").cast("string")))), ";").alias("all_units_seen"),
    )
    return base.join(most, kind, "left").select(
        kind, "total_rows", "total_entities", "rows_empty_unit", "entities_empty_unit", F.round(100.0 * F.col("entities_empty_unit") / F.col("total_entities"), 4).alias("percent_empty_unit"),
        F.col("m._u").alias("most_common_unit"), (-F.col("m.n")).alias("most_common_unit_rows"), "all_units_seen",
    )


def modal_units(long: DataFrame, kind: str, unit: Column) -> DataFrame:
    """(kind, common_unit): the unit that most rows of each kind have, the smallest on ties."""
    return modal(long, [kind], unit, "common_unit")


def converted(long: DataFrame, kind: str, unit: Column, common: DataFrame | None = None, fill_missing_unit: bool = False) -> DataFrame:
    """Adds unit_norm, common_unit, value_common, conversion_status[, unit_filled]; ``common`` is a small table kind -> common_unit, by
    default that of each kind's most frequent unit. With ``fill_missing_unit`` a missing unit counts as the common one."""
    common = modal_units(long, kind, unit) if common is None else common
    df = long.withColumn("unit_norm", unit).join(F.broadcast(common), kind, "left")
    used = F.coalesce("unit_norm", "common_unit") if fill_missing_unit else F.col("unit_norm")
    value, status = C.convert(F.col(kind), F.col("value"), used, F.col("common_unit"))
    return df.withColumns({"value_common": value, "conversion_status": status, "unit_filled": (F.col("unit_norm").isNull() & used.isNotNull()).cast("int")})
