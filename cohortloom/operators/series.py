"""Long event tables and per-entity series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rules import VITAL_RULES


def parsed_vitals(raw: DataFrame, accepted_only: bool = False) -> DataFrame:
    """(row_id, id, vital, day, value, unit): classified by name, pressures as two rows; value and day are null where there is none."""
    name = C.first_match(F.col("FLO_MEAS_NAME"), VITAL_RULES)
    df = raw.withColumn("vital", name).filter(F.col("vital").isNotNull() & C.present(F.col("PAT_MRN_ID_ENCRYPT"), C.MISSING_VITALS))
    if accepted_only:
        df = df.filter("upper(ISACCEPTED_YN) = 'Y'")
    systolic, diastolic = C.pressure(F.col("MEAS_VALUE"))
    height = C.height_inches(F.col("MEAS_VALUE"))
    pairs = F.when(
        F.col("vital") == "bp",
        F.array(F.struct(F.lit("bp_systolic").alias("vital"), systolic.alias("value")), F.struct(F.lit("bp_diastolic").alias("vital"), diastolic.alias("value"))),
    ).otherwise(F.array(F.struct(F.col("vital").alias("vital"), F.when(F.col("vital") == "height", height).otherwise(C.to_number(F.col("MEAS_VALUE"), C.MISSING_VITALS)).alias("value"))))
    return (
        df.select(
            F.col("vital_row_id").alias("row_id"), C.strip(F.col("PAT_MRN_ID_ENCRYPT")).alias("id"), C.day_number(F.col("MEAS_DAYS_SINCE_DX_FRST_OBSRVD")).alias("day"), F.col("UNITS").alias("unit"), F.inline(pairs)
        ).select("row_id", "id", "vital", "day", "value", "unit")
    )


def long_vitals(raw: DataFrame, accepted_only: bool = False) -> DataFrame:
    """``parsed_vitals`` without rows that lack value or day."""
    return parsed_vitals(raw, accepted_only).filter(F.col("value").isNotNull() & F.col("day").isNotNull())


def drop_counters(parsed: DataFrame, kind: str) -> DataFrame:
    """(kind, n_kept, n_no_value, n_no_day, n_usable): rows of each kind, those that lack a value or a day, and those that have both."""
    value, day = F.col("value").isNotNull(), F.col("day").isNotNull()
    return parsed.groupBy(kind).agg(F.count("*").alias("n_kept"), F.count_if(~value).alias("n_no_value"), F.count_if(~day).alias("n_no_day"), F.count_if(value & day).alias("n_usable"))


def long_labs(wide: DataFrame, labs: list[str]) -> DataFrame:
    """(row_id, id, lab, pos, day, value, unit) from parallel arrays; the unit is the row's."""
    each = F.array(*[F.struct(F.lit(n).alias("lab"), F.col(f"{n}_days").alias("days"), F.col(f"{n}_value").alias("vals"), F.col(f"{n}_unit").alias("unit")) for n in labs])
    rows = wide.select(F.col("lab_row_id").alias("row_id"), C.strip(F.col("PAT_MRN_ID_ENCRYPT")).alias("id"), F.inline(each))
    return rows.select("row_id", "id", "lab", "unit", "days", F.posexplode("vals").alias("pos", "value")).select("row_id", "id", "lab", "pos", C.broadcast_at(F.col("days"), F.col("pos")).alias("day"), "value", "unit")


def mismatched_lengths(wide: DataFrame, labs: list[str]) -> DataFrame:
    """(lab, n_rows, n_mismatched): rows whose number of values is neither 0, nor 1, nor that of the days."""
    each = F.array(*[F.struct(F.lit(n).alias("lab"), F.size(f"{n}_days").alias("d"), F.size(f"{n}_value").alias("v")) for n in labs])
    return wide.select(F.inline(each)).groupBy("lab").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("v").isin(0, 1) & (F.col("v") != F.col("d"))).alias("n_mismatched"))


def collect_series(long: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, days, values, n): each series in order of day, then of the other sort columns."""
    s = F.array_sort(F.collect_list(F.struct(*order, value)))
    return long.groupBy(*keys).agg(s.alias("s")).select(*keys, F.transform("s", lambda x: x[order[0]]).alias("days"), F.transform("s", lambda x: x[value]).alias("values"), F.size("s").alias("n"))


def coverage(long: DataFrame, key: str, kind: str, total: int) -> DataFrame:
    """(kind, n_entities, pct): entities with at least one value."""
    return long.select(key, kind).distinct().groupBy(kind).agg(F.count("*").alias("n_entities")).withColumn("pct", F.round(100.0 * F.col("n_entities") / F.lit(max(total, 1)), 2))


def modal(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value per group, nulls left out, the smallest on ties."""
    n = df.withColumn("_v", value).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").count()
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), "_v"))["_v"].alias(name))


def with_units(long: DataFrame, keys: list[str], order: list[str], value: str, unit: Column) -> DataFrame:
    """(keys, days, values, n, unit): each series with the unit that most of its readings name, null if none does."""
    return collect_series(long, keys, order, value).join(modal(long, keys, unit, "unit"), keys, "left")


def wide_series(each: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row per entity with ``<kind>_days``, ``<kind>_value`` and ``<kind>_unit`` of every kind, null where it has none."""
    wide = each.groupBy(key).pivot(kind, kinds).agg(F.first("days").alias("days"), F.first("values").alias("value"), F.first("unit").alias("unit"))
    return wide.select(key, *[F.col(f"`{k}_{part}`") for k in kinds for part in ("days", "value", "unit")])
