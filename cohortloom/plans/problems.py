"""Queries of the general data problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attributes import cast_failures, filled_cells, wide_vitals
from ..operators.propagate import fill_missing
from ..operators.readings import explode_lab, parse_vitals
from ..operators.spikes import BOUNDS, implausible
from ..operators.units import to_common_units
from ..session import written

VITALS, LABS = "hypertension_vitals_20250520", "labs_by_patient"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vitals(spark: SparkSession, sf: str, columns: tuple[str, ...] = (), numbers_of: tuple[str, ...] = ()) -> DataFrame:
    """Parsed readings, written once: the steps that follow read them in parts. ``columns``: those that are needed, by default
    all; ``numbers_of``: attributes of which only readings with a number are needed, by default everything."""
    df = parse_vitals(table(spark, sf, VITALS), table(spark, sf, "vital_reference"))
    df = df.filter(F.col("v1").isNotNull() & F.col("attribute").isin(*numbers_of)) if numbers_of else df
    return written(df.select(*columns) if columns else df, "readings")


def p1_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that can be implausible: those of measures with bounds that hold a number."""
    measured = tuple(a for a in BOUNDS if a not in ("bp_diastolic", "potassium"))
    common = to_common_units(vitals(spark, sf, ("row_id", "pid", "day", "attribute", "v1", "v2", "label", "rep"), measured))
    lab = explode_lab(table(spark, sf, LABS), "potassium")
    return common.select(
        F.lit(VITALS).alias("tbl"), "row_id", F.lit(0).alias("pos"), "pid", "day", "attribute", F.col("x"), "y", "rep"
    ).unionByName(
        lab.select(
            F.lit(LABS).alias("tbl"), "row_id", "pos", "pid", "day", "attribute", F.col("v1").alias("x"), F.lit(None).cast("double").alias("y"), F.xxhash64("v1").alias("rep")
        )
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible(p1_readings(spark, sf)).select("tbl", "row_id", "pos")


def p1_faults(spark: SparkSession, sf: str) -> DataFrame:
    """How many readings of each table have which fault."""
    return implausible(p1_readings(spark, sf)).groupBy("tbl", "fault").agg(F.count("*").alias("n"))


def p3_converted(spark: SparkSession, sf: str) -> DataFrame:
    """Every number of the quantities with units, in the common unit: tbl, row_id, pos, quantity, value, value2, from_unit, uncertain."""
    quantities = ("bp", "temperature", "spo2", "height", "weight")
    numbers = vitals(spark, sf, ("row_id", "pid", "attribute", "v1", "v2", "label"), quantities)
    lab = written(explode_lab(table(spark, sf, LABS), "creatinine").select("row_id", "pos", "pid", "attribute", "v1", F.lit(None).cast("double").alias("v2"), "label"), "creatinine")
    out = lambda df, name, pos: df.select(F.lit(name).alias("tbl"), "row_id", pos, F.col("attribute").alias("quantity"), F.col("x").alias("value"), F.col("y").alias("value2"), "from_unit", "uncertain")
    return out(to_common_units(numbers), VITALS, F.lit(0).alias("pos")).unionByName(out(to_common_units(lab), LABS, F.col("pos")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    common = table(spark, sf, "unit_reference").select("quantity", F.col("common_unit").alias("from_unit")).distinct()
    return p3_converted(spark, sf).join(F.broadcast(common), ["quantity", "from_unit"], "left_anti").select("tbl", "row_id", "pos", "from_unit")


# What a living patient can have.
POSSIBLE = {"gfr_value": (0.5, 300.0), "bmi_value": (6.0, 210.0), "bp_systolic_value": (20.0, 400.0)}
CONTINUOUS = tuple(f"{c}_value" for c in "creatinine gfr bun sodium potassium calcium glucose height weight bmi bp_systolic bp_diastolic".split())


FILL_GROUPS = ("SEX_FEMALE", "has_heart_failure", "has_ckd", "has_E11", "has_E66", "has_copd")


def filled(master: DataFrame) -> DataFrame:
    features = tuple(c for c in master.columns if c.startswith(("has_", "med_")) or c == "SEX_FEMALE" or c in CONTINUOUS)
    return fill_missing(master, "PAT_MRN_ID_ENCRYPT", POSSIBLE, groups=tuple(c for c in FILL_GROUPS if c in master.columns), features=features)


def p4_filled(spark: SparkSession, sf: str) -> DataFrame:
    """master_clustering_ready with the three columns filled, a mark for each filled cell and what the fill rests on."""
    return filled(table(spark, sf, "master_clustering_ready"))


def p4_observed(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the filled table that aren't filled, with their values: the measured ones, unchanged."""
    cells = F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("value"), F.col(f"{c}_filled").alias("filled")) for c in POSSIBLE])
    return p4_filled(spark, sf).select(F.col("PAT_MRN_ID_ENCRYPT").alias("pat_mrn_id_encrypt"), F.inline(cells)).filter(~F.col("filled")).drop("filled")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array_compact(F.array(*[F.when(F.col(f"{c}_filled"), F.lit(c)) for c in POSSIBLE]))
    return p4_filled(spark, sf).select(F.col("PAT_MRN_ID_ENCRYPT").alias("pat_mrn_id_encrypt"), F.explode(marks).alias("fld"))


def p6_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One typed row per patient; texts that couldn't be cast stay in ``cast_failures``, as JSON."""
    wide = wide_vitals(to_common_units(vitals(spark, sf))).withColumnRenamed("pid", "pat_mrn_id_encrypt")
    return wide.withColumn("cast_failures", F.to_json("cast_failures"))


def p6_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that couldn't be cast, with its patient, attribute and number of rows."""
    return cast_failures(to_common_units(vitals(spark, sf))).withColumnRenamed("pid", "pat_mrn_id_encrypt")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return filled_cells(p6_wide(spark, sf).withColumnRenamed("pat_mrn_id_encrypt", "pid")).select(F.col("pid").alias("pat_mrn_id_encrypt"), "attribute")


QUERIES = {f.__name__: f for f in (p1_found, p1_faults, p3_found, p3_converted, p4_found, p4_filled, p4_observed, p6_found, p6_wide, p6_failures)}

ORACLES = {
    "p4_found": " UNION ALL ".join(
        f"SELECT PAT_MRN_ID_ENCRYPT AS pat_mrn_id_encrypt, '{c}' AS fld FROM master_clustering_ready "
        f"WHERE {c} IS NULL OR isnan({c}) OR {c} < {low} OR {c} > {high}"
        for c, (low, high) in POSSIBLE.items()
    ),
    "p4_observed": " UNION ALL ".join(
        f"SELECT PAT_MRN_ID_ENCRYPT AS pat_mrn_id_encrypt, '{c}' AS fld, {c} AS value FROM master_clustering_ready WHERE NOT isnan({c}) AND {c} BETWEEN {low} AND {high}"
        for c, (low, high) in POSSIBLE.items()
    ),
}
