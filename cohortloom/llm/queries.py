"""Queries on problems tagged llm, over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import map_to_list
from .leakage import find_leaks
from .packing import pack, token_sizes
from .reading import LEAST_WORDS, reading_levels
from .similarity import describe_groups, group_records

VITALS, MEDS, MASTER = "hypertension_vitals_20250520", "hypertension_medications_20250417", "master_clustering_ready"

# What a living patient can have.
POSSIBLE = {
    "creatinine_value": (0.05, 40.0), "gfr_value": (0.5, 300.0), "bun_value": (0.5, 300.0), "sodium_value": (80.0, 200.0), "potassium_value": (0.8, 15.0),
    "calcium_value": (2.0, 25.0), "glucose_value": (10.0, 2000.0), "height_value": (25.0, 275.0), "weight_value": (1.5, 640.0), "bmi_value": (6.0, 210.0),
    "bp_systolic_value": (20.0, 400.0), "bp_diastolic_value": (5.0, 300.0),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Every typed name: fld, row_id, value, ref_id (0: none in the list, null: missing), score, exact."""
    v, m = table(spark, sf, VITALS), table(spark, sf, MEDS)
    pick = lambda df, key, column: df.select(F.lit(column.lower()).alias("fld"), F.col(key).alias("row_id"), F.col(column).alias("value"))
    vital = map_to_list(pick(v, "vital_row_id", "FLO_MEAS_NAME"), table(spark, sf, "vital_reference"))
    drug = map_to_list(pick(m, "med_row_id", "SIMPLE_GENERIC").unionByName(pick(m, "med_row_id", "MEDICATION_NAME")), table(spark, sf, "generic_reference"))
    return vital.unionByName(drug)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_mapped(spark, sf).filter(F.col("ref_id").isNotNull() & ~F.col("exact")).select("fld", "row_id", "ref_id")


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that the list has no entry for, with their rows."""
    return p2_mapped(spark, sf).filter("ref_id = 0").groupBy("fld", F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("n"))


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rows and records of ``group_records``."""
    master = table(spark, sf, MASTER)
    flags = tuple(c for c in master.columns if c.startswith(("has_", "med_")) or c == "SEX_FEMALE")
    return group_records(master, "PAT_MRN_ID_ENCRYPT", flags, {c: POSSIBLE[c] for c in master.columns if c in POSSIBLE}, 5, 10)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every patient, -1 for stragglers."""
    return _groups(spark, sf)[0].select(F.col("key").alias("pat_mrn_id_encrypt"), F.col("group").alias("patient_group"))


def p5_described(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's size and most typical patients."""
    d = describe_groups(*_groups(spark, sf))
    return d.select(F.col("group").alias("patient_group"), "size", F.round("share", 6).alias("share"), "rank", F.col("key").alias("pat_mrn_id_encrypt"), F.round("degree", 6).alias("degree"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = p5_groups(spark, sf)
    probes = table(spark, sf, "cluster_probes").select(F.col("PAT_MRN_ID_ENCRYPT").alias("pat_mrn_id_encrypt")).distinct()
    own = groups.join(F.broadcast(probes), "pat_mrn_id_encrypt").filter("patient_group >= 0")
    a = own.select(F.col("pat_mrn_id_encrypt").alias("pat_a"), "patient_group")
    b = own.select(F.col("pat_mrn_id_encrypt").alias("pat_b"), "patient_group")
    # the probes are a stated set of 60
    return a.join(b, "patient_group").filter("pat_a < pat_b").select("pat_a", "pat_b")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Container, place and extent of every notebook or piece, for every capacity."""
    return pack(token_sizes(table(spark, sf, "documents")), table(spark, sf, "pack_capacities"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many notebooks each item leaked into; items that didn't leak have none."""
    hits = p8_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, sf, "eval_items").select("item_id", "bench").join(hits, "item_id", "left").select("item_id", "bench", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level of every notebook; ``calibrated`` is false where its language isn't that of the graded passages, English."""
    d = table(spark, sf, "documents").withColumn("calibrated", F.coalesce(F.col("lang") == "en", F.lit(False)))
    return reading_levels(d, table(spark, sf, "reading_anchors"), keep=("calibrated",))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("lang = 'en'")
    return reading_levels(d, table(spark, sf, "reading_anchors")).filter(F.col("reading_level").isNotNull() & (F.col("n_words") >= LEAST_WORDS)).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by level, apart for levels that aren't calibrated: notebooks, those under 40 words of them, words and mean score."""
    short = F.count_if(F.col("n_words") < LEAST_WORDS).alias("n_short")
    return p9_levels(spark, sf).groupBy("reading_level", "calibrated").agg(F.count("*").alias("n_docs"), short, F.sum("n_words").alias("n_words"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f.__name__: f for f in (p2_found, p2_mapped, p2_unmatched, p5_found, p5_groups, p5_described, p7_packed, p8_found, p8_items, p9_found, p9_levels, p9_profile)}
ORACLES: dict[str, str] = {}
