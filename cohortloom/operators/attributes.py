"""Attribute-value rows into one wide, typed row per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import NUMERIC, TEXTUAL

COLUMNS = [c for a in NUMERIC for c in (("bp_systolic", "bp_diastolic") if a == "bp" else (a,))]


def wide_vitals(readings: DataFrame) -> DataFrame:
    """One row per patient: pid, a double column per numeric attribute (bp as two), a string column per textual one,
    ``cast_failures`` map<attribute, array<text>> and ``n_readings``.

    ``readings``: row_id, pid, day, attribute, x, y, content, load_ts. A cell holds the patient's latest reading that has a
    number (any text for the textual ones): latest day, rows without day first, then load time, then row id. A pressure
    with a first number only fills ``bp_systolic``. Texts of numeric attributes without a number don't vanish:
    ``cast_failures`` keeps every different one of each attribute, in order, null if there are none; ``cast_failures`` (the
    function) counts them. Rows without patient are left out; patients whose rows hold nothing but missing tokens get a
    row of nulls.

    Each row is reduced before the shuffle (latest per patient, attribute and text that failed), then a patient's few pairs
    form the map; a patient with a third of all rows costs no more than any other.
    """
    order = (F.coalesce("day", F.lit(float("-inf"))), F.col("load_ts"), F.col("row_id"))
    numeric = F.col("attribute").isin(*NUMERIC)
    number = F.when(numeric, F.col("x"))
    text = F.when(~numeric, F.col("content"))
    latest = lambda value, alias: F.max(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))).alias(alias)
    second = F.when(F.col("attribute") == "bp", F.col("y"))
    pairs = (
        readings.filter(F.col("pid").isNotNull())
        .groupBy("pid", "attribute")
        .agg(latest(number, "number"), latest(second, "second"), latest(text, "text"), F.count("*").alias("n"))
    )
    entry = lambda key, c: F.when(F.col(f"{c}.v").isNotNull(), F.struct(key.alias("key"), F.col(f"{c}.v").alias("value")))
    key = F.when(F.col("attribute") == "bp", F.lit("bp_systolic")).otherwise(F.col("attribute"))
    maps = pairs.groupBy("pid").agg(
        F.map_from_entries(F.array_compact(F.flatten(F.collect_list(F.array(entry(key, "number"), entry(F.lit("bp_diastolic"), "second")))))).alias("numbers"),
        F.map_from_entries(F.array_compact(F.collect_list(entry(F.col("attribute"), "text")))).alias("texts"),
        F.sum("n").alias("n_readings"),
    )
    texts = F.array_sort(F.collect_list("content")).alias("value")
    failures = cast_failures(readings).groupBy("pid", "attribute").agg(texts).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("failures"))
    return maps.join(failures, "pid", "left").select(
        "pid",
        *[F.try_element_at("numbers", F.lit(c)).alias(c) for c in COLUMNS],
        *[F.try_element_at("texts", F.lit(c)).alias(c) for c in TEXTUAL],
        F.col("failures").alias("cast_failures"),
        "n_readings",
    )


def cast_failures(readings: DataFrame) -> DataFrame:
    """(pid, attribute, content, n): every text of a numeric attribute that holds no number, and how often the patient has it."""
    failed = F.col("pid").isNotNull() & F.col("attribute").isin(*NUMERIC) & F.col("x").isNull() & F.col("content").isNotNull()
    return readings.filter(failed).groupBy("pid", "attribute", "content").agg(F.count("*").alias("n"))


def filled_cells(wide: DataFrame) -> DataFrame:
    """(pid, attribute) of every filled cell of the wide table."""
    cells = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in [*COLUMNS, *TEXTUAL]]))
    return wide.select("pid", F.explode(cells).alias("attribute"))
