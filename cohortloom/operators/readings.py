"""From raw vitals rows to typed readings: who, when, which measure, which numbers, which unit is claimed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M

REFERENCE_LIMIT = 50_000
SCHEMA = (
    "row_id long, pid string, day double, attribute string, v1 double, v2 double, label string, "
    "content string, load_ts timestamp, rep long"
)


def reference_rows(reference: DataFrame, *columns: str) -> list[tuple]:
    """The rows of a reference list, on the driver; a list is small by nature, and its size is checked."""
    rows = [tuple(r) for r in reference.select(*columns).limit(REFERENCE_LIMIT + 1).collect()]
    if len(rows) > REFERENCE_LIMIT:
        raise ValueError(f"a reference list holds at most {REFERENCE_LIMIT} entries")
    return sorted(rows, key=str)


def over_distinct(column: pa.ChunkedArray | pa.Array, f: Callable, type_: pa.DataType) -> pa.Array:
    """f of every text of a column, computed once for each different text of the batch. f(None) must be None."""
    coded = column.dictionary_encode()
    return pa.array([f(x) for x in coded.dictionary.to_pylist()], type_).take(coded.indices)


def _day(text: str) -> float | None:
    try:
        d = float(text)
    except ValueError:
        return None
    return d if abs(d) < 1e9 else None


def parse_vitals(
    vitals: DataFrame,
    reference: DataFrame,
    row_id: str = "vital_row_id",
    patient: str = "PAT_MRN_ID_ENCRYPT",
    day: str = "MEAS_DAYS_SINCE_DX_FRST_OBSRVD",
    name: str = "FLO_MEAS_NAME",
    display: str = "DISP_NAME",
    value: str = "MEAS_VALUE",
    unit: str = "UNITS",
    accepted: str = "ISACCEPTED_YN",
    loaded: str = "LOAD_TS",
) -> DataFrame:
    """Every row of ``vitals`` whose name means a measure of ``reference``, as a typed reading.

    One Arrow pass without a shuffle. ``pid`` and ``day`` are null where missing or not numeric; ``v1``/``v2`` are the
    numbers (systolic and diastolic for ``a/b``, total inches for feet and inches), null where the value holds none;
    ``label`` is the unit claimed by the value's own text, else the unit column, the name, or the display name;
    ``content`` is the trimmed value unless it is a missing token; ``rep`` is a hash of all columns but row id and load
    time, so that repeats of a row share it. Rows of unknown measures are left out. Columns beyond those named don't matter.
    """
    entries = reference_rows(reference, "ref_name", "also_known_as", "attribute")
    slim = vitals.select(
        F.col(row_id).cast("long").alias("row_id"),
        *[F.col(c).cast("string").alias(k) for k, c in (("p", patient), ("d", day), ("n", name), ("s", display), ("v", value), ("u", unit))],
        F.col(loaded).alias("load_ts"),
        F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (patient, day, name, display, value, unit, accepted)]).alias("rep"),
    )
    strip = lambda x: None if M.is_missing(x) else x.strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = M.MeasureNames(entries)
        for b in batches:
            attribute = over_distinct(b["n"], names.resolve, pa.string())
            keep = attribute.is_valid()
            b, attribute = b.filter(keep), attribute.filter(keep)
            coded = b["v"].dictionary_encode()
            parsed = [M.parse_value(x) for x in coded.dictionary.to_pylist()]
            v1, v2, in_text = (pa.array([p[i] for p in parsed], t).take(coded.indices) for i, t in enumerate((pa.float64(), pa.float64(), pa.string())))
            label = pa.compute.coalesce(
                in_text, over_distinct(b["u"], M.unit_code, pa.string()), over_distinct(b["n"], M.unit_in_name, pa.string()), over_distinct(b["s"], M.unit_in_name, pa.string())
            )
            yield pa.RecordBatch.from_arrays(
                [b["row_id"], over_distinct(b["p"], M.clean_id, pa.string()), over_distinct(b["d"], _day, pa.float64()), attribute, v1, v2, label, over_distinct(b["v"], strip, pa.string()), b["load_ts"], b["rep"]],
                ["row_id", "pid", "day", "attribute", "v1", "v2", "label", "content", "load_ts", "rep"],
            )

    return slim.mapInArrow(run, SCHEMA)


def explode_lab(labs: DataFrame, lab: str, row_id: str = "lab_row_id", patient: str = "PAT_MRN_ID_ENCRYPT") -> DataFrame:
    """One row per element of a lab's arrays: row_id, pos (0-based place), pid, day, attribute (the lab), v1, label.

    Null or empty arrays give no rows, null elements of the values none either; a day beyond the days' length is null.
    """
    token = F.lower(F.trim(F.col(f"{lab}_unit")))
    label = F.coalesce(*[F.when(F.regexp_replace(token, r"\s+|\.$|^â(?=µ)", "").isin([s.rstrip(".") for s in many]), F.lit(u)) for u, many in M.UNITS.items() if u in M.QUANTITY_UNITS.get(lab, [])] or [F.lit(None).cast("string")])
    pid = F.trim(F.col(patient))
    return (
        labs.select(
            F.col(row_id).cast("long").alias("row_id"),
            F.when(~F.lower(pid).isin(*M.MISSING_ID), pid).alias("pid"),
            label.alias("label"),
            F.col(f"{lab}_days").alias("days"),
            F.posexplode(f"{lab}_value").alias("pos", "v1"),
        )
        .filter(F.col("v1").isNotNull() & ~F.isnan("v1"))
        .select("row_id", "pos", "pid", F.try_element_at("days", F.col("pos") + 1).cast("double").alias("day"), F.lit(lab).alias("attribute"), "v1", "label")
    )
