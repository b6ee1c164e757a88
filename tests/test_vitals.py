import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.attributes import cast_failures, filled_cells, wide_vitals
from cohortloom.operators.readings import explode_lab, parse_vitals
from cohortloom.operators.spikes import flag_series, implausible, phase_space_spikes, stuck_runs
from cohortloom.operators.units import fit_units, to_common_units

RAW = "vital_row_id long, PAT_MRN_ID_ENCRYPT string, MEAS_DAYS_SINCE_DX_FRST_OBSRVD string, FLO_MEAS_NAME string, DISP_NAME string, MEAS_VALUE string, UNITS string, ISACCEPTED_YN string, LOAD_TS timestamp, label string, x double"
REF = [(1, "BLOOD PRESSURE", "BP", "bp"), (2, "PULSE", "HR", "pulse"), (3, "TEMPERATURE", "TEMP", "temperature"), (7, "WEIGHT/SCALE", "WT", "weight"), (6, "HEIGHT", "HT", "height"), (10, "O2 DEVICE", None, "o2_device")]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REF, "ref_id long, ref_name string, also_known_as string, attribute string")


def raw(spark, rows):
    """rows: id, day, name, value, unit; the columns label and x clash with names of results."""
    at = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, p, d, n, None, v, u, "Y", at, "clash", -1.0) for i, (p, d, n, v, u) in enumerate(rows, 1)], RAW)


def readings(spark, reference, rows):
    df = to_common_units(parse_vitals(raw(spark, rows), reference))
    return df.select(F.lit("v").alias("tbl"), "row_id", F.lit(0).alias("pos"), "pid", "day", "attribute", "x", "y", "rep")


def test_parse_keeps_known_measures_only(spark, reference):
    rows = parse_vitals(raw(spark, [(" A1 ", "1.0", "puls", "80 bpm", None), (None, None, "BP", "120/80", "mmHg"), ("unknown", "x", "HT", "5' 11\"", ""), ("A1", "2", "DRY WEIGHT", "70", "kg"), ("A1", "2", None, "70", "kg")]), reference).orderBy("row_id").collect()
    assert [(r.row_id, r.pid, r.day, r.attribute, r.v1, r.v2, r.label) for r in rows] == [(1, "A1", 1.0, "pulse", 80.0, None, None), (2, None, None, "bp", 120.0, 80.0, "mmHg"), (3, None, None, "height", 71.0, None, "ft_in")]


def test_empty_tables(spark, reference):
    none = raw(spark, []).limit(0)
    df = to_common_units(parse_vitals(none, reference))
    assert df.count() == 0 and wide_vitals(df).count() == 0
    assert implausible(df.select(F.lit("v").alias("tbl"), "row_id", F.lit(0).alias("pos"), "pid", "day", "attribute", "x", "y", "rep")).count() == 0
    assert parse_vitals(raw(spark, [("A", "1", "BP", "1/1", None)]), reference.limit(0)).count() >= 0


def test_units_follow_the_numbers_not_the_label(spark, reference):
    rng = random.Random(1)
    rows = [("P%d" % (i % 40), str(i), "BP", f"{rng.gauss(130, 12):.0f}/{rng.gauss(80, 8):.0f}", "mmHg") for i in range(400)]
    rows += [("P%d" % (i % 40), str(i), "BP", f"{rng.gauss(17.3, 1.5):.1f}/{rng.gauss(10.5, 1):.1f}", "kPa") for i in range(40)]
    rows += [("P1", "900", "BP", "17.1/10.9", "mmHg"), ("P2", "901", "BP", "17.1/10.9", None), ("P3", "902", "BP", "0/0", "mmHg")]
    for i in range(30):  # patient Q weighs 90 kg, patient R 180
        rows += [("Q", str(i), "WT", f"{90 + rng.gauss(0, 0.5):.1f}", "kg"), ("R", str(i), "WT", f"{180 + rng.gauss(0, 0.5):.1f}", "kg"), ("S", str(i), "WT", f"{198.4 + rng.gauss(0, 1):.1f}", "lb")]
    rows += [("Q", "50", "WT", "198.4", None), ("R", "50", "WT", "180.2", None)]
    got = {r.row_id: r for r in to_common_units(parse_vitals(raw(spark, rows), reference)).collect()}
    assert len(got) == len(rows)
    assert [got[441].from_unit, got[442].from_unit, got[443].from_unit] == ["kPa", "kPa", "mmHg"]
    assert got[len(rows) - 1].from_unit == "lb" and got[len(rows)].from_unit == "kg"
    assert abs(got[len(rows) - 1].x - 90) < 0.1
    assert all(got[i].from_unit == "mmHg" for i in range(1, 401))


def brute_stuck(x, least):
    out = [False] * len(x)
    for i in range(len(x)):
        j = i
        while j < len(x) and x[j] == x[i]:
            j += 1
        if j - i >= least:
            out[i:j] = [True] * (j - i)
    return out


def test_stuck_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.integers(0, 2, 60).astype(float)
        y = np.full(60, np.nan)
        assert stuck_runs(x, y, np.zeros(60, int), 4).tolist() == brute_stuck(x.tolist(), 4)


def test_spikes_found_steps_left_alone():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(80, 3, 60), rng.normal(120, 3, 60)]
    x[[10, 70, 119]] = [200, 20, 300]
    x[30], x[31] = 180, 30
    found = phase_space_spikes(x, np.zeros(120, int), 3.5)
    assert set(np.flatnonzero(found)) == {10, 30, 31, 70, 119}
    assert not phase_space_spikes(np.r_[[80.0] * 8, 200], np.zeros(9, int), 3.5).any(), "fewer than ten readings"
    assert not phase_space_spikes(np.zeros(0), np.zeros(0, int)).any()


def test_faults_with_repeats_and_missing(spark, reference):
    rng = random.Random(2)
    base = [("A", str(d), "PULSE", str(80 + rng.choice([-3, -1, 0, 2, 4])) if d % 2 else str(70 + d), None) for d in range(14)]
    stuck = [("B", str(d), "PULSE", "77", None) for d in range(6)]  # six: not stuck
    stuck += [("C", str(d), "PULSE", "66", None) for d in range(7)]
    rows = base + stuck + [("B", "5", "PULSE", "77", None), ("C", "6", "PULSE", "66", None), ("A", "7.5", "PULSE", "240", None), (None, None, "BP", "80/120", None), (None, "1", "TEMP", "371", "C"), ("A", None, "PULSE", "240", None)]
    got = {(r.row_id, r.fault) for r in implausible(readings(spark, reference, rows)).collect()}
    n = len(rows)
    expected = {(i, "stuck") for i in range(21, 28)} | {(n - 4, "stuck"), (n - 3, "spike"), (n - 2, "impossible"), (n - 1, "impossible")}
    assert got == expected


def test_long_series_in_chunks_equal_one_chunk(spark):
    rng = np.random.default_rng(5)
    x = 80 + 10 * np.sin(np.arange(3000) / 200) + rng.normal(0, 2, 3000)
    x = x.round(1)
    x[rng.choice(3000, 40, replace=False)] += 70
    x[700:709] = 81.0
    rows = [("v", i, 0, "P", float(i) / 7, "pulse", float(v), None, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "tbl string, row_id long, pos int, pid string, day double, attribute string, x double, y double, rep long")
    whole = {(r.row_id, r.fault) for r in flag_series(df).collect()}
    cut = {(r.row_id, r.fault) for r in flag_series(df, hot=300).collect()}
    assert len(whole) >= 45
    assert whole == cut


@pytest.mark.parametrize("days", [3000, 40, 2, 1])
def test_chunks_of_tied_days_equal_one_chunk(spark, days):
    """Whole-number days with many readings each: calm and agitated stretches, spikes and runs across cuts."""
    rng = np.random.default_rng(6)
    n = 3000
    x = (80 + rng.normal(0, np.where(np.arange(n) < n // 2, 2, 3), n)).round(1)
    x[rng.choice(n, 30, replace=False)] += 60
    for at in (298, 745, 1498, 2250):
        x[at : at + 9] = 81.0
    # rep in order within a day, over its whole range, as hashes are
    rows = [("v", i, 0, "P", float(i * days // n), "pulse", float(v), None, int((i * days / n % 1 + 0.0001) * (2**64 - 2**50)) - 2**63) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "tbl string, row_id long, pos int, pid string, day double, attribute string, x double, y double, rep long")
    whole = {(r.row_id, r.fault) for r in flag_series(df).collect()}
    cut = {(r.row_id, r.fault) for r in flag_series(df, hot=300).collect()}
    assert len({r for r, f in whole if f == "stuck"}) == 36 and len(whole) >= 60
    assert whole == cut


def test_ellipsoids_decide():
    """Readings 4.7 spreads off leave both sides, but most of them stay within the ellipses."""
    rng = np.random.default_rng(7)
    x = 80 + rng.normal(0, 3, 4000)
    far = np.arange(50, 3900, 100)
    near = far + 50
    x[far], x[near] = 80 + 30, 80 + 14
    with_, without = (phase_space_spikes(x, np.zeros(4000, int), 3.0, ellipsoids=e) for e in (True, False))
    assert with_[far].all() and without[far].all()
    assert with_[near].sum() < 0.5 * without[near].sum() and not (with_ & ~without).any()


def test_pressures_without_a_second_number_are_no_spikes(spark):
    rng = np.random.default_rng(8)
    rows = [("v", i, 0, "P", float(i), "bp", 120.0 + int(rng.integers(-6, 7)), None if i % 9 == 4 else 80.0 + int(rng.integers(-4, 5)) - 60 * (i == 20), i) for i in range(60)]
    df = spark.createDataFrame(rows, "tbl string, row_id long, pos int, pid string, day double, attribute string, x double, y double, rep long")
    assert [(r.row_id, r.fault) for r in implausible(df).collect()] == [(20, "spike")]


def test_impossible_and_series_rows_come_once(spark):
    rows = [("v", i, 0, "P" if i % 2 else None, float(i), "pulse", 900.0 if i == 7 or i == 8 else 80.0 + i % 3, None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "tbl string, row_id long, pos int, pid string, day double, attribute string, x double, y double, rep long")
    assert sorted((r.row_id, r.fault) for r in implausible(df).collect()) == [(7, "impossible"), (8, "impossible")]


def test_wide_cells(spark, reference):
    rows = [("A", "1", "BP", "120/80", None), ("A", "2", "BP", "130/", None), ("A", None, "BP", "99/1", None), (" A ", "1", "O2 DEVICE", "Room air", None), ("B", "1", "PULSE", "refused", None), ("B", "2", "PULSE", "later", None), ("B", "3", "PULSE", "refused", None), ("C", "1", "PULSE", "n/a", None), (None, "1", "PULSE", "80", None)]
    df = to_common_units(parse_vitals(raw(spark, rows), reference))
    w = {r.pid: r for r in wide_vitals(df).collect()}
    assert set(w) == {"A", "B", "C"}
    assert (w["A"].bp_systolic, w["A"].bp_diastolic, w["A"].o2_device, w["A"].n_readings) == (130.0, 80.0, "Room air", 4)
    assert w["B"].pulse is None and w["B"].cast_failures == {"pulse": ["later", "refused"]} and w["C"].cast_failures is None
    assert {tuple(r) for r in cast_failures(df).collect()} == {("B", "pulse", "refused", 2), ("B", "pulse", "later", 1)}
    assert {(r.pid, r.attribute) for r in filled_cells(wide_vitals(df)).collect()} == {("A", "bp_systolic"), ("A", "bp_diastolic"), ("A", "o2_device")}


def test_lab_arrays(spark):
    df = spark.createDataFrame([(1, " P ", [1, 2], [88.0, None], "umol/L"), (2, None, [], [], None), (3, "Q", None, [1.0, float("nan"), 2.0], "mg/dL.")], "lab_row_id long, PAT_MRN_ID_ENCRYPT string, creatinine_days array<int>, creatinine_value array<double>, creatinine_unit string")
    got = sorted((r.row_id, r.pos, r.pid, r.day, r.v1, r.label) for r in explode_lab(df, "creatinine").collect())
    assert got == [(1, 0, "P", 1.0, 88.0, "umol/L"), (3, 0, "Q", None, 1.0, "mg/dL"), (3, 2, "Q", None, 2.0, "mg/dL")]
    assert fit_units(explode_lab(df, "creatinine")).centre["creatinine"] != 0
