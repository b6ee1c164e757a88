"""Hand fixtures of the clinical semantics."""

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import columns as C
from cohortloom.functions import rules as R


def one(spark, column, **values):
    row = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {row}").select(column.alias("r")).collect()[0].r


@pytest.mark.parametrize(("text", "number"), [("'<5'", 5.0), ("'1,234.5 mg'", 1234.5), ("'1.5-2.0'", 1.5), ("'TNP'", None), ("'neg'", None), ("''", None), ("cast(null as string)", None), ("' 7\\t'", 7.0), ("'1e5'", 1.0)])
def test_first_number(spark, text, number):
    assert one(spark, C.to_number(F.col("x")), x=text) == number


@pytest.mark.parametrize(("text", "number"), [("'5d'", None), ("'5.'", 5.0), ("' -2.5e1 '", -25.0), ("'1,000'", None), ("''", None)])
def test_strict_number(spark, text, number):
    assert one(spark, C.strict_number(F.col("x")), x=text) == number


def test_days_round_half_to_even(spark):
    assert [one(spark, C.day_number(F.col("x")), x=f"'{v}'") for v in ("2.5", "3.5", "-1.5", "x")] == [2, 4, -2, None]


@pytest.mark.parametrize(("text", "inches"), [("'5'' 11\"'", 71.0), ("'5'''", 60.0), ("'180'", 180.0), ("'none'", None)])
def test_heights(spark, text, inches):
    assert one(spark, C.height_inches(F.col("x")), x=text.replace("''", "\\'")) == inches


def test_pressures(spark):
    for text, pair in (("120/80", (120.0, 80.0)), ("118", (118.0, None)), ("120/", (120.0, None)), ("/80", (None, 80.0))):
        a, b = C.pressure(F.col("x"))
        assert one(spark, F.array(a, b), x=f"'{text}'") == list(pair)


def test_code_lists(spark):
    cell = "'I10; e11.9 ,I10|NA/ z'"
    assert one(spark, C.codes_3(F.col("x")), x=cell) == ["I10", "E11"]
    assert one(spark, C.codes_no_dot(F.col("x")), x=cell) == ["I10", "E119", "Z"]
    assert C.expand_prefixes(["E08-E13"]) == ["E08", "E09", "E10", "E11", "E12", "E13"] and C.expand_prefixes(["I11.0"]) == ["I110"]
    assert one(spark, C.any_prefix(C.codes_no_dot(F.col("x")), ["E11"]), x=cell) is True
    assert one(spark, C.any_prefix(C.codes_no_dot(F.col("x")), ["E11"]), x="cast(null as string)") is False


def test_rules(spark):
    assert one(spark, C.first_match(F.col("x"), R.LAB_RULES), x="'Creatinine, urine'") is None
    assert one(spark, C.first_match(F.col("x"), R.LAB_RULES), x="'LDL cholesterol'") == "ldl"
    assert one(spark, C.first_match(F.col("x"), R.VITAL_RULES), x="'bp - mean arterial'") is None
    assert one(spark, C.all_matches(F.col("x"), {"a": (["W"], []), "b": (["X"], []), "c": (["W"], ["Z"])}), x="'wz'") == ["a"]


@pytest.mark.parametrize(("text", "unit"), [("' µmol / L '", "umol/L"), ("'ML/MIN/1.73M²'", "mL/min/1.73m2"), ("'odd'", "odd"), ("'missing'", None), ("cast(null as string)", None)])
def test_unit_spelling(spark, text, unit):
    assert one(spark, C.lab_unit(F.col("x")), x=text) == unit


@pytest.mark.parametrize(
    ("lab", "value", "unit", "common", "out", "status"),
    [("creatinine", 88.4, "umol/L", "mg/dL", 1.0, "converted_by_factor"), ("hba1c", 48, "mmol/mol", "%", 6.54304, "converted_hba1c_to_percent"), ("potassium", 4, "mmol/L", "mEq/L", 4.0, "equivalent_mmol_meq"), ("sodium", 140, "mg/dL", "mmol/L", None, "unsupported_conversion"), ("gfr", 60, "mL/min", "mL/min/1.73m2", 60.0, "treated_as_equivalent_gfr_units"), ("bun", 10, None, "mg/dL", None, "missing_unit")],
)
def test_conversion(spark, lab, value, unit, common, out, status):
    u = "cast(null as string)" if unit is None else f"'{unit}'"
    args = {"lab": f"'{lab}'", "v": f"{float(value)}D", "u": u, "c": f"'{common}'"}
    v, s = C.convert(F.col("lab"), F.col("v"), F.col("u"), F.col("c"))
    got = one(spark, v, **args)
    assert (got is None and out is None) or got == pytest.approx(out, abs=1e-9)
    assert one(spark, s, **args) == status


def test_small_ones(spark):
    assert [one(spark, C.sex_female(F.col("x")), x=f"'{v}'") for v in ("F. Female", "female", "Male", "M. Male")] == [1, 1, 0, 0]
    assert one(spark, C.sex_female(F.col("x")), x="cast(null as string)") == 0
    assert [one(spark, C.binary(F.col("x")), x=f"'{v}'") for v in ("Yes", "absent", "2", "0", "maybe")] == [1, 0, 1, 0, None]
    assert one(spark, C.broadcast_at(F.col("x"), F.lit(3)), x="array(7)") == 7 and one(spark, C.broadcast_at(F.col("x"), F.lit(3)), x="array(7, 8)") is None
    assert one(spark, C.slug(F.col("x")), x="' A-b (c) '") == "a_b_c" and one(spark, C.normal_name(F.col("x")), x="' BP - Sys '") == "bp_sys"
    v, s = C.pressure_gate(F.col("v"), F.col("u"))
    assert [one(spark, s, v="1.0D", u=u) for u in ("'mm[Hg]'", "''", "'kPa'")] == ["valid_mmHg", "missing_assumed_mmHg", "invalid_bp_unit_value_set_missing"]
    assert one(spark, v, v="1.0D", u="'kPa'") is None
    assert one(spark, C.ratio(F.col("a"), F.col("b")), a="1", b="0") is None


def test_names_and_groups(spark):
    assert [one(spark, C.vital_name(F.col("x")), x=f"'{v}'") for v in (" HT ", "Systolic BP", "body-mass/index", "odd (x)")] == ["height", "bp_systolic", "bmi", "odd_x"]
    assert [one(spark, C.race_group(F.col("x")), x=f"'{v}'") for v in (" A. White", "D. Asian/other", "z. x", "")] == ["White", "Asian", "Unknown/Other", "Unknown/Other"]
    assert one(spark, C.race_group(F.col("x")), x="cast(null as string)") == "Unknown/Other"


def test_keyword_categories(spark):
    from cohortloom.operators import codes

    m = spark.createDataFrame([("I50", "Heart failure"), ("E11", "Diabetes and obesity"), ("Z00", None)], "code string, description string")
    assert {tuple(r) for r in codes.keyword_categories(m, R.CATEGORY_KEYWORDS).collect()} == {("I50", "has_heart_failure"), ("E11", "has_diabetes"), ("E11", "has_obesity")}
