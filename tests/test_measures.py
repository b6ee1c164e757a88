import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.functions import measures as M
from cohortloom.functions.editing import osa

REFERENCE = [("BLOOD PRESSURE", "BP; B/P", "bp"), ("PULSE", "HR; HEART RATE", "pulse"), ("TEMPERATURE", "TEMP", "temperature"), ("SPO2", "O2 SAT; PULSE OX", "spo2"), ("WEIGHT/SCALE", "WT; BODY WEIGHT", "weight"), ("PAIN SCORE", None, "pain_score")]


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 4))
def test_osa_is_the_plain_distance_up_to_its_limit(a, b, limit):
    assert osa(a, b, limit) == min(plain_osa(a, b), limit + 1)


@pytest.mark.parametrize(
    ("name", "attribute"),
    [("blod presure", "bp"), (" HR ", "pulse"), ("Heartr ate", "pulse"), ("PULSE OX", "spo2"), ("uplseerate", "pulse"), ("bp - sittnig", "bp"), ("weightscale", "weight"), ("nrs ppaain", "pain_score"), ("DRY WEIGHT", None), ("BP GOAL SYSTOLIC", None), ("", None), (None, None), ("n/a", None), ("x" * 5000, None), ("!!!", None)],
)
def test_names(name, attribute):
    assert M.MeasureNames(REFERENCE).resolve(name) == attribute


@pytest.mark.parametrize(
    ("text", "parsed"),
    [("120/80", (120, 80, None)), ("118 / 70 mm Hg", (118, 70, "mmHg")), ("120/", (120, None, None)), ("120/--", (120, None, None)), ("5' 11\"", (71, None, "ft_in")), ("5ft 1", (61, None, "ft_in")), ("1,852 OZ", (1852, None, "oz")), ("36.6°C", (36.6, None, "degC")), ("-37.0", (-37, None, None)), ("see note", (None, None, None)), ("refused", (None, None, None)), (None, (None, None, None)), ("0.92 0-1", (0.92, None, "fraction"))],
)
def test_values(text, parsed):
    assert M.parse_value(text) == parsed


def test_units_in_names():
    assert M.unit_in_name("WEIGHT/SCALE (KG)") == "kg"
    assert M.unit_in_name("Height in inches") == "in"
    assert M.unit_in_name("Temp Celsius") == "degC"
    assert M.unit_in_name("PULSE") is None
    assert M.clean_id(" 0E12 ") == "0E12" and M.clean_id("Unknown") is None
