"""Column functions for messy clinical text: missing tokens, codes, numbers, pairs, units, rules.

All are expressions over built-in functions, so they stay in generated code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Tokens that mean "missing" in each dataset, compared after trimming, in upper case.
MISSING_DIAGNOSES = ("", "NAN", "NA", "N/A", "NULL", "NONE", ".", "..", "...", "?", "-", "UNKNOWN", "UNSPECIFIED", "*UNSPECIFIED", "*UNK", "*DELETED")
MISSING_MEDS = ("", "NAN", "NA", "N/A", "NULL", "NONE", ".")
MISSING_LABS = ("", "NAN", "NA", "N/A", "NULL", "NONE", ".", "?", "-", "SEE NOTE", "SEE COMMENT", "TNP", "CANCELLED", "PENDING")
MISSING_VITALS = tuple(t for t in MISSING_LABS if t != "CANCELLED")
MISSING_UNITS = ("", "NAN", "NONE", "NULL", "NA", "N/A", "MISSING", "UNKNOWN")
MISSING_TEXT = ("NAN", "NONE", "NULL", "NA", "N/A")
MISSING_LINK = ("", "NAN", "NONE", "NULL")
MISSING_MASTER = ("", "NAN")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether a text is there and is none of the missing tokens; never null."""
    return F.coalesce(~F.upper(strip(c)).isin(*tokens), F.lit(False))


def missing_kinds(c: Column) -> dict[str, Column]:
    """Flags of the ways a text can be missing: null, blank, a missing token, any of them."""
    blank = F.coalesce(strip(c) == "", F.lit(False))
    token = F.coalesce(F.upper(strip(c)).isin(*MISSING_TEXT), F.lit(False))
    return {"null": c.isNull(), "blank": blank, "text": token, "any": c.isNull() | blank | token}


def codes_no_dot(cell: Column, tokens: tuple[str, ...] = MISSING_DIAGNOSES) -> Column:
    """Distinct codes of a free list, in order: cut at ``; , | /``, upper case, no blanks, no missing tokens, no dots."""
    parts = F.transform(F.split(cell, r"[;,|/]+"), lambda x: F.regexp_replace(F.upper(x), r"\s+", ""))
    kept = F.filter(parts, lambda x: ~x.isin(*tokens))
    bare = F.transform(kept, lambda x: F.replace(x, F.lit("."), F.lit("")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def codes_3(cell: Column, tokens: tuple[str, ...] = MISSING_DIAGNOSES) -> Column:
    """As codes_no_dot, rolled up to the first three characters; shorter codes are left out."""
    return F.array_distinct(F.transform(F.filter(codes_no_dot(cell, tokens), lambda x: F.length(x) >= 3), lambda x: F.substring(x, 1, 3)))


def expand_prefixes(spec: list[str]) -> list[str]:
    """Prefixes of ``I50``, ``I11.0`` or ranges such as ``A10-A15``, without dots."""
    out = []
    for s in spec:
        low, dash, high = s.partition("-")
        out += [f"{low[0]}{n:02d}" for n in range(int(low[1:]), int(high[1:]) + 1)] if dash else [s.replace(".", "")]
    return out


def any_prefix(codes: Column, prefixes: list[str]) -> Column:
    """Whether some code begins with some prefix."""
    pattern = "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"
    return F.coalesce(F.exists(codes, lambda x: x.rlike(pattern)), F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a text has some of the words as a part; never null."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


def first_match(name: Column, rules: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The first class one of whose include words, and none of whose exclude words, occurs in the upper-cased name."""
    up, out = F.upper(name), None
    for label, (include, exclude) in rules.items():
        hit = contains_any(up, include) & (~contains_any(up, exclude) if exclude else F.lit(True))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def all_matches(name: Column, rules: dict[str, tuple[list[str], list[str]]]) -> Column:
    """All classes that match, in the order of the rules."""
    up = F.upper(name)
    each = [F.when(contains_any(up, inc) & (~contains_any(up, exc) if exc else F.lit(True)), F.lit(k)) for k, (inc, exc) in rules.items()]
    return F.array_compact(F.array(*each))


def to_number(c: Column, tokens: tuple[str, ...] = MISSING_LABS) -> Column:
    """The first number in a text (``<5`` is 5, ``1,234.5 mg`` 1234.5, ``1.5-2`` 1.5); null for tokens and other texts."""
    digits = F.regexp_extract(F.replace(strip(c), F.lit(","), F.lit("")), r"[-+]?\d*\.?\d+", 0)
    return F.when(present(c, tokens), F.nullif(digits, F.lit("")).try_cast("double"))


def strict_number(c: Column) -> Column:
    """The number that the whole text is, else null (``5d`` is none)."""
    t = strip(c)
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def day_number(c: Column) -> Column:
    """A day as whole number, halves to even."""
    return F.bround(strict_number(c)).cast("int")


def height_inches(c: Column) -> Column:
    """Feet and inches (``5' 11"``, ``5'``) as inches, other texts as their first number."""
    feet = F.nullif(F.regexp_extract(c, r"(\d+)\s*'\s*(\d*\.?\d*)", 1), F.lit("")).try_cast("double")
    inches = F.coalesce(F.nullif(F.regexp_extract(c, r"(\d+)\s*'\s*(\d*\.?\d*)", 2), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.coalesce(feet * 12 + inches, to_number(c, MISSING_VITALS))


def pressure(c: Column) -> tuple[Column, Column]:
    """Systolic and diastolic of ``120/80``; without a slash the value and null."""
    slash = F.instr(c, "/")
    first = F.when(slash > 0, F.substring_index(c, "/", 1)).otherwise(c)
    rest = F.when(slash > 0, F.substring(c, slash + 1, F.length(c)))
    return to_number(first, MISSING_VITALS), to_number(rest, MISSING_VITALS)


def normal_name(c: Column) -> Column:
    """Lower case, blanks and dashes as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[-\s]+", "_"), "_+", "_")


def vital_name(c: Column) -> Column:
    """A vital's name in normal form, known synonyms as the vital they mean."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[-/\\ ]", "_"), "[^a-z0-9_]+", "")
    key = F.regexp_replace(F.regexp_replace(bare, "_+", "_"), "^_|_$", "")
    table = F.create_map(*[F.lit(x) for name, many in rules.VITAL_SYNONYMS.items() for s in many for x in (s, name)])
    return F.coalesce(F.try_element_at(table, key), key)


def race_group(c: Column) -> Column:
    """The group that a race's text begins like; Unknown/Other for all else, null too."""
    low = F.lower(strip(c))
    out = F.lit("Unknown/Other")
    for start, group in rules.RACE_GROUPS.items():
        out = F.when(F.coalesce(F.startswith(low, F.lit(start)), F.lit(False)), F.lit(group)).otherwise(out)
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")


# Spellings of lab units after lower-casing and rewriting micro and power signs.
LAB_UNITS = {
    "mg/dl": "mg/dL", "mg/dl.": "mg/dL", "umol/l": "umol/L", "mcmol/l": "umol/L", "mmol/l": "mmol/L", "mmol": "mmol/L", "meq/l": "mEq/L",
    "ml/min": "mL/min", "ml/min/1.73m2": "mL/min/1.73m2", "%": "%", "mmol/mol": "mmol/mol",
}


def lab_unit(c: Column) -> Column:
    """The canonical spelling of a unit; unknown ones as they are, trimmed; null for missing tokens."""
    key = F.lower(F.regexp_replace(F.translate(strip(c), "µμ²", "uu2"), r"\s+", ""))
    table = F.create_map(*[F.lit(x) for kv in LAB_UNITS.items() for x in kv])
    return F.when(present(c, MISSING_UNITS), F.coalesce(F.try_element_at(table, key), strip(c)))


# Factors to the common unit of each measure (from unit, to unit, factor).
LAB_FACTORS = [
    ("creatinine", "umol/L", "mg/dL", 1 / 88.4), ("creatinine", "mg/dL", "umol/L", 88.4), ("bun", "mg/dL", "mmol/L", 0.357), ("bun", "mmol/L", "mg/dL", 1 / 0.357),
    ("calcium", "mg/dL", "mmol/L", 0.2495), ("calcium", "mmol/L", "mg/dL", 1 / 0.2495), ("glucose", "mmol/L", "mg/dL", 18.0182), ("glucose", "mg/dL", "mmol/L", 1 / 18.0182),
    ("magnesium", "mg/dL", "mmol/L", 0.4114), ("magnesium", "mmol/L", "mg/dL", 1 / 0.4114), ("cholesterol_total", "mg/dL", "mmol/L", 0.02586),
    ("ldl", "mg/dL", "mmol/L", 0.02586), ("hdl", "mg/dL", "mmol/L", 0.02586), ("triglycerides", "mg/dL", "mmol/L", 0.01129),
]
EQUIVALENT = {"sodium": ("mmol/L", "mEq/L"), "potassium": ("mmol/L", "mEq/L"), "gfr": ("mL/min", "mL/min/1.73m2")}


def convert(lab: Column, value: Column, unit: Column, common: Column) -> tuple[Column, Column]:
    """The value in the common unit, and how it got there. Units that can't be converted give null."""
    key = F.concat_ws("|", lab, unit, common)
    factors = F.create_map(*[x for m, a, b, f in LAB_FACTORS for x in (F.lit(f"{m}|{a}|{b}"), F.lit(f))])
    factor = F.try_element_at(factors, key)
    same = unit == common
    mmol = lab.isin("sodium", "potassium") & unit.isin("mmol/L", "mEq/L") & common.isin("mmol/L", "mEq/L")
    rate = (lab == "gfr") & unit.isin("mL/min", "mL/min/1.73m2") & common.isin("mL/min", "mL/min/1.73m2")
    to_percent = (lab == "hba1c") & (unit == "mmol/mol") & (common == "%")
    to_mol = (lab == "hba1c") & (unit == "%") & (common == "mmol/mol")
    status = (
        F.when(unit.isNull() | common.isNull(), "missing_unit").when(same, "same_unit").when(mmol, "equivalent_mmol_meq").when(rate, "treated_as_equivalent_gfr_units")
        .when(to_percent, "converted_hba1c_to_percent").when(to_mol, "converted_hba1c_to_mmol_mol").when(factor.isNotNull(), "converted_by_factor").otherwise("unsupported_conversion")
    )
    out = (
        F.when(unit.isNull() | common.isNull(), None).when(same | mmol | rate, value).when(to_percent, 0.09148 * value + 2.152)
        .when(to_mol, (value - 2.15) * 10.929).otherwise(value * factor)
    )
    return out, status


def pressure_gate(value: Column, unit: Column) -> tuple[Column, Column]:
    """A pressure in mmHg or with no unit counts, in any other unit it doesn't; with the reason."""
    bare = F.lower(F.regexp_replace(strip(unit), r"[\s\[\]]+", ""))
    missing = ~present(unit, MISSING_UNITS)
    status = F.when(missing, "missing_assumed_mmHg").when(bare == "mmhg", "valid_mmHg").otherwise("invalid_bp_unit_value_set_missing")
    return F.when(missing | (bare == "mmhg"), value), status


def sex_female(c: Column) -> Column:
    """1 for female or f, with or without a prefix such as ``F.``; else 0."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^[^.]{0,3}\.\s*", "")
    return F.coalesce(bare.isin("female", "f").cast("int"), F.lit(0))


def binary(c: Column) -> Column:
    """Yes-like 1, no-like 0, numbers by being other than 0; null where neither."""
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("yes", "true", "y", "present"), 1).when(t.isin("no", "false", "n", "absent"), 0).otherwise((strict_number(t) != 0).cast("int"))


def broadcast_at(values: Column, i: Column) -> Column:
    """Element i; the only element of a list of one; else null."""
    return F.coalesce(F.get(values, i), F.when(F.size(values) == 1, F.get(values, F.lit(0))))


def clip(c: Column, bound: float) -> Column:
    """Between -bound and bound; null stays null (greatest and least skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(bound)), F.lit(-bound)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
