"""Queries on the cohort operators, each over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules as R
from ..operators import clusters, codes, evaluate, features, graph, learn, link, series, tables, wide
from ..session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LABS = ["creatinine", "gfr", "bun", "sodium", "potassium", "calcium", "glucose"]
ID = "PAT_MRN_ID_ENCRYPT"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# SQL fragments
def s_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def s_present(c: str, tokens) -> str:
    return f"coalesce(upper({s_strip(c)}) NOT IN ({quoted(tokens)}), false)"


def s_number(c: str, tokens=C.MISSING_LABS) -> str:
    return f"CASE WHEN {s_present(c, tokens)} THEN try_cast(nullif(regexp_extract(replace({s_strip(c)}, ',', ''), '[-+]?\\d*\\.?\\d+', 0), '') AS DOUBLE) END"


def s_strict(c: str) -> str:
    return f"CASE WHEN regexp_matches({s_strip(c)}, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') THEN try_cast({s_strip(c)} AS DOUBLE) END"


S_DX = f"(SELECT dx_row_id, {s_strip(ID)} AS id, CURRENT_ICD10_LIST AS cell, DX_NAME, DAYS_SINCE_DX_FRST_OBSRVD AS d FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)})"
S_CODES = f"""(SELECT id, DX_NAME, replace(x, '.', '') AS code FROM (SELECT id, DX_NAME, regexp_replace(upper(unnest(regexp_split_to_array(cell, '[;,|/]+'))), '\\s+', '', 'g') AS x FROM {S_DX})
  WHERE x NOT IN ({quoted(C.MISSING_DIAGNOSES)}) AND replace(x, '.', '') <> '')"""


def dx(spark: SparkSession, sf: str) -> DataFrame:
    return codes.valid_ids(t(spark, sf, "comorbidities"), ID, C.MISSING_DIAGNOSES).withColumnRenamed(ID, "id")


@query(
    f"""WITH c AS (SELECT DISTINCT id, substr(code, 1, 3) AS code FROM {S_CODES} WHERE length(code) >= 3), n AS (SELECT count(DISTINCT id) AS n FROM {S_DX})
SELECT code, count(*) AS n_entities, round(100.0 * count(*) / (SELECT n FROM n), 2) AS pct_of_entities, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM c GROUP BY code"""
)
def code_frequency(spark, sf):
    return codes.frequency(dx(spark, sf), "id", C.codes_3(F.col("CURRENT_ICD10_LIST")))


@query(
    f"""WITH c AS (SELECT code, label, count(*) AS n FROM (SELECT rid, substr(code, 1, 3) AS code, label FROM (SELECT dx_row_id AS rid, DX_NAME AS label, replace(x, '.', '') AS code FROM
  (SELECT dx_row_id, DX_NAME, regexp_replace(upper(unnest(regexp_split_to_array(cell, '[;,|/]+'))), '\\s+', '', 'g') AS x FROM {S_DX}) WHERE x NOT IN ({quoted(C.MISSING_DIAGNOSES)})) WHERE length(code) >= 3 AND label IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT code, label AS example FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, label) AS k FROM c) WHERE k = 1"""
)
def code_examples(spark, sf):
    return codes.frequency(dx(spark, sf), "id", C.codes_3(F.col("CURRENT_ICD10_LIST")), label=F.col("DX_NAME")).filter(F.col("example").isNotNull()).select("code", "example")


def s_flags(tests: dict[str, str], source: str) -> str:
    return "SELECT id, " + ", ".join(f"max(CASE WHEN {e} THEN 1 ELSE 0 END) AS {k}" for k, e in tests.items()) + f" FROM {source} GROUP BY id"


PREFIXES = {k: C.expand_prefixes(v) for k, v in R.DIAGNOSIS_PREFIXES.items()}
S_COMORB = s_flags({k: "regexp_matches(code, '^(" + "|".join(v) + ")')" for k, v in PREFIXES.items()}, f"(SELECT d.id, coalesce(c.code, '') AS code FROM (SELECT DISTINCT id FROM {S_DX}) d LEFT JOIN (SELECT DISTINCT id, code FROM {S_CODES}) c ON c.id = d.id)")


@query(S_COMORB)
def comorbidity_flags(spark, sf):
    c = C.codes_no_dot(F.col("CURRENT_ICD10_LIST"))
    return codes.flags(dx(spark, sf).select("id", c.alias("c")), "id", {k: C.any_prefix(F.col("c"), v) for k, v in PREFIXES.items()})


@query("SELECT flag, round(100 * m, 1) AS prevalence_pct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS flag, avg({k}) AS m FROM f" for k in PREFIXES) + ")".replace("", ""))
def flag_prevalence(spark, sf):
    return codes.prevalence(comorbidity_flags(spark, sf), list(PREFIXES))


ORACLES["flag_prevalence"] = f"WITH f AS ({S_COMORB}) " + ORACLES["flag_prevalence"]


@query(f"SELECT code FROM ({ORACLES['code_frequency']}) WHERE round_even(pct_of_entities, 0) >= 20")
def top_code_select(spark, sf):
    top = codes.top_codes(code_frequency(spark, sf))
    return spark.createDataFrame([(c,) for c in top], "code string")


@query(f"WITH c AS (SELECT DISTINCT id, substr(code, 1, 3) AS code FROM {S_CODES} WHERE length(code) >= 3) SELECT DISTINCT id, substr(code, 1, n) AS category FROM c, (VALUES (1), (2)) v(n)")
def category_flags(spark, sf):
    """Categories of all codes that occur, by a mapping with one column for each level: chapter letter and block."""
    found = dx(spark, sf).select(F.explode(C.codes_3(F.col("CURRENT_ICD10_LIST"))).alias("code")).distinct()
    mapping = found.select("code", F.substring("code", 1, 1).alias("level_1"), F.substring("code", 1, 2).alias("level_2"))
    return codes.category_flags(dx(spark, sf), "id", C.codes_3(F.col("CURRENT_ICD10_LIST")), tables.explode_categories(mapping, "code", "level"))


@query(
    f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT {s_present('CURRENT_ICD10_LIST', C.MISSING_DIAGNOSES)}) AS rows_missing,
count(DISTINCT CASE WHEN {s_present(ID, C.MISSING_DIAGNOSES)} AND NOT {s_present('CURRENT_ICD10_LIST', C.MISSING_DIAGNOSES)} THEN {s_strip(ID)} END) AS entities_missing FROM comorbidities"""
)
def code_missing_summary(spark, sf):
    gone, valid = ~C.present(F.col("CURRENT_ICD10_LIST"), C.MISSING_DIAGNOSES), C.present(F.col(ID), C.MISSING_DIAGNOSES)
    return t(spark, sf, "comorbidities").agg(F.count("*").alias("n_rows"), F.count_if(gone).alias("rows_missing"), F.countDistinct(F.when(valid & gone, C.strip(F.col(ID)))).alias("entities_missing"))


S_MEDS = f"(SELECT {s_strip(ID)} AS id, lower(concat_ws(' ', SIMPLE_GENERIC, MEDICATION_NAME)) AS x, {s_strip('SIMPLE_GENERIC')} AS generic, PHARMACEUTICAL_SUBCLASS AS sub, ORDER_STATUS AS status FROM hypertension_medications_20250417 WHERE {s_present(ID, C.MISSING_MEDS)})"


def meds(spark: SparkSession, sf: str) -> DataFrame:
    return codes.valid_ids(t(spark, sf, "hypertension_medications_20250417"), ID, C.MISSING_MEDS).withColumnRenamed(ID, "id")


@query(
    f"""WITH m AS (SELECT DISTINCT id, generic FROM {S_MEDS} WHERE {s_present('generic', C.MISSING_MEDS)}), n AS (SELECT count(DISTINCT id) AS n FROM {S_MEDS})
SELECT generic AS code, count(*) AS n_entities, round(100.0 * count(*) / (SELECT n FROM n), 2) AS pct_of_entities, row_number() OVER (ORDER BY count(*) DESC, generic) AS rank FROM m GROUP BY generic"""
)
def med_frequency(spark, sf):
    g = C.strip(F.col("SIMPLE_GENERIC"))
    return codes.frequency(meds(spark, sf), "id", F.when(C.present(g, C.MISSING_MEDS), F.array(g)))


@query(s_flags({k: "(" + " OR ".join(f"contains(x, '{w}')" for w in v) + ")" for k, v in R.DRUG_GROUPS.items()}, S_MEDS))
def med_groups(spark, sf):
    x = F.lower(F.concat_ws(" ", "SIMPLE_GENERIC", "MEDICATION_NAME"))
    return codes.flags(meds(spark, sf).select("id", x.alias("x")), "id", {k: C.contains_any(F.col("x"), v) for k, v in R.DRUG_GROUPS.items()})


@query(
    f"SELECT id, trim(regexp_replace(lower(sub), '[^0-9a-z]+', '_', 'g'), '_') AS subclass, count(*) AS n FROM {S_MEDS} WHERE {s_present('sub', C.MISSING_MEDS)} GROUP BY ALL"
)
def med_subclass(spark, sf):
    """The long form of the one-hot pivot per subclass: what a pivot over unbounded subclasses is made from."""
    return meds(spark, sf).filter(C.present(F.col("PHARMACEUTICAL_SUBCLASS"), C.MISSING_MEDS)).groupBy("id", C.slug(F.col("PHARMACEUTICAL_SUBCLASS")).alias("subclass")).agg(F.count("*").alias("n"))


@query(
    f"WITH m AS (SELECT id, CASE WHEN {s_present('sub', C.MISSING_MEDS)} THEN 'sub_' || trim(regexp_replace(lower(sub), '[^0-9a-z]+', '_', 'g'), '_') ELSE 'sub_missing' END AS subclass FROM {S_MEDS}) PIVOT m ON subclass USING count(DISTINCT subclass) GROUP BY id"
)
def med_onehot(spark, sf):
    """A 0/1 column for every drug subclass that occurs, one row per patient."""
    found = C.present(F.col("PHARMACEUTICAL_SUBCLASS"), C.MISSING_MEDS)
    named = F.when(found, F.concat(F.lit("sub_"), C.slug(F.col("PHARMACEUTICAL_SUBCLASS")))).otherwise("sub_missing")
    return codes.found_flags(meds(spark, sf).select("id", named.alias("subclass")), "id", "subclass")


@query(
    f"""SELECT med_row_id, {s_strip(ID)} AS id, {s_strip('SIMPLE_GENERIC')} AS generic, {s_strip('MEDICATION_NAME')} AS name, {s_strip('PHARMACEUTICAL_SUBCLASS')} AS subclass, upper({s_strip('MED_ADMIN_ROUTE')}) AS route, upper({s_strip('ORDER_STATUS')}) AS status,
round_even({s_strict('ORD_DAYS_SINCE_DX_FRST_OBSRVD')}, 0)::INT AS ordered_day FROM hypertension_medications_20250417 WHERE {s_present(ID, C.MISSING_MEDS)} AND coalesce(upper({s_strip('ORDER_STATUS')}) NOT IN ('CANCELED', 'CANCELLED', 'DISCONTINUED'), true)"""
)
def med_long(spark, sf):
    """The long export: every order that wasn't cancelled or discontinued."""
    s = F.upper(C.strip(F.col("ORDER_STATUS")))
    kept = meds(spark, sf).filter(F.coalesce(~s.isin("CANCELED", "CANCELLED", "DISCONTINUED"), F.lit(True)))
    return kept.select(
        "med_row_id", "id", C.strip(F.col("SIMPLE_GENERIC")).alias("generic"), C.strip(F.col("MEDICATION_NAME")).alias("name"), C.strip(F.col("PHARMACEUTICAL_SUBCLASS")).alias("subclass"),
        F.upper(C.strip(F.col("MED_ADMIN_ROUTE"))).alias("route"), s.alias("status"), C.day_number(F.col("ORD_DAYS_SINCE_DX_FRST_OBSRVD")).alias("ordered_day"),
    )


@query(
    f"WITH m AS (SELECT {s_strip(ID)} AS id, CASE WHEN {s_present('MED_ADMIN_ROUTE', C.MISSING_MEDS)} THEN 'route_' || trim(regexp_replace(lower(MED_ADMIN_ROUTE), '[^0-9a-z]+', '_', 'g'), '_') ELSE 'route_missing' END AS route FROM hypertension_medications_20250417 WHERE {s_present(ID, C.MISSING_MEDS)}) PIVOT m ON route USING count(DISTINCT route) GROUP BY id"
)
def route_pivot(spark, sf):
    """A 0/1 column for every route that occurs, one row per patient."""
    named = F.when(C.present(F.col("MED_ADMIN_ROUTE"), C.MISSING_MEDS), F.concat(F.lit("route_"), C.slug(F.col("MED_ADMIN_ROUTE")))).otherwise("route_missing")
    return codes.found_flags(meds(spark, sf).select("id", named.alias("route")), "id", "route")


@query(f"SELECT upper({s_strip('status')}) AS status, count(*) AS n, count(DISTINCT id) AS n_entities FROM {S_MEDS} WHERE coalesce(upper({s_strip('status')}) NOT IN ('CANCELED', 'CANCELLED', 'DISCONTINUED'), true) GROUP BY 1")
def med_status_clean(spark, sf):
    s = F.upper(C.strip(F.col("ORDER_STATUS")))
    kept = meds(spark, sf).filter(F.coalesce(~s.isin("CANCELED", "CANCELLED", "DISCONTINUED"), F.lit(True)))
    return kept.groupBy(s.alias("status")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_entities"))


S_CLASS = "CASE " + " ".join(
    "WHEN (" + " OR ".join(f"contains(upper(FLO_MEAS_NAME), '{w}')" for w in inc) + ")" + (" AND NOT (" + " OR ".join(f"contains(upper(FLO_MEAS_NAME), '{w}')" for w in exc) + ")" if exc else "") + f" THEN '{k}'"
    for k, (inc, exc) in R.VITAL_RULES.items()
) + " END"
S_LONG = f"""(WITH v AS (SELECT vital_row_id AS row_id, {s_strip(ID)} AS id, {S_CLASS} AS cls, MEAS_VALUE AS m, UNITS AS unit, round_even({s_strict('MEAS_DAYS_SINCE_DX_FRST_OBSRVD')}, 0)::INT AS day FROM hypertension_vitals_20250520 WHERE {s_present(ID, C.MISSING_VITALS)}),
p AS (SELECT *, CASE WHEN contains(m, '/') THEN split_part(m, '/', 1) ELSE m END AS m1, CASE WHEN contains(m, '/') THEN substr(m, instr(m, '/') + 1) END AS m2,
  nullif(regexp_extract(m, '(\\d+)\\s*''\\s*(\\d*\\.?\\d*)', 1), '')::DOUBLE AS ft, coalesce(try_cast(nullif(regexp_extract(m, '(\\d+)\\s*''\\s*(\\d*\\.?\\d*)', 2), '') AS DOUBLE), 0) AS inch FROM v WHERE cls IS NOT NULL),
l AS (SELECT row_id, id, 'bp_systolic' AS vital, day, {s_number('m1', C.MISSING_VITALS)} AS value, unit FROM p WHERE cls = 'bp'
 UNION ALL SELECT row_id, id, 'bp_diastolic', day, {s_number('m2', C.MISSING_VITALS)}, unit FROM p WHERE cls = 'bp'
 UNION ALL SELECT row_id, id, 'height', day, coalesce(ft * 12 + inch, {s_number('m', C.MISSING_VITALS)}), unit FROM p WHERE cls = 'height'
 UNION ALL SELECT row_id, id, cls, day, {s_number('m', C.MISSING_VITALS)}, unit FROM p WHERE cls NOT IN ('bp', 'height'))
SELECT * FROM l WHERE value IS NOT NULL AND day IS NOT NULL)"""


S_PARSED = S_LONG.replace("SELECT * FROM l WHERE value IS NOT NULL AND day IS NOT NULL)", "SELECT * FROM l)")


@query(f"SELECT vital, count(*) AS n_kept, count(*) FILTER (WHERE value IS NULL) AS n_no_value, count(*) FILTER (WHERE day IS NULL) AS n_no_day, count(*) FILTER (WHERE value IS NOT NULL AND day IS NOT NULL) AS n_usable FROM {S_PARSED} GROUP BY vital")
def drop_counters(spark, sf):
    return series.drop_counters(series.parsed_vitals(t(spark, sf, "hypertension_vitals_20250520")), "vital")


def long_vitals(spark: SparkSession, sf: str) -> DataFrame:
    return series.long_vitals(t(spark, sf, "hypertension_vitals_20250520"))


@query(f"SELECT vital, count(*) AS n, count(DISTINCT id) AS n_entities, min(value) AS min_value, max(value) AS max_value, round(sum(value), 3) AS sum_value, min(day) AS first_day, max(day) AS last_day FROM {S_LONG} GROUP BY vital")
def vitals_long(spark, sf):
    return long_vitals(spark, sf).groupBy("vital").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_entities"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round(F.sum("value"), 3).alias("sum_value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    f"""SELECT cls, name, n FROM (SELECT {S_CLASS} AS cls, upper({s_strip('FLO_MEAS_NAME')}) AS name, count(*) AS n, row_number() OVER (PARTITION BY {S_CLASS} ORDER BY count(*) DESC, upper({s_strip('FLO_MEAS_NAME')})) AS k
FROM hypertension_vitals_20250520 WHERE {S_CLASS} IS NOT NULL GROUP BY 1, 2) WHERE k <= 4"""
)
def first_match_classify(spark, sf):
    from pyspark.sql import Window

    v = t(spark, sf, "hypertension_vitals_20250520").select(C.first_match(F.col("FLO_MEAS_NAME"), R.VITAL_RULES).alias("cls"), F.upper(C.strip(F.col("FLO_MEAS_NAME"))).alias("name"))
    n = v.filter("cls IS NOT NULL").groupBy("cls", "name").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "name"))).filter("k <= 4").drop("k")


MULTI = {"weight": (["WEIGHT", " WT"], []), "height": (["HEIGHT", " HT"], []), "bp": (["BP", "BLOOD", "SYSTOLIC"], []), "pressure": (["PRESSURE"], []), "goal": (["GOAL"], [])}


@query("SELECT cls, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS cls FROM hypertension_vitals_20250520 WHERE " + " OR ".join(f"contains(upper(FLO_MEAS_NAME), '{w}')" for w in inc) for k, (inc, _) in MULTI.items()) + ") GROUP BY cls")
def multi_match_classify(spark, sf):
    return t(spark, sf, "hypertension_vitals_20250520").select(F.explode(C.all_matches(F.col("FLO_MEAS_NAME"), MULTI)).alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n_rows, count({s_number('MEAS_VALUE')}) AS n_numbers, count({s_strict('MEAS_VALUE')}) AS n_strict, round(sum({s_number('MEAS_VALUE')}), 2) AS sum_numbers FROM hypertension_vitals_20250520")
def numeric_parse(spark, sf):
    n = C.to_number(F.col("MEAS_VALUE"))
    return t(spark, sf, "hypertension_vitals_20250520").agg(F.count("*").alias("n_rows"), F.count(n).alias("n_numbers"), F.count(C.strict_number(F.col("MEAS_VALUE"))).alias("n_strict"), F.round(F.sum(n), 2).alias("sum_numbers"))


@query(f"SELECT id, vital, string_agg(day::VARCHAR || ':' || round(value, 2)::VARCHAR, ',' ORDER BY day, row_id) AS series, count(*) AS n FROM {S_LONG} GROUP BY ALL")
def series_per_entity(spark, sf):
    s = series.collect_series(long_vitals(spark, sf), ["id", "vital"], ["day", "row_id"], "value")
    return s.select("id", "vital", shown_series().alias("series"), F.col("n").cast("long").alias("n"))


def shown_series():
    return F.array_join(F.transform(F.arrays_zip("days", "values"), lambda x: F.concat(x["days"].cast("string"), F.lit(":"), F.round(x["values"], 2).cast("string"))), ",")


@query(f"SELECT vital, count(DISTINCT id) AS n_entities, round(100.0 * count(DISTINCT id) / (SELECT count(DISTINCT id) FROM {S_LONG}), 2) AS pct FROM {S_LONG} GROUP BY vital")
def series_coverage(spark, sf):
    long = long_vitals(spark, sf)
    return series.coverage(long, "id", "vital", long.select("id").distinct().count())


S_LABS = "(" + " UNION ALL ".join(
    f"SELECT lab_row_id AS row_id, {s_strip(ID)} AS id, '{n}' AS lab, i - 1 AS pos, CASE WHEN i <= len({n}_days) THEN {n}_days[i] WHEN len({n}_days) = 1 THEN {n}_days[1] END AS day, {n}_value[i] AS value, {n}_unit AS unit FROM labs_by_patient, unnest(range(1, len({n}_value) + 1)) AS u(i)"
    for n in LABS
) + ")"


def long_labs(spark: SparkSession, sf: str) -> DataFrame:
    return series.long_labs(t(spark, sf, "labs_by_patient"), LABS)


@query(f"SELECT lab, count(*) AS n, count(day) AS n_days, round(sum(value), 3) AS sum_value, sum(pos)::BIGINT AS sum_pos FROM {S_LABS} GROUP BY lab")
def labs_long(spark, sf):
    return long_labs(spark, sf).groupBy("lab").agg(F.count("*").alias("n"), F.count("day").alias("n_days"), F.round(F.sum("value"), 3).alias("sum_value"), F.sum("pos").alias("sum_pos"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS lab, count(*) AS n_rows, count(*) FILTER (WHERE len({n}_value) NOT IN (0, 1) AND len({n}_value) <> len({n}_days)) AS n_mismatched FROM labs_by_patient" for n in LABS))
def length_mismatch(spark, sf):
    return series.mismatched_lengths(t(spark, sf, "labs_by_patient"), LABS)


@query(
    f"""WITH l AS (SELECT id, vital, string_agg(day::VARCHAR || ':' || round(value, 2)::VARCHAR, ',' ORDER BY day, row_id) AS series FROM {S_LONG} GROUP BY ALL),
u AS (SELECT id, vital, unit FROM (SELECT id, vital, unit, row_number() OVER (PARTITION BY id, vital ORDER BY n DESC, unit) AS k FROM (SELECT id, vital, {s_strip('unit')} AS unit, count(*) AS n FROM {S_LONG} WHERE {s_present('unit', C.MISSING_UNITS)} GROUP BY ALL)) WHERE k = 1)
SELECT id, vital, series, unit FROM l LEFT JOIN u USING (id, vital)"""
)
def vital_series(spark, sf):
    """Every patient's series of every vital with the unit most of its readings name."""
    s = series.with_units(long_vitals(spark, sf), ["id", "vital"], ["day", "row_id"], "value", F.when(C.present(F.col("unit"), C.MISSING_UNITS), C.strip(F.col("unit"))))
    return s.select("id", "vital", shown_series().alias("series"), "unit")


S_LAB_SERIES = f"""(WITH v AS (SELECT * FROM {S_LABS} WHERE {s_present('id', C.MISSING_LINK)} AND day IS NOT NULL AND value IS NOT NULL),
l AS (SELECT id, lab, string_agg(day::VARCHAR || ':' || round(value, 2)::VARCHAR, ',' ORDER BY day, row_id, pos) AS series FROM v GROUP BY ALL),
u AS (SELECT id, lab, unit FROM (SELECT id, lab, unit, row_number() OVER (PARTITION BY id, lab ORDER BY n DESC, unit) AS k FROM (SELECT id, lab, {s_strip('unit')} AS unit, count(*) AS n FROM v WHERE {s_present('unit', C.MISSING_UNITS)} GROUP BY ALL)) WHERE k = 1)
SELECT id, lab, series, unit FROM l LEFT JOIN u USING (id, lab))"""


@query("SELECT id, " + ", ".join(f"max(CASE WHEN lab = '{n}' THEN series END) AS {n}_series, max(CASE WHEN lab = '{n}' THEN unit END) AS {n}_unit" for n in LABS) + f" FROM {S_LAB_SERIES} GROUP BY id")
def lab_series(spark, sf):
    """One row per patient: days and values of every lab, and the unit most of its values have."""
    long = valid_labs(spark, sf).filter(F.col("day").isNotNull() & F.col("value").isNotNull())
    each = series.with_units(long, ["id", "lab"], ["day", "row_id", "pos"], "value", F.when(C.present(F.col("unit"), C.MISSING_UNITS), C.strip(F.col("unit"))))
    wide_ = series.wide_series(each, "id", "lab", LABS)
    shown = lambda n: F.array_join(F.transform(F.arrays_zip(F.col(f"{n}_days").alias("days"), F.col(f"{n}_value").alias("values")), lambda x: F.concat(x["days"].cast("string"), F.lit(":"), F.round(x["values"], 2).cast("string"))), ",")
    return wide_.select("id", *[c for n in LABS for c in (shown(n).alias(f"{n}_series"), F.col(f"{n}_unit"))])


S_DAYS = f"(SELECT dx_row_id, id, round_even({s_strict('d')}, 0)::INT AS dx_day FROM {S_DX} WHERE {s_strict('d')} IS NOT NULL)"


def dx_days(spark: SparkSession, sf: str) -> DataFrame:
    return dx(spark, sf).select("dx_row_id", "id", C.day_number(F.col("DAYS_SINCE_DX_FRST_OBSRVD")).alias("dx_day")).filter("dx_day IS NOT NULL")


def valid_labs(spark: SparkSession, sf: str) -> DataFrame:
    return long_labs(spark, sf).filter(C.present(F.col("id"), C.MISSING_LINK))


S_PAIRS = f"(SELECT x.*, l.row_id, l.lab, l.pos, l.day, l.value, l.unit FROM {S_DAYS} x JOIN {S_LABS} l ON l.id = x.id AND abs(l.day - x.dx_day) <= 15 WHERE {s_present('l.id', C.MISSING_LINK)})"


@query(f"SELECT lab, count(*) AS n, count(DISTINCT dx_row_id) AS n_dx, sum(abs(day - dx_day))::BIGINT AS sum_distance FROM {S_PAIRS} GROUP BY lab")
def range_match(spark, sf):
    m = link.range_match(dx_days(spark, sf), valid_labs(spark, sf), "id", "dx_day", "day", 15)
    return m.groupBy("lab").agg(F.count("*").alias("n"), F.countDistinct("dx_row_id").alias("n_dx"), F.sum(F.abs(F.col("day") - F.col("dx_day"))).alias("sum_distance"))


S_NEAR = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dx_row_id, lab ORDER BY abs(day - dx_day), day > dx_day, row_id, pos) AS k FROM {S_PAIRS}) WHERE k = 1)"


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return link.nearest_match(dx_days(spark, sf), valid_labs(spark, sf), "id", "dx_row_id", "lab", "dx_day", "day", ["row_id", "pos"], ["value", "unit", "row_id", "pos"], 15)


@query(f"SELECT dx_row_id, id, dx_day, lab, day, value, row_id, pos FROM {S_NEAR}")
def nearest_match(spark, sf):
    return nearest(spark, sf).select("dx_row_id", "id", "dx_day", "lab", "day", "value", "row_id", F.col("pos").cast("long").alias("pos"))


S_BEST = f"(SELECT id, lab, day, value, unit, dx_row_id FROM (SELECT *, row_number() OVER (PARTITION BY id, lab ORDER BY abs(day - dx_day), day DESC, dx_row_id) AS k2 FROM {S_NEAR}) WHERE k2 = 1)"


def best(spark: SparkSession, sf: str) -> DataFrame:
    return wide.best_row(nearest(spark, sf), ["id", "lab"], F.abs(F.col("day") - F.col("dx_day")), "day", ["dx_row_id"], ["day", "value", "unit", "dx_row_id"])


@query(f"SELECT id, lab, day, value, dx_row_id FROM {S_BEST}")
def best_row(spark, sf):
    return best(spark, sf).select("id", "lab", "day", "value", "dx_row_id")


S_WIDE = "(SELECT id, " + ", ".join(f"max(CASE WHEN lab = '{n}' THEN value END) AS {n}_value" for n in LABS) + f" FROM {S_BEST} GROUP BY id)"
VALUES = [f"{n}_value" for n in LABS]


def labs_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide.pivot_values(best(spark, sf), "id", "lab", "value", LABS)


@query("SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in VALUES) + f" FROM {S_WIDE}")
def wide_pivot(spark, sf):
    return labs_wide(spark, sf).select("id", *[F.round(c, 6).alias(c) for c in VALUES])


@query(
    f"WITH w AS {S_WIDE} SELECT id, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM w)), 6) AS {c}, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing_before" for c in VALUES) + " FROM w"
)
def median_impute(spark, sf):
    out = wide.impute_median(labs_wide(spark, sf), VALUES)
    return out.select("id", *[x for c in VALUES for x in (F.round(c, 6).alias(c), F.col(f"{c}_missing_before"))])


@query(
    f"WITH w AS {S_WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS measure, count(*) AS total, count({c}) AS with_value, count(*) - count({c}) AS missing_before, round(median({c}), 6) AS median_used, CASE WHEN count({c}) = 0 THEN count(*) ELSE 0 END AS missing_after FROM w" for c in VALUES)
)
def imputation_summary(spark, sf):
    return wide.imputation_summary(labs_wide(spark, sf), VALUES).withColumn("median_used", F.round("median_used", 6))


S_MISS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in VALUES)


@query(f"SELECT id, {S_MISS} AS n_missing, round(100.0 * ({S_MISS}) / {len(VALUES)}, 2) AS pct_missing FROM {S_WIDE}")
def missing_by_entity(spark, sf):
    return wide.missing_per_entity(labs_wide(spark, sf), "id", VALUES)


@query(f"SELECT id, vital, string_agg(DISTINCT day::VARCHAR, ',' ORDER BY day::VARCHAR) AS days FROM {S_LONG} GROUP BY ALL")
def day_sets(spark, sf):
    return long_vitals(spark, sf).groupBy("id", "vital").agg(F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ",").alias("days"))


S_UNIT_KEY = "lower(regexp_replace(translate({0}, 'µμ²', 'uu2'), '\\s+', '', 'g'))"
S_UNIT = "CASE WHEN " + s_present("unit", C.MISSING_UNITS) + " THEN CASE " + S_UNIT_KEY.format(s_strip("unit")) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LAB_UNITS.items()) + f" ELSE {s_strip('unit')} END END"


@query(
    f"""WITH l AS (SELECT id, lab, {S_UNIT} AS u FROM {S_LABS}), c AS (SELECT lab, u, count(*) AS n FROM l WHERE u IS NOT NULL GROUP BY ALL),
m AS (SELECT lab, u, n FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY n DESC, u) AS k FROM c) WHERE k = 1),
b AS (SELECT lab, count(*) AS total_rows, count(DISTINCT id) AS total_entities, count(*) FILTER (WHERE u IS NULL) AS rows_empty_unit, count(DISTINCT CASE WHEN u IS NULL THEN id END) AS entities_empty_unit FROM l GROUP BY lab)
SELECT lab, total_rows, total_entities, rows_empty_unit, entities_empty_unit, round(100.0 * entities_empty_unit / total_entities, 4) AS percent_empty_unit, m.u AS most_common_unit, m.n AS most_common_unit_rows, h.all_units_seen FROM b LEFT JOIN m USING (lab) LEFT JOIN (SELECT lab, string_agg(u || '=' || n, ';' ORDER BY u || '=' || n) AS all_units_seen FROM c GROUP BY lab) h USING (lab)"""
)
def unit_summary(spark, sf):
    return wide.unit_summary(long_labs(spark, sf), "lab", "id", C.lab_unit(F.col("unit")))


COMMON = {"creatinine": "mg/dL", "gfr": "mL/min/1.73m2", "bun": "mg/dL", "sodium": "mmol/L", "potassium": "mmol/L", "calcium": "mg/dL", "glucose": "mg/dL"}
S_FACTOR = "CASE " + " ".join(f"WHEN lab = '{m}' AND u = '{a}' AND c = '{b}' THEN {f!r}" for m, a, b, f in C.LAB_FACTORS) + " END"
S_CONV = f"""(SELECT *, CASE WHEN u IS NULL OR c IS NULL THEN 'missing_unit' WHEN u = c THEN 'same_unit' WHEN lab IN ('sodium', 'potassium') AND u IN ('mmol/L', 'mEq/L') AND c IN ('mmol/L', 'mEq/L') THEN 'equivalent_mmol_meq'
 WHEN lab = 'gfr' AND u IN ('mL/min', 'mL/min/1.73m2') THEN 'treated_as_equivalent_gfr_units' WHEN f IS NOT NULL THEN 'converted_by_factor' ELSE 'unsupported_conversion' END AS status FROM (SELECT *, {S_FACTOR} AS f FROM
 (SELECT l.*, {S_UNIT} AS u, m.c FROM {S_LABS} l JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in COMMON.items())}) m(lab, c) USING (lab))))"""


def common_units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMON.items()), "lab string, common_unit string")


@query(
    f"SELECT lab, status AS conversion_status, count(*) AS n, count(CASE WHEN status NOT IN ('missing_unit', 'unsupported_conversion') THEN value END) AS n_converted, round(sum(CASE WHEN status IN ('same_unit', 'equivalent_mmol_meq', 'treated_as_equivalent_gfr_units') THEN value WHEN status = 'converted_by_factor' THEN value * f END), 2) AS sum_value FROM {S_CONV} GROUP BY ALL"
)
def unit_convert(spark, sf):
    c = wide.converted(long_labs(spark, sf), "lab", C.lab_unit(F.col("unit")), common_units(spark))
    return c.groupBy("lab", "conversion_status").agg(F.count("*").alias("n"), F.count("value_common").alias("n_converted"), F.round(F.sum("value_common"), 2).alias("sum_value"))


@query(f"SELECT status AS issue_type, lab, u AS from_unit, c AS to_unit, count(*) AS n FROM {S_CONV} WHERE status IN ('missing_unit', 'unsupported_conversion') GROUP BY ALL")
def conversion_issues(spark, sf):
    c = wide.converted(long_labs(spark, sf), "lab", C.lab_unit(F.col("unit")), common_units(spark)).filter(F.col("conversion_status").isin("missing_unit", "unsupported_conversion"))
    return c.groupBy(F.col("conversion_status").alias("issue_type"), "lab", F.col("unit_norm").alias("from_unit"), F.col("common_unit").alias("to_unit")).agg(F.count("*").alias("n"))


S_GATE = f"CASE WHEN NOT {s_present('unit', C.MISSING_UNITS)} THEN 'missing_assumed_mmHg' WHEN lower(regexp_replace({s_strip('unit')}, '[\\s\\[\\]]+', '', 'g')) = 'mmhg' THEN 'valid_mmHg' ELSE 'invalid_bp_unit_value_set_missing' END"


@query(f"SELECT vital, {S_GATE} AS status, count(*) AS n, count(CASE WHEN {S_GATE} <> 'invalid_bp_unit_value_set_missing' THEN value END) AS n_kept FROM {S_LONG} WHERE vital LIKE 'bp%' GROUP BY ALL")
def pressure_unit_gate(spark, sf):
    value, status = C.pressure_gate(F.col("value"), F.col("unit"))
    return long_vitals(spark, sf).filter("vital LIKE 'bp%'").select("vital", status.alias("status"), value.alias("v")).groupBy("vital", "status").agg(F.count("*").alias("n"), F.count("v").alias("n_kept"))


PROFILED = ["CURRENT_ICD10_LIST", "DX_NAME", "PATIENT_AGE", "SEX", "RACE", "LANGUAGE", "DISCHARGE_DISPOSITION"]


def s_kinds(c: str) -> str:
    blank, text = f"coalesce({s_strip(c)} = '', false)", f"coalesce(upper({s_strip(c)}) IN ({quoted(C.MISSING_TEXT)}), false)"
    return f"({c} IS NULL) AS k_null, {blank} AS k_blank, {text} AS k_text, ({c} IS NULL OR {blank} OR {text}) AS k_any"


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE k_null) AS n_null, count(*) FILTER (WHERE k_blank) AS n_blank, count(*) FILTER (WHERE k_text) AS n_text, count(*) FILTER (WHERE k_any) AS n_any, round(100.0 * count(*) FILTER (WHERE k_any) / count(*), 4) AS pct_any, count(DISTINCT CASE WHEN k_any THEN {ID} END) AS entities_any FROM (SELECT {ID}, {s_kinds(c)} FROM comorbidities)"
        for c in PROFILED
    )
)
def missingness_rows(spark, sf):
    return tables.missing_rows(t(spark, sf, "comorbidities"), PROFILED, ID)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_entities, sum(a)::BIGINT AS any_missing, sum(b)::BIGINT AS all_missing, sum(1 - b)::BIGINT AS any_present FROM (SELECT id, max(k_any::INT) AS a, min(k_any::INT) AS b FROM (SELECT {s_strip(ID)} AS id, {s_kinds(c)} FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)}) GROUP BY id)"
        for c in PROFILED
    )
)
def missingness_entities(spark, sf):
    return tables.missing_entities(dx(spark, sf), "id", PROFILED)


MED_COLUMNS = ["SIMPLE_GENERIC", "MEDICATION_NAME", "MED_ADMIN_ROUTE", "PHARMACEUTICAL_SUBCLASS", "ORDER_STATUS"]


@query(
    f"WITH cohort AS (SELECT DISTINCT {s_strip(ID)} AS id FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)}), n AS (SELECT count(*) AS n FROM cohort) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT n FROM n) AS n_cohort, count(*) AS with_rows, (SELECT n FROM n) - count(*) AS without_rows, sum(a)::BIGINT AS any_null, sum(b)::BIGINT AS any_blank, sum(x)::BIGINT AS any_text, sum(y)::BIGINT AS any_missing, sum(z)::BIGINT AS only_missing, round(100.0 * sum(y) / (SELECT n FROM n), 4) AS pct_any "
        f"FROM (SELECT id, max(k_null::INT) AS a, max(k_blank::INT) AS b, max(k_text::INT) AS x, max(k_any::INT) AS y, min(k_any::INT) AS z FROM (SELECT {s_strip(ID)} AS id, {s_kinds(c)} FROM hypertension_medications_20250417 WHERE {s_present(ID, C.MISSING_MEDS)}) WHERE id IN (SELECT id FROM cohort) GROUP BY id)"
        for c in MED_COLUMNS
    )
)
def missingness_cohort(spark, sf):
    """Patients of the diagnosis cohort by how their medication rows lack each column, those without rows counted too."""
    return tables.missing_in_cohort(meds(spark, sf), dx(spark, sf).select("id"), "id", MED_COLUMNS)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE NOT k_any) AS n_present, count(*) FILTER (WHERE NOT k_any AND v IS NOT NULL) AS n_numeric, round(coalesce(count(*) FILTER (WHERE NOT k_any AND v IS NOT NULL) / nullif(count(*) FILTER (WHERE NOT k_any), 0)::DOUBLE, 0), 6) AS share FROM (SELECT {s_strict(c)} AS v, {s_kinds(c)} FROM comorbidities)"
        for c in PROFILED + ["DAYS_SINCE_DX_FRST_OBSRVD"]
    )
)
def numeric_shares(spark, sf):
    return features.numeric_shares(t(spark, sf, "comorbidities"), [*PROFILED, "DAYS_SINCE_DX_FRST_OBSRVD"])


DROPPED = ("_LIST", "_NAME", "_DISPOSITION")


@query(f"SELECT column_name FROM (\0) WHERE share >= 0.8 AND NOT (" + " OR ".join(f"ends_with(column_name, '{x}')" for x in DROPPED) + ")")
def feature_columns(spark, sf):
    """Columns left after those with certain suffixes and those with few numbers are dropped."""
    names = features.without_suffixes([*PROFILED, "DAYS_SINCE_DX_FRST_OBSRVD"], DROPPED)
    return spark.createDataFrame([(c,) for c in features.mostly_numeric(t(spark, sf, "comorbidities"), names)], "column_name string")


ORACLES["feature_columns"] = ORACLES["feature_columns"].replace("\0", ORACLES["numeric_shares"])


def s_category(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {s_strip(c)} = '' OR upper({s_strip(c)}) IN ({quoted(C.MISSING_TEXT)}) THEN 'Missing' ELSE {s_strip(c)} END"


@query(f"SELECT {s_category('RACE')} AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM comorbidities), 4) AS pct FROM comorbidities GROUP BY 1")
def category_counts(spark, sf):
    return tables.category_counts(t(spark, sf, "comorbidities"), F.col("RACE"))


@query(f"SELECT category, by_value, n, round(100.0 * n / sum(n) OVER (PARTITION BY category), 4) AS pct FROM (SELECT {s_category('LANGUAGE')} AS category, {s_category('SEX')} AS by_value, count(*) AS n FROM comorbidities GROUP BY 1, 2)")
def category_by_sex(spark, sf):
    return tables.category_counts(t(spark, sf, "comorbidities"), F.col("LANGUAGE"), F.col("SEX"))


NUMERIC = ["PATIENT_AGE", "DAYS_SINCE_DX_FRST_OBSRVD"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n, count(v) AS n_numeric, count(*) FILTER (WHERE v IS NULL AND NOT k_any) AS n_other, count(*) FILTER (WHERE v = 0) AS n_zero, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value, median(round_even(v, 0)) AS median_value FROM (SELECT {s_strict(c)} AS v, {s_kinds(c)} FROM comorbidities)"
        for c in NUMERIC
    )
)
def numeric_profile(spark, sf):
    return tables.numeric_profile(t(spark, sf, "comorbidities"), NUMERIC)


@query(
    f"""SELECT count(*) AS n_entities, count(*) FILTER (WHERE n > 0) AS any_numeric, count(*) FILTER (WHERE n = 0) AS no_numeric, count(*) FILTER (WHERE z > 0) AS any_zero, count(*) FILTER (WHERE n > 0 AND z = n) AS only_zero, count(*) FILTER (WHERE o) AS any_other
FROM (SELECT id, count(v) AS n, count(*) FILTER (WHERE v = 0) AS z, bool_or(v IS NULL AND NOT k_any) AS o FROM (SELECT {s_strip(ID)} AS id, {s_strict('PATIENT_AGE')} AS v, {s_kinds('PATIENT_AGE')} FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)}) GROUP BY id)"""
)
def age_quality(spark, sf):
    return tables.age_quality(dx(spark, sf), "id", "PATIENT_AGE")


S_FEM = f"CASE WHEN regexp_replace(lower({s_strip('SEX')}), '^[^.]{{0,3}}\\.\\s*', '') IN ('female', 'f') THEN 1 ELSE 0 END"


@query(
    f"SELECT sex_female, language, count(*) AS n_entities FROM (SELECT id, max(f) AS sex_female, min(CASE WHEN k = 1 THEN l END) AS language FROM (SELECT id, f, l, row_number() OVER (PARTITION BY id ORDER BY n DESC, l) AS k FROM (SELECT id, max(f) AS f, l, count(*) AS n FROM (SELECT {s_strip(ID)} AS id, {S_FEM} AS f, {s_category('LANGUAGE')} AS l FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)}) GROUP BY id, l)) GROUP BY id) GROUP BY ALL"
)
def resolved_category(spark, sf):
    d = dx(spark, sf).withColumns({"f": C.sex_female(F.col("SEX")), "l": F.when(C.missing_kinds(F.col("LANGUAGE"))["any"], "Missing").otherwise(C.strip(F.col("LANGUAGE")))})
    per = d.groupBy("id").agg(F.max("f").alias("sex_female")).join(series.modal(d, ["id"], F.col("l"), "language"), "id")
    return per.groupBy("sex_female", "language").agg(F.count("*").alias("n_entities"))


S_IDS = {n: f"SELECT DISTINCT {s_strip(ID)} AS id FROM {n} WHERE {s_present(ID, C.MISSING_DIAGNOSES)}" for n in ("comorbidities", "hypertension_medications_20250417", "labs_by_patient", "hypertension_vitals_20250520")}


def ids(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return codes.valid_ids(t(spark, sf, name), ID, C.MISSING_DIAGNOSES).select(F.col(ID).alias("id")).distinct()


@query(" INTERSECT ".join(S_IDS.values()))
def id_intersection(spark, sf):
    return tables.common_ids([ids(spark, sf, n) for n in S_IDS], "id")


@query(f"{S_IDS['comorbidities']} EXCEPT {S_IDS['labs_by_patient']}")
def anti_unmatched(spark, sf):
    return ids(spark, sf, "comorbidities").join(ids(spark, sf, "labs_by_patient"), "id", "left_anti")


@query(f"SELECT count(*) AS n FROM {S_MEDS} WHERE id IN (SELECT {s_strip(ID)} FROM master_clustering_ready)")
def semi_filter(spark, sf):
    return meds(spark, sf).join(t(spark, sf, "master_clustering_ready").select(C.strip(F.col(ID)).alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


S_FIRST = f"(SELECT id, SEX, RACE, ETHNICITY FROM (SELECT {s_strip(ID)} AS id, SEX, RACE, ETHNICITY, row_number() OVER (PARTITION BY {s_strip(ID)} ORDER BY dx_row_id) AS k FROM comorbidities WHERE {s_present(ID, C.MISSING_DIAGNOSES)}) WHERE k = 1)"


@query(f"SELECT * FROM {S_FIRST}")
def first_demographics(spark, sf):
    return tables.first_rows(dx(spark, sf), "id", ["dx_row_id"], ["SEX", "RACE", "ETHNICITY"])


@query(
    f"SELECT f.id, d.SEX, d.RACE, f.has_ckd, f.has_diabetes, g.med_statin, g.med_arb, w.creatinine_value FROM ({S_COMORB}) f JOIN ({ORACLES['med_groups']}) g USING (id) JOIN {S_WIDE} w USING (id) LEFT JOIN {S_FIRST} d USING (id)"
)
def master_join(spark, sf):
    chain = tables.inner_chain([comorbidity_flags(spark, sf), med_groups(spark, sf), labs_wide(spark, sf)], "id").join(first_demographics(spark, sf), "id", "left")
    return chain.select("id", "SEX", "RACE", "has_ckd", "has_diabetes", "med_statin", "med_arb", "creatinine_value")


@query(
    f"SELECT m.id, l.SEX AS sex_label FROM (SELECT {s_strip(ID)} AS id FROM master_clustering_ready) m JOIN (SELECT id, SEX FROM (SELECT id, SEX, row_number() OVER (PARTITION BY id ORDER BY n DESC, SEX) AS k FROM (SELECT {s_strip(ID)} AS id, SEX, count(*) AS n FROM comorbidities WHERE SEX IS NOT NULL GROUP BY ALL)) WHERE k = 1) l USING (id)"
)
def m1_join_mode(spark, sf):
    m = t(spark, sf, "master_clustering_ready").select(C.strip(F.col(ID)).alias("id"))
    labels = t(spark, sf, "comorbidities").filter("SEX IS NOT NULL").select(C.strip(F.col(ID)).alias("id"), F.col("SEX").alias("sex_label"))
    return tables.join_labels(m, labels, "id", "sex_label", on_duplicate="mode")


CONT = [f"{c}_value" for c in ("creatinine", "bun", "sodium", "potassium", "calcium", "glucose")]
BIN = ["has_heart_failure", "has_ckd", "has_copd", "has_E11", "med_statin", "SEX_FEMALE"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN bool_and({c} IN (0, 1) OR {c} IS NULL) THEN 'binary' ELSE 'continuous' END AS role, count({c}) AS n_present, CASE WHEN min({c}) < max({c}) THEN 0 ELSE 1 END AS is_constant FROM master_clustering_ready" for c in BIN + CONT))
def role_inference(spark, sf):
    return features.roles(t(spark, sf, "master_clustering_ready"), BIN + CONT)


def _scaled(spark, sf, kind):
    return features.scale(t(spark, sf, "master_clustering_ready").select(ID, *CONT), CONT, kind).select(F.col(ID).alias("id"), *[F.round(c, 6).alias(c) for c in CONT])


def s_scaled(centre: str, spread: str) -> str:
    return f"SELECT {ID} AS id, " + ", ".join(f"round(({c} - (SELECT {centre.format(c)} FROM master_clustering_ready)) / coalesce(nullif((SELECT {spread.format(c)} FROM master_clustering_ready), 0), 1), 6) AS {c}" for c in CONT) + " FROM master_clustering_ready"


@query(s_scaled("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query(s_scaled("avg({0})", "stddev_pop({0})"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query(s_scaled("min({0})", "max({0}) - min({0})"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("SELECT " + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::DOUBLE AS {c}_missing" for c in CONT) + " FROM master_clustering_ready")
def missing_indicators(spark, sf):
    df = features.indicators(t(spark, sf, "master_clustering_ready"), CONT)
    return df.agg(*[(F.sum(f"{c}_missing") if f"{c}_missing" in df.columns else F.lit(0.0)).alias(f"{c}_missing") for c in CONT])


PAIRED = CONT + BIN


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS r FROM master_clustering_ready" for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :]))
def corr_pairs(spark, sf):
    return features.correlations(t(spark, sf, "master_clustering_ready"), PAIRED).withColumn("r", F.round("r", 6))


@query(
    "WITH RECURSIVE p AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM master_clustering_ready" for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :]) + ") WHERE abs(r) >= 0.5), "
    "o AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, a, b) AS k FROM p), w(k, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT o.k, CASE WHEN list_contains(w.gone, o.a) OR list_contains(w.gone, o.b) THEN w.gone ELSE list_append(w.gone, o.b) END FROM w JOIN o ON o.k = w.k + 1) "
    f"SELECT c AS kept FROM (SELECT unnest([{quoted(PAIRED)}]) AS c) WHERE NOT list_contains((SELECT gone FROM w ORDER BY k DESC LIMIT 1), c)"
)
def corr_filter(spark, sf):
    kept, _ = features.correlation_filter(t(spark, sf, "master_clustering_ready"), PAIRED, 0.5)
    return spark.createDataFrame([(c,) for c in kept], "kept string")


@query(f"SELECT id, " + ", ".join(f"CASE WHEN sx = '{v}' THEN 1 ELSE 0 END AS sx_{v}" for v in ("Male", "Female")) + f", {S_FEM.replace('SEX', 'sx')} AS sex_female FROM (SELECT id, SEX AS sx FROM {S_FIRST})")
def one_hot(spark, sf):
    f = first_demographics(spark, sf).select("id", F.col("SEX").alias("sx"))
    return features.one_hot(f, "sx", ["Male", "Female"]).withColumn("sex_female", C.sex_female(F.col("sx"))).drop("sx")


S_LABEL = "CASE WHEN has_heart_failure = 1 THEN 0 WHEN has_ckd = 1 THEN 1 WHEN has_copd = 1 THEN 2 WHEN has_E11 = 1 THEN 3 ELSE 4 END"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "master_clustering_ready").withColumn("cluster", F.expr(S_LABEL))


@query(f"SELECT {S_LABEL} AS cluster, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM master_clustering_ready), 4) AS pct FROM master_clustering_ready GROUP BY 1")
def cluster_sizes(spark, sf):
    return clusters.sizes(labelled(spark, sf), "cluster")


@query(
    " UNION ALL ".join(
        f"SELECT {S_LABEL} AS cluster, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS sd, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM master_clustering_ready GROUP BY 1" for c in CONT
    )
)
def cluster_multistat(spark, sf):
    return clusters.profile(labelled(spark, sf), "cluster", CONT)


S_VALUES = "(" + " UNION ALL ".join(f"SELECT {S_LABEL} AS cluster, '{c}' AS feature, {c}::DOUBLE AS v FROM master_clustering_ready" for c in CONT + BIN) + ")"


def s_drivers(diff: str) -> str:
    return f"""WITH g AS (SELECT cluster, feature, avg(v) AS gm FROM {S_VALUES} GROUP BY ALL), o AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM {S_VALUES} GROUP BY 1), d AS (SELECT cluster, feature, {diff} AS difference FROM g JOIN o USING (feature)),
r AS (SELECT *, 100 * abs(difference) / sum(abs(difference)) OVER (PARTITION BY cluster) AS driver_pct, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(difference), 9) DESC, feature) AS rnk FROM d)
SELECT cluster, rnk::INT AS rnk, feature, round(difference, 6) AS difference, round(driver_pct, 6) AS driver_pct, CASE WHEN difference >= 0 THEN 'higher' ELSE 'lower' END AS direction FROM r WHERE rnk <= 5"""


@query(s_drivers("(gm - m) / s"))
def standardized_drivers(spark, sf):
    return clusters.drivers(labelled(spark, sf), "cluster", CONT + BIN, 5)


@query(s_drivers("gm - m"))
def raw_drivers(spark, sf):
    return clusters.drivers(labelled(spark, sf), "cluster", CONT + BIN, 5, standardized=False)


@query(f"SELECT cluster, n, n_flag, round(100.0 * n_flag / n, 4) AS prevalence_pct, round(100.0 * n_flag / sum(n_flag) OVER (), 4) AS share_pct FROM (SELECT {S_LABEL} AS cluster, count(*) AS n, sum(has_I10)::BIGINT AS n_flag FROM master_clustering_ready GROUP BY 1)")
def flag_prevalence_by_cluster(spark, sf):
    return clusters.flag_share(labelled(spark, sf), "cluster", F.col("has_I10"))


@query("SELECT count(*) FILTER (WHERE abs((creatinine_value - m) / s) > 2) AS n_clipped FROM master_clustering_ready, (SELECT avg(creatinine_value) AS m, stddev_pop(creatinine_value) AS s FROM master_clustering_ready)")
def winsorize_count(spark, sf):
    z = features.scale(t(spark, sf, "master_clustering_ready"), ["creatinine_value"], "standard")
    return z.agg(F.count_if(C.clip(F.col("creatinine_value"), 2.0) != F.col("creatinine_value")).alias("n_clipped"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


S_CENTRES = "(SELECT vec_id AS c, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 5))"


def first_five(spark: SparkSession, sf: str) -> list[tuple]:
    """Five given centres: the vectors of the smallest ids, a parameter of the query, not a part of its input."""
    return [(r[0], r[1]) for r in embeddings(spark, sf).orderBy("vec_id").limit(5).select("vec_id", "x").collect()]


@query(f"SELECT vec_id, c AS label, round(d, 6) AS distance FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), c) AS k FROM (SELECT vec_id, c, list_distance(embedding::DOUBLE[], y) AS d FROM embeddings, {S_CENTRES})) WHERE k = 1")
def nearest_centroid(spark, sf):
    out = clusters.assign_nearest(embeddings(spark, sf), first_five(spark, sf), "vec_id", "x", lambda a, b: F.sqrt(clusters.squared_distance(a, b)))
    return out.withColumn("distance", F.round("distance", 6))


GOWER = ["has_ckd", "has_copd", "SEX_FEMALE"]
GOWER_NUM = {"creatinine_value": (0.5, 6.0), "sodium_value": (125.0, 155.0)}
MEDOIDS = [(0, [0.0, 0.0, 0.0, 1.0, 140.0]), (1, [1.0, 0.0, 1.0, 3.0, 138.0]), (2, [0.0, 1.0, 0.0, 0.9, 137.0])]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 6) AS low, round(quantile_cont({c}, 0.99), 6) AS high, round(coalesce(nullif(quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01), 0), 1), 6) AS span FROM master_clustering_ready" for c in CONT))
def gower_spans(spark, sf):
    return features.quantile_spans(t(spark, sf, "master_clustering_ready"), CONT).select("feature", *[F.round(c, 6).alias(c) for c in ("low", "high", "span")])


def s_gower(m: list[float]) -> str:
    parts = [f"CASE WHEN {c} <> {v} THEN 1.0 ELSE 0.0 END" for c, v in zip(GOWER, m)]
    parts += [f"least(1.0, abs(least(greatest(coalesce({c}, {lo}), {lo}), {hi}) - {v}) / {hi - lo})" for (c, (lo, hi)), v in zip(GOWER_NUM.items(), m[len(GOWER) :])]
    return f"round(({' + '.join(parts)}) / {len(m)}, 9)"


@query(
    f"SELECT id, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS k FROM (" + " UNION ALL ".join(f"SELECT {ID} AS id, {i} AS label, {s_gower(m)} AS distance FROM master_clustering_ready" for i, m in MEDOIDS) + ")) WHERE k = 1"
)
def gower_assign(spark, sf):
    x = F.array(*[F.col(c).cast("double") for c in GOWER], *[F.least(F.greatest(F.coalesce(F.col(c), F.lit(lo)), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in GOWER_NUM.items()])
    spans = [None] * len(GOWER) + [hi - lo for lo, hi in GOWER_NUM.values()]
    points = t(spark, sf, "master_clustering_ready").select(F.col(ID).alias("id"), x.alias("x"))
    return clusters.assign_nearest(points, MEDOIDS, "id", "x", lambda a, b: clusters.gower(a, b, spans))


S_KNN = "(SELECT q, vec_id, similarity, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, vec_id) AS k FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE k <= 10)"


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return clusters.exact_neighbours(e, e.filter("vec_id % 50 = 0"), "vec_id", "x", 10)


@query(f"SELECT q, vec_id, round(similarity, 6) AS similarity, k::INT AS rnk FROM {S_KNN}")
def cosine_knn(spark, sf):
    """Ten nearest of all vectors for the stated query set."""
    return neighbours(spark, sf).select("q", "vec_id", F.round("similarity", 6).alias("similarity"), "rnk")


def all_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of all vectors, exact at any size."""
    e = embeddings(spark, sf)
    return clusters.exact_neighbours(e, e, "vec_id", "x", 10)


S_GRAPH = S_KNN.replace(" WHERE a.vec_id % 50 = 0", "")


@query(f"WITH e AS (SELECT q AS a, vec_id AS b FROM {S_GRAPH}), s AS (SELECT a, list(b) AS s FROM e GROUP BY a) SELECT e.a, e.b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE, 6) AS jaccard FROM e JOIN s x ON x.a = e.a JOIN s y ON y.a = e.b")
def jaccard_graph(spark, sf):
    near = all_neighbours(spark, sf).select(F.col("q").alias("a"), F.col("vec_id").alias("b"))
    return clusters.shared_neighbours(near).withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""WITH e AS (SELECT DISTINCT least(q, vec_id) AS a, greatest(q, vec_id) AS b FROM {S_GRAPH}), l AS (SELECT x.label AS la, y.label AS lb FROM e JOIN embeddings x ON x.vec_id = e.a JOIN embeddings y ON y.vec_id = e.b),
m AS (SELECT count(*)::DOUBLE AS m FROM l), d AS (SELECT label, sum(w) AS d, sum(i) AS i FROM (SELECT la AS label, 1 AS w, CASE WHEN la = lb THEN 1 ELSE 0 END AS i FROM l UNION ALL SELECT lb, 1, 0 FROM l) GROUP BY 1)
SELECT round(sum(i / m - (d / (2 * m)) ** 2), 6) AS modularity, round(max(m), 6) AS total_weight FROM d, m"""
)
def graph_modularity(spark, sf):
    e = clusters.undirected(all_neighbours(spark, sf).select(F.col("q").alias("a"), F.col("vec_id").alias("b"))).withColumn("w", F.lit(1.0))
    return clusters.modularity(e, embeddings(spark, sf).select(F.col("vec_id").alias("id"), "label"))


@query(
    """WITH d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT i, min(CASE WHEN li = lj THEN d END) AS a, min(CASE WHEN li <> lj THEN d END) AS b FROM d GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM s"""
)
def silhouette_exact(spark, sf):
    e = embeddings(spark, sf)
    return clusters.silhouette(e, e, "vec_id", "x", "label")


S_METRICS = {
    "cosine": "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "manhattan": "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2])))",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM (SELECT i, min(CASE WHEN li = lj THEN d END) AS a, min(CASE WHEN li <> lj THEN d END) AS b FROM
        (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg({d}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL) GROUP BY i)"""
        for m, d in S_METRICS.items()
    )
)
def silhouette_metrics(spark, sf):
    e = embeddings(spark, sf)
    each = [clusters.silhouette(e, e, "vec_id", "x", "label", m).select(F.lit(m).alias("metric"), "silhouette", "n") for m in S_METRICS]
    return each[0].unionByName(each[1])


def group_validity(spark, sf):
    """Davies-Bouldin and Calinski-Harabasz of the given labels."""
    groups, centre, n, _ = clusters.dispersion(embeddings(spark, sf), "x", "label", 64)
    return spark.createDataFrame([(round(clusters.davies_bouldin(groups), 6), round(clusters.calinski_harabasz(groups, centre, n), 6))], "davies_bouldin double, calinski_harabasz double")


query(
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), o AS (SELECT i, avg(v) AS m FROM e GROUP BY i),
p AS (SELECT e.vec_id, e.label, sum((v - c.m) ** 2) AS d2 FROM e JOIN c USING (label, i) GROUP BY ALL), s AS (SELECT label, count(*) AS n, avg(sqrt(d2)) AS s, sum(d2) AS w FROM p GROUP BY label),
b AS (SELECT c.label, sum((c.m - o.m) ** 2) AS d2 FROM c JOIN o USING (i) GROUP BY 1), x AS (SELECT a.label AS la, z.label AS lb, sqrt(sum((a.m - z.m) ** 2)) AS d FROM c a JOIN c z ON a.i = z.i AND a.label <> z.label GROUP BY ALL),
r AS (SELECT la, max((sa.s + sb.s) / d) AS r FROM x JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)
SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((SELECT sum(s.n * b.d2) / (count(*) - 1) FROM s JOIN b USING (label)) / (SELECT sum(w) / (sum(n) - count(*)) FROM s), 6) AS calinski_harabasz"""
)(group_validity)


@query(
    """WITH t AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL), ij AS (SELECT sum(n * (n - 1) / 2.0) AS v, sum(n) AS n FROM t), a AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((ij.v - a.v * b.v / (ij.n * (ij.n - 1) / 2.0)) / ((a.v + b.v) / 2 - a.v * b.v / (ij.n * (ij.n - 1) / 2.0)), 6) AS ari FROM ij, a, b"""
)
def ari_contingency(spark, sf):
    return clusters.adjusted_rand(embeddings(spark, sf).withColumn("other", F.col("vec_id") % 10), "label", "other")


@query()
def ami_contingency(spark, sf):
    e = embeddings(spark, sf).withColumn("other", F.col("vec_id") % 10)
    return spark.createDataFrame([(round(clusters.adjusted_mutual_information(e, "label", "other"), 6),)], "ami double")


S_PRED = "(SELECT has_heart_failure AS truth, CASE WHEN med_diuretic = 1 AND med_beta_blocker = 1 THEN 1 ELSE 0 END AS predicted, coalesce(bun_value, 0) AS score, SEX_FEMALE AS sex FROM master_clustering_ready)"


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "master_clustering_ready").select(
        F.col("has_heart_failure").alias("truth"), F.expr("CASE WHEN med_diuretic = 1 AND med_beta_blocker = 1 THEN 1 ELSE 0 END").alias("predicted"), F.coalesce("bun_value", F.lit(0.0)).alias("score"), F.col("SEX_FEMALE").alias("sex")
    )


@query(f"SELECT truth AS true_class, count(*) FILTER (WHERE predicted = 0) AS pred_0, count(*) FILTER (WHERE predicted = 1) AS pred_1 FROM {S_PRED} GROUP BY truth")
def confusion_matrix(spark, sf):
    return evaluate.confusion(predicted(spark, sf), "truth", "predicted", [0, 1])


S_PRF = f"""(SELECT "class", support, predicted, round(coalesce(hit / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * hit / nullif(support + predicted, 0)::DOUBLE, 0), 6) AS f1
FROM (SELECT "class", sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hit FROM (SELECT truth AS "class", 1 AS t, 0 AS p, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS h FROM {S_PRED} UNION ALL SELECT predicted, 0, 1, 0 FROM {S_PRED}) GROUP BY 1))"""


@query(f"SELECT * FROM {S_PRF}")
def prf_report(spark, sf):
    return evaluate.report(predicted(spark, sf), "truth", "predicted")


@query(f"SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 4) AS balanced_accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM {S_PRF}")
def classification_summary(spark, sf):
    return evaluate.summary(predicted(spark, sf), "truth", "predicted")


S_CURVE = f"(SELECT sex, score AS threshold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY sex) AS pos, sum(q) OVER (PARTITION BY sex) AS neg FROM (SELECT sex, score, sum(truth) AS p, sum(1 - truth) AS q FROM {S_PRED} GROUP BY ALL) WINDOW w AS (PARTITION BY sex ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"SELECT sex, round(sum(q * (tp - p / 2.0)) / (max(pos) * max(neg)::DOUBLE), 6) AS auroc, round(sum(p * tp / (tp + fp)::DOUBLE) / max(pos), 6) AS auprc, round(max(pos) / (max(pos) + max(neg))::DOUBLE, 6) AS prevalence, (max(pos) + max(neg))::BIGINT AS n FROM {S_CURVE} GROUP BY sex")
def ranking_scores(spark, sf):
    return evaluate.ranking_scores(predicted(spark, sf), ["sex"], "score", F.col("truth") == 1)


@query(f"SELECT sex, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / pos::DOUBLE, 6) AS tpr, round(fp / neg::DOUBLE, 6) AS fpr FROM {S_CURVE}")
def roc_points(spark, sf):
    c = evaluate.curve(predicted(spark, sf), ["sex"], "score", F.col("truth") == 1)
    return c.select("sex", "threshold", "tp", "fp", F.round(C.ratio(F.col("tp"), F.col("pos")), 6).alias("tpr"), F.round(C.ratio(F.col("fp"), F.col("neg")), 6).alias("fpr"))


@query(f"SELECT sex, threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / pos::DOUBLE, 6) AS recall FROM {S_CURVE}")
def pr_points(spark, sf):
    return evaluate.precision_points(predicted(spark, sf), ["sex"], "score", F.col("truth") == 1)


CLASS_SCORES = {"0": "bun_value", "1": "creatinine_value", "2": "glucose_value", "3": "potassium_value", "4": "sodium_value"}
S_REST = "(" + " UNION ALL ".join(f"SELECT '{c}' AS cls, coalesce({v}, 0)::DOUBLE AS score, CASE WHEN {S_LABEL} = {c} THEN 1 ELSE 0 END AS y FROM master_clustering_ready" for c, v in CLASS_SCORES.items()) + ")"


def s_run(source: str) -> str:
    return f"(SELECT cls, score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY cls) AS pos, sum(q) OVER (PARTITION BY cls) AS neg FROM (SELECT cls, score, sum(y) AS p, sum(1 - y) AS q FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def s_area(source: str) -> str:
    return f"(SELECT cls, round(sum(q * (tp - p / 2.0)) / (max(pos) * max(neg)::DOUBLE), 6) AS auroc, round(sum(p * tp / (tp + fp)::DOUBLE) / max(pos), 6) AS auprc FROM {s_run(source)} WHERE pos > 0 AND neg > 0 GROUP BY cls)"


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("cluster", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in CLASS_SCORES.values()])


@query(f"SELECT 'macro' AS average, round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc FROM {s_area(S_REST)} UNION ALL SELECT 'micro', auroc, auprc FROM {s_area(f'(SELECT 0 AS cls, score, y FROM {S_REST})')}")
def averaged_scores(spark, sf):
    return evaluate.averaged_scores(class_scores(spark, sf), "cluster", CLASS_SCORES)


@query(
    f"""WITH c AS (SELECT cls, fp / neg::DOUBLE AS x, max(tp / pos::DOUBLE) AS y FROM {s_run(S_REST)} WHERE pos > 0 AND neg > 0 GROUP BY ALL), o AS (SELECT cls, x, y FROM c UNION ALL SELECT cls, 0.0, 0.0 FROM c GROUP BY cls HAVING min(x) > 0),
g AS (SELECT cls, i, i / 1000.0 AS pt FROM (SELECT DISTINCT cls FROM c), (SELECT unnest(range(1001)) AS i)),
lo AS (SELECT g.cls, i, max(pt) AS pt, max(x) AS x0, arg_max(y, x) AS y0 FROM g JOIN o ON o.cls = g.cls AND o.x <= pt + 1e-12 GROUP BY ALL), hi AS (SELECT g.cls, i, min(x) AS x1, arg_min(y, x) AS y1 FROM g JOIN o ON o.cls = g.cls AND o.x >= pt - 1e-12 GROUP BY ALL)
SELECT round(i / 1000.0, 6) AS fpr, round(avg(CASE WHEN x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) * (pt - x0) / (x1 - x0) END), 6) AS tpr FROM lo JOIN hi USING (cls, i) GROUP BY i"""
)
def mean_roc(spark, sf):
    return evaluate.mean_curve(class_scores(spark, sf), "cluster", CLASS_SCORES)


S_HASH = "SELECT {k}, {s}, row_number() OVER (PARTITION BY {s} ORDER BY ({k}::HUGEINT * 2654435761 + 42) % 4294967296, {k}) AS rnk, count(*) OVER (PARTITION BY {s}) AS n FROM {t}"


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN rnk <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM (" + S_HASH.format(k="o_orderkey", s="o_orderpriority", t="orders") + ")")
def stratified_split(spark, sf):
    return tables.split(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"])


@query("SELECT o_orderkey, o_orderpriority FROM (" + S_HASH.format(k="o_orderkey", s="o_orderpriority", t="orders") + ") WHERE rnk <= greatest(1, round(n * (2000.0 / (SELECT count(*) FROM orders))))")
def stratified_sample(spark, sf):
    """About 2,000 orders, each priority in proportion: a sampling operator."""
    return tables.stratified_sample(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"], 2000)


@query("SELECT o_orderkey, o_orderpriority, (rnk % 5)::INT AS fold FROM (" + S_HASH.format(k="o_orderkey", s="o_orderpriority", t="orders") + ")")
def stratified_folds(spark, sf):
    return tables.folds(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", ["o_orderpriority"])


@query(
    "SELECT k, share, round(sum(share) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM (SELECT row_number() OVER (ORDER BY v DESC, f) AS k, round(v / sum(v) OVER (), 6) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS f, var_pop({c}) AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + "))"
)
def cumulative_variance(spark, sf):
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    from pyspark.sql import Window

    v = t(spark, sf, "lineitem").agg(*[F.var_pop(c).alias(c) for c in names]).unpivot([], list(names), "f", "v")
    ranked = v.select(F.row_number().over(Window.orderBy(F.desc("v"), "f")).cast("long").alias("k"), F.round(F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0))), 6).alias("share"))
    return features.cumulative(ranked, "share", "k").withColumn("cumulative", F.round("cumulative", 6))


@query("SELECT s_nationkey, p_type, count(DISTINCT l_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def star_join(spark, sf):
    l = t(spark, sf, "lineitem").join(t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return l.groupBy("s_nationkey", "p_type").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT grp, count(*) AS n FROM (SELECT " + "CASE " + " ".join(f"WHEN starts_with(lower({s_strip('RACE')}), '{k}') THEN '{v}'" for k, v in R.RACE_GROUPS.items()) + " ELSE 'Unknown/Other' END AS grp FROM comorbidities) GROUP BY grp")
def race_groups(spark, sf):
    return t(spark, sf, "comorbidities").groupBy(C.race_group(F.col("RACE")).alias("grp")).agg(F.count("*").alias("n"))


@query(
    f"SELECT 'med_' || trim(regexp_replace(lower(code), '[^0-9a-z]+', '_', 'g'), '_') AS flag, code AS generic FROM ({ORACLES['med_frequency']}) WHERE round_even(pct_of_entities, 0) >= 3 AND NOT ("
    + " OR ".join(f"contains(lower(code), '{d}')" for many in R.DRUG_GROUPS.values() for d in many)
    + ") QUALIFY row_number() OVER (PARTITION BY 'med_' || trim(regexp_replace(lower(code), '[^0-9a-z]+', '_', 'g'), '_') ORDER BY code) = 1"
)
def standalone_meds(spark, sf):
    found = codes.standalone_meds(med_frequency(spark, sf), R.DRUG_GROUPS, 3)
    return spark.createDataFrame(list(found.items()), "flag string, generic string")


@query(
    f"SELECT cls AS class, count(*) AS n_rows, count(*) FILTER (WHERE k_null) AS n_null, count(*) FILTER (WHERE k_blank) AS n_blank, count(*) FILTER (WHERE k_text) AS n_text, count(*) FILTER (WHERE k_any) AS n_any FROM (SELECT {S_CLASS} AS cls, {s_kinds('MEAS_VALUE')} FROM hypertension_vitals_20250520) WHERE cls IS NOT NULL GROUP BY cls"
)
def vital_missing_rows(spark, sf):
    v = t(spark, sf, "hypertension_vitals_20250520")
    return tables.missing_by_class(v, C.first_match(F.col("FLO_MEAS_NAME"), R.VITAL_RULES), F.col("MEAS_VALUE"), ID)[0]


@query(
    f"SELECT cls AS class, count(*) AS with_rows, sum(1 - m)::BIGINT AS with_value, sum(m)::BIGINT AS only_missing FROM (SELECT id, cls, min(k_any::INT) AS m FROM (SELECT {s_strip(ID)} AS id, {S_CLASS} AS cls, {s_kinds('MEAS_VALUE')} FROM hypertension_vitals_20250520 WHERE {s_present(ID, C.MISSING_VITALS)}) WHERE cls IS NOT NULL GROUP BY ALL) GROUP BY cls"
)
def vital_missing_entities(spark, sf):
    v = codes.valid_ids(t(spark, sf, "hypertension_vitals_20250520"), ID, C.MISSING_VITALS)
    return tables.missing_by_class(v, C.first_match(F.col("FLO_MEAS_NAME"), R.VITAL_RULES), F.col("MEAS_VALUE"), ID)[1]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_ids FROM ({q})" for n, q in S_IDS.items()))
def unique_ids(spark, sf):
    out = [ids(spark, sf, n).agg(F.count("*").alias("n_ids")).select(F.lit(n).alias("table_name"), "n_ids") for n in S_IDS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    f"SELECT {S_LABEL} AS cluster, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM master_clustering_ready), 4) AS pct, " + ", ".join(f"round(100 * avg({c}), 4) AS {c}_pct" for c in BIN) + ", " + ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in CONT) + " FROM master_clustering_ready GROUP BY 1"
)
def cluster_profile(spark, sf):
    return clusters.merged_profile(labelled(spark, sf), "cluster", BIN, CONT)


# without SQL: iterative or trained


@query()
def pca_scores(spark, sf):
    scores, _ = features.principal_components(t(spark, sf, "master_clustering_ready").select(ID, *[F.col(c) for c in CONT + BIN]), ID, CONT + BIN, 5)
    return scores.select(F.col(ID).alias("id"), *[F.round(F.col("pc")[i], 6).alias(f"pc{i + 1}") for i in range(5)])


@query()
def pca_report(spark, sf):
    """The components that hold 85 % of the variance together, and the five features that load most on each."""
    loadings, shares = features.principal_loadings(t(spark, sf, "master_clustering_ready"), CONT + BIN)
    _, rows = features.component_report(loadings, shares, CONT + BIN)
    reached = [float(v) for v in np.cumsum(shares)]
    return spark.createDataFrame([(c, r, f, round(v, 6), round(shares[c - 1], 6), round(reached[c - 1], 6)) for c, r, f, v in rows], "component int, rnk int, feature string, loading double, share double, cumulative double")


@query()
def kmeans_best(spark, sf):
    labels, _ = learn.k_means(embeddings(spark, sf), "vec_id", "x", list(range(2, 11)), restarts=20)
    return labels


@query()
def gower_medoids(spark, sf):
    x = F.array(*[F.col(c).cast("double") for c in GOWER], *[F.least(F.greatest(F.coalesce(F.col(c), F.lit(lo)), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in GOWER_NUM.items()])
    spans = [None] * len(GOWER) + [hi - lo for lo, hi in GOWER_NUM.values()]
    return learn.gower_medoids(t(spark, sf, "master_clustering_ready").select(F.col(ID).alias("id"), x.alias("x")), "id", "x", spans, 4)[0]


@query()
def ward_groups(spark, sf):
    return learn.sampled_groups(embeddings(spark, sf), "vec_id", "x", "ward", k=5)


@query()
def density_groups(spark, sf):
    return learn.density_groups(embeddings(spark, sf), "vec_id", "x", least=10)


@query()
def density_report(spark, sf):
    """Rows, share and mean strength of each density group; -1 is noise."""
    d = density_groups(spark, sf)
    return clusters.sizes(d, "label").join(d.groupBy("label").agg(F.round(F.avg("strength"), 6).alias("strength")), "label")


@query()
def affinity_groups(spark, sf):
    return learn.sampled_groups(embeddings(spark, sf), "vec_id", "x", "affinity", quantile=0.1)


@query()
def forest_predictions(spark, sf):
    m = labelled(spark, sf)
    out, _ = learn.forest(m, ID, "cluster", [c for c in m.columns if c.startswith("med_")] + CONT, trees=20)
    return out.select(F.col(ID).alias("id"), "truth", "predicted")


@query()
def boosted_predictions(spark, sf):
    m = labelled(spark, sf)
    out, _ = learn.boosted(m, ID, "cluster", [c for c in m.columns if c.startswith("med_")] + CONT, rounds=10)
    return out.select(F.col(ID).alias("id"), "truth", "predicted")


@query()
def ward_sweep(spark, sf):
    rows = learn.ward_sweep(embeddings(spark, sf), "vec_id", "x", list(range(2, 9)))
    return spark.createDataFrame([(r["k"], round(r["silhouette"], 6), round(r["cophenetic"], 6)) for r in rows], "k int, silhouette double, cophenetic double")


@query()
def preference_sweep(spark, sf):
    """Affinity propagation at several preferences, on a sample of 500 rows at most (a parameter of the operator)."""
    rows = learn.preference_sweep(embeddings(spark, sf), "vec_id", "x", [0.01, 0.1, 0.5])
    return spark.createDataFrame([(r["quantile"], r["groups"], round(r["silhouette"], 6)) for r in rows], "quantile double, n_groups int, silhouette double")


def _fuzzy(spark, sf):
    near = all_neighbours(spark, sf).select(F.col("q").alias("a"), F.col("vec_id").alias("b"), (1 - F.col("similarity")).alias("d"))
    return graph.fuzzy_weights(near)


@query()
def fuzzy_graph(spark, sf):
    return _fuzzy(spark, sf).withColumn("w", F.round("w", 6))


@query()
def graph_communities(spark, sf):
    return graph.graph_communities(written(_fuzzy(spark, sf), "fuzzy"), least=10)


@query()
def community_stability(spark, sf):
    scores = graph.stability(written(_fuzzy(spark, sf), "fuzzy"), 3)
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "run int, ari double")


@query()
def stability_report(spark, sf):
    """Agreement of three other seeds with the first partition: mean, spread and least."""
    rows = graph.stability_report(written(_fuzzy(spark, sf), "fuzzy"), 3)
    return spark.createDataFrame([(r["score"], r["runs"], round(r["mean"], 6), round(r["sd"], 6), round(r["least"], 6)) for r in rows], "score string, runs int, mean double, sd double, least double")
