"""Queries against their SQL on the smallest tables, and the contract of the entry module."""

import math
from pathlib import Path

import pytest

from cohortloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
CHOSEN = ["code_frequency", "comorbidity_flags", "med_groups", "vitals_long", "nearest_match", "best_row", "median_impute", "unit_convert", "missingness_entities", "master_join", "scale_robust", "standardized_drivers", "cosine_knn", "ranking_scores", "stratified_folds", "p4_found"]
CHOSEN += ["series_per_entity", "vital_series", "lab_series", "day_sets", "drop_counters", "med_onehot", "med_long", "route_pivot", "category_flags", "unit_summary", "missingness_cohort", "feature_columns", "gower_spans", "pr_points", "averaged_scores", "mean_roc", "stratified_split", "stratified_sample", "corr_pairs", "cluster_multistat", "silhouette_metrics", "p4_observed"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(names), sorted(tuple(show(r[i]) for i in order) for r in rows)


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, str(DATA))
    cur = c.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), names)
