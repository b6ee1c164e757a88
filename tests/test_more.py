import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import clusters, codes, evaluate, features, graph, series, tables
from cohortloom.operators.quantiles import column_quantiles, exact_quantiles


@pytest.mark.parametrize("slices", [4, 64])
def test_exact_quantiles_against_numpy(spark, slices):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=501).round(2).tolist(), "b": [3.0] * 40, "c": [5.0], "d": rng.integers(0, 3, 100).astype(float).tolist(), None: [1.0, 2.0, 4.0, 9.0]}
    rows = [(k, v) for k, many in data.items() for v in many] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [r.q0, r.q1, r.q2, r.q3] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95], slices).collect()}
    assert set(got) == set(data)
    for k, many in data.items():
        assert got[k] == pytest.approx(np.quantile(many, [0.0, 0.25, 0.5, 0.95]).tolist()), k
    assert exact_quantiles(df.select("v"), [], "v", [0.5]).collect()[0].q0 == pytest.approx(np.median([v for m in data.values() for v in m]))
    assert column_quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


def test_scaling_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (100.0,), (None,)], "v double")
    assert [r.v for r in features.scale(df, ["v"], "standard", 1.0).collect()][3] is None


def test_ami_of_independent_and_equal_labels(spark):
    rows = [(i % 7, i // 7 % 5, i % 7 + 10) for i in range(3500)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert clusters.adjusted_mutual_information(df, "a", "c") == pytest.approx(1.0)
    assert abs(clusters.adjusted_mutual_information(df, "a", "b")) < 2e-3
    # against the sum over all overlaps
    x, y, n = 40, 70, 200
    g = math.lgamma
    whole = sum(k / n * math.log(n * k / (x * y)) * math.exp(g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1)) for k in range(1, 41))
    assert clusters._expected_overlap(x, y, n) == pytest.approx(whole)


def test_correlations_of_present_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, size=(200, 3))
    x[:, 1] += x[:, 0]
    x[::7, 2] = np.nan
    df = spark.createDataFrame([(float(a), float(b), None if np.isnan(c) else float(c), 1.0) for a, b, c in x], "a double, b double, c double, same double")
    got = {(r.feature_1, r.feature_2): r.r for r in features.correlations(df, ["a", "b", "c", "same"]).collect()}
    ok = ~np.isnan(x[:, 2])
    assert got[("a", "b")] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) and got[("a", "c")] == pytest.approx(np.corrcoef(x[ok, 0], x[ok, 2])[0, 1]) and len(got) == 3


def test_curve_in_slices_equals_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), float(np.round(rng.normal(), 2)) if i % 50 else None, int(rng.random() < 0.4)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, s double, y int")
    got = sorted((r.k, r.threshold is not None, r.threshold or 0.0, r.tp, r.fp, r.pos, r.neg) for r in evaluate.curve(df, ["k"], "s", F.col("y") == 1, slices=16).collect())
    want = []
    for k in (0, 1):
        mine = [(s, y) for a, s, y in rows if a == k]
        for s in {s for s, _ in mine}:
            above = [y for t, y in mine if s is None or (t is not None and t >= s)]
            want.append((k, s is not None, s or 0.0, sum(above), len(above) - sum(above), sum(y for _, y in mine), sum(1 - y for _, y in mine)))
    assert got == sorted(want)


def test_flags_found_and_refused(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "y"), ("r", None)], "id string, v string")
    assert {tuple(r) for r in codes.found_flags(df, "id", "v", "is_").collect()} == {("p", 1, 0), ("q", 0, 1), ("r", 0, 0)}
    with pytest.raises(ValueError, match="more than 1"):
        codes.found_flags(df, "id", "v", most=1)
    assert codes.found_flags(df.limit(0), "id", "v").columns == ["id"]


def test_series_with_units_side_by_side(spark):
    df = spark.createDataFrame([("p", "a", 2, 5.0, "mg"), ("p", "a", 1, 4.0, "mg"), ("p", "a", 3, 6.0, "g"), ("q", "b", 1, 1.0, None)], "id string, kind string, day int, value double, unit string")
    each = series.with_units(df, ["id", "kind"], ["day"], "value", F.col("unit"))
    out = {r.id: r for r in series.wide_series(each, "id", "kind", ["a", "b", "c"]).collect()}
    assert (out["p"].a_days, out["p"].a_value, out["p"].a_unit, out["p"].b_days) == ([1, 2, 3], [4.0, 5.0, 6.0], "mg", None) and (out["q"].b_value, out["q"].b_unit, out["q"].c_unit) == ([1.0], None, None)


def test_cohort_counts_those_without_rows(spark):
    cohort = spark.createDataFrame([("p",), ("q",), ("r",), ("r",)], "id string")
    rows = spark.createDataFrame([("p", None), ("p", "x"), ("q", " "), ("z", None)], "id string, c string")
    r = tables.missing_in_cohort(rows, cohort, "id", ["c"]).collect()[0]
    assert (r.n_cohort, r.with_rows, r.without_rows, r.any_null, r.any_blank, r.any_missing, r.only_missing) == (3, 2, 1, 1, 1, 2, 1)


def test_sample_keeps_proportions(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 10, 2)]) for i in range(1000)], "id long, s string")
    n = {r.s: r["count"] for r in tables.stratified_sample(df, "id", ["s"], 100).groupBy("s").count().collect()}
    assert n == {"a": 10, "b": 10, "c": 80}
    assert tables.stratified_sample(df.limit(0), "id", ["s"], 5).count() == 0


def test_columns_dropped_by_suffix_and_numbers(spark):
    df = spark.createDataFrame([("1", "x", None, "3"), ("2", "4", None, "n/a")], "a string, b string, c string, d_days string")
    assert features.without_suffixes(df.columns, ("_days",)) == ["a", "b", "c"]
    assert features.mostly_numeric(df, df.columns, 0.8) == ["a", "d_days"]


def test_component_report():
    n, rows = features.component_report(np.array([[0.9, 0.1], [-0.95, 0.2], [0.0, -0.97]]), [0.7, 0.3], ["x", "y", "z"], 0.85, 2)
    assert n == 2 and rows == [(1, 1, "y", 0.95), (1, 2, "x", -0.9), (2, 1, "z", 0.97), (2, 2, "y", -0.2)]
    assert features.component_report(np.array([[1.0, 0.0]]).T, [0.9], ["x", "y"])[0] == 1


def test_large_graphs_are_shrunk_first(spark):
    """Beyond the limits of the driver the communities are the same: twelve rings of dense blocks, weakly joined."""
    rng = np.random.default_rng(4)
    pairs = {(g * 20 + int(i), g * 20 + int(j)): 1.0 for g in range(12) for i, j in rng.integers(0, 20, (160, 2)) if i != j} | {(g * 20, (g + 1) % 12 * 20): 0.2 for g in range(12)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()], "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
    small = {r.id: r.label for r in graph.graph_communities(edges).collect()}
    large = {r.id: r.label for r in graph.graph_communities(edges, nodes=40, links=500).collect()}
    assert set(small) == set(large) == set(range(240))
    ids = sorted(small)
    x, y = np.array([small[i] for i in ids]), np.array([large[i] for i in ids])
    assert ((x[:, None] == x) == (y[:, None] == y)).mean() > 0.95 and len(set(y)) >= 10
    apart = spark.createDataFrame([(i * 2, i * 2 + 1, 1.0) for i in range(60)] + [(i * 2 + 1, i * 2, 1.0) for i in range(60)], "a long, b long, w double")
    labels = [r.label for r in graph.graph_communities(apart, nodes=10, links=10).collect()]
    assert len(labels) == 120 and len(set(labels)) == 60


def brute_silhouette(d, label):
    out = []
    for i in range(len(label)):
        mates = [j for j in range(len(label)) if label[j] == label[i] and j != i]
        others = [np.mean([d[i, j] for j in range(len(label)) if label[j] == g]) for g in set(label) if g != label[i]]
        out.append(0.0 if not mates or not others else (min(others) - np.mean(d[i, mates])) / max(min(others), np.mean(d[i, mates])))
    return float(np.mean(out))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "correlation"])
def test_silhouettes_against_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) + np.repeat(rng.normal(size=(4, 6)) * 2, 10, axis=0)
    label = [i // 10 for i in range(39)] + [9]
    far = {
        "euclidean": lambda a, b: np.linalg.norm(a - b), "manhattan": lambda a, b: np.abs(a - b).sum(),
        "cosine": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "correlation": lambda a, b: 1 - np.corrcoef(a, b)[0, 1],
    }[metric]
    d = np.array([[far(a, b) if a is not b else 0.0 for b in x] for a in x])
    want = brute_silhouette(d, label)
    df = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label))], "id int, x array<double>, label int")
    assert clusters.silhouette(df, df, "id", "x", "label", metric).collect()[0].silhouette == pytest.approx(want, abs=1e-6)
    assert clusters.silhouette_of(d, np.array(label)) == pytest.approx(want)
    assert clusters.silhouette_of(d[:0, :0], np.array([])) is None


def test_ward_tree_and_its_cophenetic_correlation(spark):
    from cohortloom.operators import learn

    x = np.array([[0.0], [1.0], [10.0], [12.0]])
    merges = learn.ward_merges(x)
    assert [(i, j) for i, j, _ in merges] == [(0, 1), (2, 3), (0, 2)] and merges[0][2] == pytest.approx(1.0) and merges[1][2] == pytest.approx(2.0)
    # joined heights: 1 within the first pair, 2 within the second, the rest at the top
    top = merges[2][2]
    want = np.corrcoef([1, 10, 12, 9, 11, 2], [1, top, top, top, top, 2])[0, 1]
    assert learn.cophenetic(x) == pytest.approx(want) and math.isnan(learn.cophenetic(x[:1]))
    df = spark.createDataFrame([(i, [float(v), 1.0]) for i, v in enumerate([0, 0.1, 5, 5.2, 9, 9.3])], "id int, x array<double>")
    sweep = {r["k"]: r["silhouette"] for r in learn.ward_sweep(df, "id", "x", [2, 3, 4])}
    assert max(sweep, key=sweep.get) == 3
    assert [r["quantile"] for r in learn.preference_sweep(df, "id", "x", [0.1, 0.5])] == [0.1, 0.5]


def test_boosting_learns_three_classes(spark):
    from cohortloom.operators import learn

    rng = np.random.default_rng(6)
    rows = [(i, "abc"[i % 3], float(rng.normal(i % 3 == 0, 0.2)), float(rng.normal(i % 3 == 1, 0.2)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, u double, v double, noise double")
    out, importance = learn.boosted(df, "id", "label", ["u", "v", "noise"], rounds=5, depth=3)
    got = out.collect()
    assert len(got) == 60 and np.mean([r.truth == r.predicted for r in got]) > 0.9 and importance[-1][0] == "noise"
    assert all(sum(r.probability) == pytest.approx(1.0) for r in got)
    mean, sd = learn.cross_validate(df, "id", "label", ["u", "v"], k=3, trees=5, depth=3)
    assert mean > 0.9 and sd < 0.1


def test_choice_of_k():
    from cohortloom.operators import learn

    row = lambda k, s, d, c: {"k": k, "silhouette": s, "davies_bouldin": d, "calinski_harabasz": c}
    assert learn.choose_k([row(2, 0.5, 1.0, 9.0), row(3, 0.5, 0.9, 1.0), row(4, 0.4, 0.1, 99.0)])["k"] == 3
    assert learn.choose_k([row(2, 0.5, 1.0, 9.0), row(3, 0.5, 1.0, 9.0)])["k"] == 2


def test_missing_units_take_the_most_frequent(spark):
    from cohortloom.functions import columns as C
    from cohortloom.operators import wide

    df = spark.createDataFrame([("creatinine", 1.0, "mg/dL"), ("creatinine", 2.0, "mg/dL"), ("creatinine", 88.4, "umol/L"), ("creatinine", 3.0, None)], "lab string, value double, unit string")
    out = sorted((r.value, r.common_unit, r.unit_filled, round(r.value_common, 2)) for r in wide.converted(df, "lab", C.lab_unit(F.col("unit")), fill_missing_unit=True).collect())
    assert [o[1:3] for o in out] == [("mg/dL", 0), ("mg/dL", 0), ("mg/dL", 1), ("mg/dL", 0)] and out[2][3] == 3.0 and out[3][3] == pytest.approx(1.0, abs=0.01)


def test_sources_and_stream(spark, tmp_path):
    from cohortloom.sources import tables as S
    from cohortloom.streaming.ingest import daily_counts

    df = spark.createDataFrame([("[1.0, 2.0]",), ("3",), (" ",), (None,), ("x",)], "v string")
    assert [r.v for r in S.read_arrays(df, {"v": "double"}).collect()][:2] == [[1.0, 2.0], [3.0]]
    assert [r.v for r in S.read_arrays(df, {"v": "double"}).collect()][2:4] == [None, None]
    assert S.preview(df, 2) == {"rows": 5, "columns": ["v"], "head": [{"v": "[1.0, 2.0]"}, {"v": "3"}]}
    S.report(spark, str(tmp_path / "r.json"), {"b": 1, "a": None})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": null,\n  "b": 1\n}'
    spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 00:00:00", "b")], "t string, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, k string").parquet(str(tmp_path / "in")).withColumn("t", F.to_timestamp("t"))
    q = daily_counts(stream, "t", "k").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(60)
    assert sorted((r.day.start.day, r.k, r.n) for r in spark.table("days").collect()) == [(1, "a", 2), (2, "b", 1)]


def test_two_sinks_and_metadata(spark, tmp_path):
    from cohortloom.sources import tables as S

    df = spark.createDataFrame([(1, "p", "bp", 3.0, "120", None)], "row_id int, id string, vital string, day double, value string, unit string")
    back = S.write_both(df, str(tmp_path / "v"))
    assert [tuple(r) for r in back.collect()] == [(1, "p", "bp", 3, 120.0, None)] and S.read_any(spark, str(tmp_path / "v.csv")).collect()[0].value == "120.0"
    m = S.metadata(spark, str(tmp_path / "v.parquet"))
    assert m["rows"] == 1 and m["bytes"] > 0 and m["columns"]["day"] == "int"


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([(f"id{i}", i % 3, float(i), "x" if i % 2 else None) for i in range(200)], "id string, n int, f double, c string")
    assert [(r.column_name, r.kind, r.id_like) for r in features.column_kinds(df, df.columns).collect()] == [("id", "categorical", True), ("n", "numeric", False), ("f", "numeric", False), ("c", "categorical", False)]


def test_agreement_over_seeds(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for g in range(3) for a in range(g * 6, g * 6 + 6) for b in range(g * 6, g * 6 + 6) if a != b], "a long, b long, w double")
    got = {r["score"]: (r["mean"], r["sd"], r["least"]) for r in graph.stability_report(edges, 2)}
    assert got["ari"] == (1.0, 0.0, 1.0) and got["ami"] == pytest.approx((1.0, 0.0, 1.0))
