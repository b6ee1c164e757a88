"""Cohort operators on small fixtures, against brute force where that says more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import clusters, codes, evaluate, features, learn, link, tables, wide
from cohortloom.sources import tables as S
from cohortloom.streaming import ingest


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(0)
    left = [(i, f"p{rng.integers(0, 5)}", int(rng.integers(-60, 60))) for i in range(60)] + [(99, "p0", None)]
    right = [(i, f"p{rng.integers(0, 5)}", int(rng.integers(-60, 60)), "ab"[i % 2], float(i)) for i in range(200)] + [(999, "p0", None, "a", 1.0)]
    return left, right, spark.createDataFrame(left, "i int, p string, d int"), spark.createDataFrame(right, "j int, p string, e int, k string, v double")


@pytest.mark.parametrize("window", [0, 1, 7, 15])
def test_range_match_against_brute_force(days, window):
    left, right, l, r = days
    got = {(x.i, x.j) for x in link.range_match(l, r, "p", "d", "e", window).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= window}


def test_nearest_match_against_brute_force(days):
    left, right, l, r = days
    got = {(x.i, x.k): x.j for x in link.nearest_match(l, r, "p", "i", "k", "d", "e", ["j"], ["j"], 15).collect()}
    want = {}
    for a in left:
        for b in right:
            if a[1] == b[1] and None not in (a[2], b[2]) and abs(b[2] - a[2]) <= 15:
                key = (abs(b[2] - a[2]), b[2] > a[2], b[0])
                if (a[0], b[3]) not in want or key < want[a[0], b[3]]:
                    want[a[0], b[3]] = key
    assert got == {k: v[2] for k, v in want.items()}


def test_tie_goes_to_on_or_before(spark):
    l = spark.createDataFrame([(1, "p", 10)], "i int, p string, d int")
    r = spark.createDataFrame([(1, "p", 15, "a"), (2, "p", 5, "a"), (3, "p", 26, "b")], "j int, p string, e int, k string")
    assert [tuple(x) for x in link.nearest_match(l, r, "p", "i", "k", "d", "e", ["j"], ["j"], 15).select("k", "j").collect()] == [("a", 2)]


def test_best_row_pivot_impute(spark):
    df = spark.createDataFrame([("p", "a", 3, 1, 1.0), ("p", "a", 3, 2, 2.0), ("p", "a", None, 9, 3.0), ("q", "b", 1, None, 4.0), ("q", "b", 1, 5, 6.0), ("r", "b", 0, 1, None)], "p string, k string, dist int, day int, v double")
    best = wide.best_row(df, ["p", "k"], F.col("dist"), "day", ["v"], ["v"])
    assert {(r.p, r.k): r.v for r in best.collect()} == {("p", "a"): 2.0, ("q", "b"): 6.0, ("r", "b"): None}
    w = wide.pivot_values(best, "p", "k", "v", ["a", "b", "c"])
    assert w.columns == ["p", "a_value", "b_value", "c_value"]
    out = {r.p: r for r in wide.impute_median(w, ["a_value", "b_value", "c_value"]).collect()}
    assert out["r"].a_value == 2.0 and out["r"].a_value_missing_before == 1 and out["r"].c_value is None
    s = {r.measure: r for r in wide.imputation_summary(w, ["b_value", "c_value"]).collect()}
    assert (s["b_value"].missing_before, s["b_value"].missing_after, s["c_value"].missing_after) == (2, 0, 3)


def test_joins_of_labels(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    labels = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3)], "k string, l string, o int")
    with pytest.raises(ValueError):
        tables.join_labels(left, labels, "k", "l")
    assert tables.join_labels(left, labels, "k", "l", on_duplicate="mode").collect()[0].l == "y"
    assert tables.join_labels(left, labels, "k", "l", how="left", on_duplicate="first", order=["o"]).orderBy("k").collect()[0].l == "x"


def test_codes(spark):
    df = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a"]), ("r", None), ("p", ["a"])], "id string, c array<string>")
    got = {r.code: (r.n_entities, r.pct_of_entities, r.rank) for r in codes.frequency(df, "id", F.col("c")).collect()}
    assert got == {"a": (2, 66.67, 1), "b": (1, 33.33, 2)}
    flags = spark.createDataFrame([(i % 2, i % 2, 1, 1) for i in range(10)], "x int, y int, one int, uno int")
    assert codes.duplicates(flags, ["x", "one"], ["y", "uno"]) == [("x", "y", pytest.approx(1.0)), ("one", "uno", 1.0)]


def test_features(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), 1.0 if i % 2 else 0.0, None if i == 3 else 5.0) for i in range(20)], "a double, b double, f double, c double")
    r = {x.column_name: (x.role, x.is_constant) for x in features.roles(df.withColumn("n", F.lit(None).cast("double")), ["a", "f", "c", "n"]).collect()}
    assert r == {"a": ("continuous", 0), "f": ("binary", 0), "c": ("continuous", 1), "n": ("binary", 1)}
    z = features.scale(df, ["a", "c"], "robust").orderBy("b").collect()
    assert z[0].a == pytest.approx((0 - 9.5) / 9.5) and z[0].c == 0 and z[3].c is None
    assert features.scale(df, ["a"], "standard", 1.0).agg(F.max("a")).collect()[0][0] == 1.0
    kept, report = features.correlation_filter(df, ["a", "b", "f", "c"])
    assert kept == ["a", "f", "c"] and report[0][3] == "b"
    scores, shares = features.principal_components(df.withColumn("k", F.col("a")), "k", ["a", "b"], 2)
    assert shares[0] == pytest.approx(1.0) and abs(scores.agg(F.avg(F.col("pc")[0])).collect()[0][0]) < 1e-9


def test_validity_measures(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(5 * (i % 2), 1, 3)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label int")
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a = np.array([d[i][(y == y[i]) & (np.arange(60) != i)].mean() for i in range(60)])
    b = np.array([d[i][y != y[i]].mean() for i in range(60)])
    assert clusters.silhouette(df, df, "id", "x", "label").collect()[0][0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-6)
    assert clusters.adjusted_rand(df.withColumn("m", 1 - F.col("label")), "label", "m").collect()[0][0] == 1.0
    assert clusters.adjusted_mutual_information(df.withColumn("m", 1 - F.col("label")), "label", "m") == pytest.approx(1.0)
    edges = spark.createDataFrame([(0, 2, 1.0), (2, 4, 1.0), (1, 3, 1.0), (3, 5, 1.0), (0, 1, 1.0), (7, 7, 9.0)], "a int, b int, w double")
    q = clusters.modularity(edges, df.select("id", "label")).collect()[0]
    assert q.total_weight == 5.0 and q.modularity == pytest.approx(2 / 5 - 0.25 + 2 / 5 - 0.25)
    assert clusters.small_to_outlier(spark.createDataFrame([(1,), (1,), (2,)], "c int"), "c", 2).groupBy("c").count().count() == 2


def test_scores_of_classifiers(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.5), (0, 0, 0.5), (0, 1, 0.6), (0, 0, 0.1)], "t int, p int, s double")
    r = evaluate.ranking_scores(df, [], "s", F.col("t") == 1).collect()[0]
    assert r.auroc == pytest.approx((3 + 1.5) / 6) and r.n == 5
    assert evaluate.summary(df, "t", "p").collect()[0].accuracy == 0.6
    empty = evaluate.ranking_scores(df.filter("t = 0"), [], "s", F.col("t") == 1).collect()[0]
    assert empty.auroc is None


def test_groupings():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    truth = np.repeat([0, 1, 2], 40)
    for label in (learn.ward(x, 3), learn.density(x, 10)):
        assert len(set(label[label >= 0])) == 3
        assert all(len(set(truth[label == g])) == 1 for g in set(label) - {-1})
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {int(truth[m]) for m in learn.k_medoids(d, 3)} == {0, 1, 2}
    e = learn.affinity(-(d**2), float(np.median(-(d**2))))
    assert all(len(set(truth[e == g])) == 1 for g in set(e))


def test_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("\xb5 id | a\n1|2\n|\"x|y\"\n".encode("latin-1"))
    assert S.sniff_separator(spark, str(p)) == "|"
    df = S.read_delimited(spark, str(p), sep="|")
    assert df.columns == ["µ id", "a"] and [tuple(r) for r in df.collect()] == [("1", "2"), (None, "x|y")]
    assert S.read_delimited(spark, str(p), sep="|", literal_missing=True).collect()[1][0] == ""
    with pytest.raises(ValueError):
        S.read_delimited(spark, str(p), sep="|", required=["b"])
    out = str(tmp_path / "t.parquet")
    assert S.ingest(spark, str(p), out, sep="|").count() == 2 and S.ingest(spark, str(p), out, sep="|").count() == 2
    assert S.read_any(spark, str(tmp_path / "t")).count() == 2 and S.verify_ids(spark, out, "a", 2)
    arrays = spark.createDataFrame([(1, [1.5, None])], "i int, v array<double>")
    S.write_table(arrays, str(tmp_path / "a.csv"))
    back = S.read_arrays(S.read_delimited(spark, str(tmp_path / "a.csv"), encoding="UTF-8"), {"v": "double"})
    assert back.collect()[0].v == [1.5, None]
    assert S.find_column(df, ["A"]) == "a" and S.find_column(df, ["zz"], required=False) is None
    assert S.series_columns(spark.sql("SELECT 1 AS k_days, 2 AS k_value, 3 AS m_days")) == {"k": {"days": "k_days", "value": "k_value"}}


def test_files_are_taken_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("i,v\n1,x\n2,y\n")
    for _ in range(2):
        ingest.append_new(ingest.stream_extract(spark, src, ["i", "v"]), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "in/b.csv").write_text("i,v\n3,z\n")
    ingest.append_new(ingest.stream_extract(spark, src, ["i", "v"]), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_exact_neighbours_against_brute_force(spark):
    from cohortloom.operators import graph

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    x[50] = x[51] = x[52]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    got = {}
    for r in clusters.exact_neighbours(df, df, "id", "x", 4).collect():
        got.setdefault(r.q, []).append((r.rnk, r.id))
    for q in range(120):
        best = sorted((j for j in range(120) if j != q), key=lambda j: (-sim[q, j], j))[:4]
        assert [j for _, j in sorted(got[q])] == best
    assert clusters.exact_neighbours(df, df.limit(0), "id", "x", 4).count() == 0
    w = graph.fuzzy_weights(clusters.exact_neighbours(df, df, "id", "x", 5).select(F.col("q").alias("a"), F.col("id").alias("b"), (1 - F.col("similarity")).alias("d")))
    e = {(r.a, r.b): r.w for r in w.collect()}
    assert all(abs(e[b, a] - v) < 1e-12 and 0 <= v <= 1 + 1e-9 for (a, b), v in e.items())


def test_partition_of_cliques(spark):
    from cohortloom.operators import graph

    pairs = [(i, j, 1.0) for g in range(3) for i in range(5 * g, 5 * g + 5) for j in range(5 * g, 5 * g + 5) if i != j] + [(0, 5, 0.5), (5, 0, 0.5), (20, 21, 1.0), (21, 20, 1.0)]
    e = spark.createDataFrame(pairs, "a long, b long, w double")
    got = {r.id: r.label for r in graph.graph_communities(e, least=3).collect()}
    assert len({got[i] for i in range(15)}) == 3 and all(len({got[5 * g + i] for i in range(5)}) == 1 for g in range(3))
    assert got[20] == got[21] == -1
    assert graph.stability(e, 2) == [1.0, 1.0]
    assert graph.graph_communities(e.limit(0)).count() == 0


def test_checks_and_categories(spark):
    df = spark.createDataFrame([(1, 0.0, float("inf")), (0, 1.0, float("nan")), (None, 2.0, 3.0)], "a int, b double, c double")
    features.validate_binary(df, ["a"])
    with pytest.raises(ValueError):
        features.validate_binary(df, ["a", "b"])
    assert [r.c for r in features.finite(df, ["c"]).collect()] == [None, None, 3.0]
    assert features.feature_sets(["has_a", "med_b", "c"])["diagnosis_meds"] == ["has_a", "med_b"]
    m = spark.createDataFrame([("'I50'", "x", None), ("E11 ", " y", "z")], "code string, `CCSR CATEGORY 1` string, `CCSR CATEGORY 2` string")
    assert {tuple(r) for r in tables.explode_categories(m, "code", "CCSR CATEGORY").collect()} == {("'I50'", "x"), ("E11", "y"), ("E11", "z")}


def test_search_and_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(3 * (i % 3), 1, 4).tolist(), f"g{i % 3}") for i in range(150)], "id long, x array<double>, label string").repartition(3).cache()
    rows = lambda: sorted(tuple(r) for r in clusters.exact_neighbours(df, df, "id", "x", 4).collect())
    neighbours, score = rows(), clusters.silhouette(df, df, "id", "x", "label").collect()
    assert len(neighbours) == 600
    monkeypatch.setattr(clusters, "QUERY_LIMIT", 40)
    monkeypatch.setattr(clusters, "SAMPLE_LIMIT", 40)
    assert rows() == neighbours and clusters.silhouette(df, df, "id", "x", "label").collect() == score


def test_density_keeps_noise(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.3, (150, 2)), rng.normal(8, 0.3, (150, 2)), rng.uniform(-60, 60, (8, 2)) + [200, 0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for n in (2000, 200):
        got = {r.id: r for r in learn.density_groups(df, "id", "x", 10, n).collect()}
        label = np.array([got[i].label for i in range(308)])
        assert len(got) == 308 and (label[300:] == -1).all()
        for at in (slice(0, 150), slice(150, 300)):
            assert (label[at] >= 0).mean() > 0.8 and len(set(label[at]) - {-1}) == 1
        assert all((r.strength > 0) == (r.label >= 0) and r.strength <= 1 for r in got.values())
    assert (learn.density(rng.normal(size=(12, 2)), 10) == -1).all(), "what doesn't split is noise"


def test_kmeans_query_finds_more_than_four_groups(spark, monkeypatch):
    from cohortloom.plans import reference

    rng, asked, fit = np.random.default_rng(9), [], learn.k_means
    df = spark.createDataFrame([(i, (10 * np.eye(6)[i % 6] + rng.normal(0, 0.3, 6)).tolist()) for i in range(240)], "vec_id long, x array<double>").cache()
    monkeypatch.setattr(reference, "embeddings", lambda *_: df)

    def once(*args, restarts):
        asked.append((args[3], restarts))
        return fit(*args, restarts=3)

    monkeypatch.setattr(learn, "k_means", once)
    assert reference.kmeans_best(spark, "").select("label").distinct().count() == 6
    assert asked == [(list(range(2, 11)), 20)]


def test_sampled_queries_fit_the_documented_number_of_rows(spark, monkeypatch):
    from cohortloom.plans import reference

    asked, collect = [], learn._collect
    monkeypatch.setattr(learn, "_collect", lambda df, key, x, n: (asked.append(n), collect(df, key, x, 60))[1])
    for q in (reference.ward_groups, reference.affinity_groups, reference.gower_medoids):
        q(spark, "/root/testdata/sf0.001")
    assert asked == [2_000] * 3
