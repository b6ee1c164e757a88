from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.similarity import communities, cut_tree, describe_groups, group_records, merge_tree, neighbour_graph, neighbours, records, vectors, weighted_edges

FLAGS = tuple(f"f{i}" for i in range(12))
NUMBERS = {f"v{k}": (0.01, 100.0) for k in range(5)}


def distances(x, i):
    """Squared distances from row i, written out: 687 where one of the two lacks a number."""
    lacks = (x == -128) | (x[i] == -128)
    return np.where(lacks, 687.0, (x - x[i]) ** 2).sum(1)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        g = i % 3
        f = [int(rng.random() < (0.93 if j // 4 == g else 0.06)) for j in range(12)]
        v = [float(np.exp(rng.normal([0, 1, 2][g] if k == 0 else 0, 0.5))) for k in range(5)]
        v[0] = None if i % 40 == 0 else 9999.0 if i % 41 == 0 else v[0]
        rows.append((f"p{i}", *f, *v, "clash"))
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{f} int" for f in FLAGS) + ", v0 double, v1 double, v2 double, v3 double, v4 double, id string")


def test_recall_of_neighbour_descent(spark, people):
    nodes = vectors(records(people, "key", FLAGS, NUMBERS)).cache()
    got = defaultdict(list)
    for r in neighbour_graph(nodes, k=10, leaf=60, chunk=250).collect():
        got[r.a].append((r.b, r.d))
    rows = nodes.collect()
    x, ids = np.array([r.x for r in rows], float), [r.id for r in rows]
    hit = total = 0
    for i, node in enumerate(ids):
        d = distances(x, i)
        d[i] = np.inf
        limit = np.sort(d)[9]
        hit += sum(e[1] <= limit + 1e-3 for e in got[node][:10])
        total += 10
        assert node not in [e[0] for e in got[node]] and len({e[0] for e in got[node]}) == 10
    assert hit / total > 0.9


def test_recall_with_production_parameters_on_the_whole_table(spark):
    from cohortloom.llm import queries

    master = queries.table(spark, "/root/testdata/sf0.1", queries.MASTER)
    flags = tuple(c for c in master.columns if c.startswith(("has_", "med_")) or c == "SEX_FEMALE")
    nodes = vectors(records(master, "PAT_MRN_ID_ENCRYPT", flags, {c: queries.POSSIBLE[c] for c in master.columns if c in queries.POSSIBLE})).cache()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = defaultdict(list)
        for r in neighbour_graph(nodes).collect():
            got[r.a].append(r.d)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = nodes.collect()
    x, ids = np.array([r.x for r in rows], np.float32), [r.id for r in rows]
    hit = 0
    for i in range(0, len(ids), 50):
        d = distances(x, i)
        d[i] = np.inf
        hit += sum(v <= np.sort(d)[11] + 1e-3 for v in got[ids[i]])
    assert hit / (12 * len(range(0, len(ids), 50))) > 0.95


def test_groups(spark, people):
    groups, described = group_records(people, "key", FLAGS, NUMBERS, 2, 6)
    got = groups.collect()
    assert len(got) == 900
    truth = np.array([int(r.key[1:]) % 3 for r in got])
    label = np.array([r.group for r in got])
    assert set(label) - {-1} == {0, 1, 2} and (label >= 0).mean() > 0.9
    assert np.mean([np.bincount(truth[label == g]).max() / (label == g).sum() for g in range(3)]) > 0.97
    described = describe_groups(groups, described, 3).collect()
    assert sum(r["size"] for r in described if r["rank"] == 1) == 900
    for g in range(3):
        mine = [r for r in described if r.group == g]
        assert [r["rank"] for r in mine] == [1, 2, 3] and mine[0].degree >= mine[1].degree >= mine[2].degree


def test_groups_hold_whatever_the_order_and_partitions(spark, people):
    def labels(df, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return {r.key: r.group for r in group_records(df, "key", FLAGS, NUMBERS, 2, 6)[0].collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    one, other = labels(people, 4), labels(people.orderBy("v1").repartition(3), 7)
    x, y = (np.array([m[k] for k in sorted(one)]) for m in (one, other))
    assert ((x[:, None] == x) == (y[:, None] == y)).mean() > 0.995


def test_a_third_of_all_rows_equal(spark, people):
    many = people.unionByName(people.limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i"))
    groups, described = group_records(many, "key", FLAGS, NUMBERS, 2, 6)
    got = groups.collect()
    assert len(got) == 1400
    first = people.limit(1).collect()[0].key
    assert len({r.group for r in got if r.key == first}) == 1
    top = [r for r in describe_groups(groups, described, 3).collect() if r.rank == 1]
    assert sum(r["size"] for r in top) == 1400


def test_repeated_null_and_empty(spark, people):
    assert group_records(people.limit(0), "key", FLAGS, NUMBERS, 1, 5)[0].count() == 0
    same = spark.createDataFrame([(None, 1, 2.0)] * 30, "key string, f int, v double")
    out = group_records(same, "key", ("f",), {"v": (0.1, 9.0)}, 1, 5)[0].collect()
    assert len(out) == 30
    one = group_records(same.limit(1), "key", ("f",), {"v": (0.1, 9.0)}, 1, 5)[0].collect()
    assert [r.group for r in one] == [-1]


def test_missing_numbers_set_nobody_apart(spark):
    rows = [(str(i), 1, 5.0) for i in range(40)] + [(str(40 + i), 1, v) for i, v in enumerate([None, float("nan"), 9999.0])]
    x = {r.key: list(r.x) for r in records(spark.createDataFrame(rows, "key string, f int, v double"), "key", ("f",), {"v": (0.1, 99.0)}).collect()}
    assert x["0"] == [50, 0] and x["40"] == x["41"] == x["42"] == [50, -128]


def test_same_rows_are_one_group(spark):
    same = spark.createDataFrame([(None, 1, 2.0)] * 30, "key string, f int, v double")
    rows, described = group_records(same, "key", ("f",), {"v": (0.1, 9.0)}, 1, 5)
    assert {r.group for r in rows.collect()} == {0} and [r.n for r in described.collect()] == [30]


def cliques(n, size, bridges):
    edges = [(i, j, 1.0) for g in range(n) for i in range(g * size, g * size + size) for j in range(g * size, g * size + size) if i != j]
    edges += [e for i, j, w in bridges for e in ((i, j, w), (j, i, w))]
    a, b, w = zip(*edges)
    return np.array(a), np.array(b), np.array(w)


def test_merge_tree_against_brute_force():
    rng = np.random.default_rng(1)
    n = 14
    m = np.triu((rng.random((n, n)) < 0.4) * rng.random((n, n)), 1)
    m += m.T
    a, b = np.nonzero(m)
    got = merge_tree(a, b, m[a, b], n)
    sets = {i: {i} for i in range(n)}
    total = m.sum()
    for gamma, i, j in got:
        gain = lambda x, y: m[np.ix_(sorted(x), sorted(y))].sum() * total / (m[sorted(x)].sum() * m[sorted(y)].sum())
        best = max(gain(sets[x], sets[y]) for x in sets for y in sets if x < y)
        assert abs(gamma - best) < 1e-9 and abs(gain(sets[i], sets[j]) - best) < 1e-9
        sets[n + got.index((gamma, i, j))] = sets.pop(i) | sets.pop(j)
    assert all(x[0] >= y[0] - 1e-9 for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("size", [6, 60])
def test_tree_is_cut_where_groups_hold_longest(size):
    a, b, w = cliques(6, size, [(0, size, 0.5), (2 * size, 3 * size, 0.01), (size, 5 * size, 0.02)])
    label = cut_tree(a, b, w, {i: 1 for i in range(6 * size)}, 5, 10, 0.01)
    assert len(set(label.values())) == 6 and all(len({label[g * size + i] for i in range(size)}) == 1 for g in range(6))


def test_loose_communities_are_no_groups():
    a, b, w = cliques(3, 20, [(0, 20, 0.1)])
    a, b, w = np.r_[a, 60, 61], np.r_[b, 61, 60], np.r_[w, 1, 1]
    label = cut_tree(a, b, w, {i: 1 for i in range(62)}, 3, 5, 0.05)
    assert label[60] == label[61] == -1 and len(set(label.values()) - {-1}) == 3


def test_a_missing_link_weighs_no_more_than_a_single_one():
    """Six groups, two pairs of which share a weak link while the others share none: they are six, not four."""
    a, b, w = cliques(6, 40, [(0, 40, 0.9), (80, 120, 0.9)])
    label = cut_tree(a, b, w, {i: 1 for i in range(240)}, 4, 10, 0.01)
    assert len(set(label.values())) == 6


def test_no_edges(spark):
    edges = spark.createDataFrame([], "a long, b long, w double")
    assert communities(edges, spark.createDataFrame([], "id long, n long")).count() == 0
    assert weighted_edges(spark.createDataFrame([], "a long, b long, d float")).count() == 0


def test_more_components_than_the_driver_takes(spark):
    """3,000 pairs without links between them, and a group of 30: nothing can shrink further."""
    pairs = [(2 * i, 2 * i + 1, 1.0) for i in range(3000)]
    whole = [(6000 + i, 6000 + j, 1.0) for i in range(30) for j in range(i)]
    edges = [e for i, j, w in pairs + whole for e in ((i, j, w), (j, i, w))]
    copies = spark.createDataFrame([(i, 1) for i in range(6000)] + [(6000 + i, 20) for i in range(30)], "id long, n long")
    got = {r.a: r.c for r in communities(spark.createDataFrame(edges, "a long, b long, w double"), copies).collect()}
    assert len(got) == 6030 and {c for a, c in got.items() if a >= 6000} == {0} and {c for a, c in got.items() if a < 6000} == {-1}


def test_neighbours_grow_with_the_logarithm():
    assert neighbours(0) == neighbours(1000) == 12 and neighbours(10**8) == 19
