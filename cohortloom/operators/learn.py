"""Clusterings and classifiers: k-means with choice of k, k-medoids, density clusters, Ward, affinity propagation, forest.

The methods that need all pairs run on a sample of a documented, bounded size, drawn by hash of the key; every row then
goes to the nearest centre, medoid or exemplar, so results cover the whole table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters, tables

PAIR_SAMPLE = 2_000  # rows of a sample all pairs of which are compared
FEATURE_LIMIT = 5_000


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones in any run and any partitioning: those with the smallest hashes of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def _collect(df: DataFrame, key: str, x: str, n: int) -> tuple[list, np.ndarray]:
    rows = sample(df.select(key, F.col(x).cast("array<double>").alias("x")), key, n).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)


def k_means(df: DataFrame, key: str, x: str, ks: list[int], restarts: int = 3, size: int = 0, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(key, label) of the best k, and for each k its inertia, silhouette on a sample, Davies-Bouldin, Calinski-Harabasz."""
    data = df.select(key, F.col(x).cast("array<double>").alias("x")).withColumn("features", array_to_vector("x")).persist()
    found = []
    for k in ks:
        # many short jobs: several starts at once keep the tasks busy
        with ThreadPoolExecutor(8) as pool:
            models = list(pool.map(lambda s: KMeans(k=k, seed=seed + s, maxIter=20).fit(data), range(restarts)))  # noqa: B023
        best = min(models, key=lambda m: m.summary.trainingCost)
        labelled = best.transform(data).select(key, "x", F.col("prediction").alias("label"))
        groups, centre, n, _ = clusters.dispersion(labelled, "x", "label", size or len(centre_of(best)))
        sil = clusters.silhouette(labelled, sample(labelled, key, PAIR_SAMPLE), key, "x", "label").collect()[0][0]
        found.append({"k": k, "inertia": best.summary.trainingCost, "silhouette": sil or 0.0, "davies_bouldin": clusters.davies_bouldin(groups), "calinski_harabasz": clusters.calinski_harabasz(groups, centre, n), "rows": labelled})
    top = choose_k(found)
    data.unpersist()
    return top["rows"].select(key, "label"), [{k: v for k, v in f.items() if k != "rows"} for f in found]


def centre_of(model) -> np.ndarray:
    return model.clusterCenters()[0]


def choose_k(found: list[dict]) -> dict:
    """Highest silhouette, then lowest Davies-Bouldin, then highest Calinski-Harabasz, then the first."""
    return max(enumerate(found), key=lambda f: (round(f[1]["silhouette"], 9), -round(f[1]["davies_bouldin"], 9), round(f[1]["calinski_harabasz"], 9), -f[0]))[1]


def k_medoids(d: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Places of the medoids for a distance matrix: greedy start, then alternate assignment and update."""
    medoids = [int(d.sum(axis=1).argmin())]
    while len(medoids) < min(k, len(d)):
        near = d[:, medoids].min(axis=1)
        gain = np.maximum(near[None, :] - d, 0).sum(axis=1)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    for _ in range(rounds):
        label = d[:, medoids].argmin(axis=1)
        new = []
        for j, m in enumerate(medoids):
            at = np.flatnonzero(label == j)
            # an empty group starts anew at the farthest point
            new.append(int(at[d[np.ix_(at, at)].sum(axis=1).argmin()]) if len(at) else int(d[:, medoids].min(axis=1).argmax()))
        if new == medoids:
            break
        medoids = new
    return np.array(medoids)


def gower_medoids(df: DataFrame, key: str, x: str, spans: list[float | None], k: int, n: int = PAIR_SAMPLE) -> tuple[DataFrame, list]:
    """(key, label, distance) of every row to the nearest of k medoids of a sample, by Gower distance; and the medoids' keys."""
    keys, m = _collect(df, key, x, n)
    d = np.zeros((len(m), len(m)))
    for f, s in enumerate(spans):
        diff = np.abs(m[:, f][:, None] - m[:, f][None, :])
        d += np.minimum(diff / s, 1) if s else diff > 0
    medoids = k_medoids(d / len(spans), k)
    centres = [(i, m[j].tolist()) for i, j in enumerate(medoids)]
    points = df.select(key, F.col(x).cast("array<double>").alias("x"))
    return clusters.assign_nearest(points, centres, key, "x", lambda a, b: clusters.gower(a, b, spans)), [keys[j] for j in medoids]


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k groups by Ward linkage (Lance-Williams updates)."""
    n = len(x)
    d = _apart(x, x) ** 2
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - min(k, n)):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        ni, nj = size[i], size[j]
        row = ((ni + size) * d[i] + (nj + size) * d[j] - size * d[i, j]) / (ni + nj + size)
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i, :], d[:, i] = row, row
        d[j, :], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += nj
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def affinity(s: np.ndarray, preference: float, damping: float = 0.9, rounds: int = 300) -> np.ndarray:
    """Place of the exemplar of each point (message passing on a similarity matrix)."""
    n = len(s)
    s = s + 1e-9 * np.random.default_rng(0).standard_normal((n, n))
    np.fill_diagonal(s, preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    every = np.arange(n)
    for _ in range(rounds):
        both = a + s
        top = both.argmax(axis=1)
        first = both[every, top]
        both[every, top] = -np.inf
        second = both.max(axis=1)
        new = s - first[:, None]
        new[every, top] = s[every, top] - second
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0)[None, :] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    exemplars = np.flatnonzero((a + r).diagonal() > 0)
    if not len(exemplars):
        exemplars = np.array([int((a + r).diagonal().argmax())])
    out = exemplars[s[:, exemplars].argmax(axis=1)]
    out[exemplars] = exemplars
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0))


def density(x: np.ndarray, least: int, samples: int | None = None) -> np.ndarray:
    """HDBSCAN labels (excess of mass), -1 for noise: core distances, minimum spanning tree of mutual reachability,
    condensed tree, most stable groups."""
    return density_model(x, least, samples)[0]


def density_model(x: np.ndarray, least: int, samples: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, strengths and core distances of the points; birth level and highest level (1 / distance) of each group.

    A point's strength is the level at which it leaves its group relative to the group's highest; noise has 0. The whole is
    no group: where nothing splits, all is noise.
    """
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1), np.zeros(n), np.full(n, np.inf), np.zeros(0), np.zeros(0)
    d = _apart(x, x)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(samples or least, n - 1)]
    m = np.maximum(np.maximum(core[:, None], core[None]), d)
    inside, near, from_ = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (m[at] < near) & ~inside
        near[closer], from_[closer] = m[at][closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[at], int(from_[at]), at))
    edges.sort()
    parent = list(range(2 * n - 1))
    size, kids, height = [1] * n + [0] * (n - 1), {}, {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        i, j, new = root(a), root(b), n + k
        parent[i] = parent[j] = new
        size[new], kids[new], height[new] = size[i] + size[j], (i, j), w

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v]
        return out

    # each group: birth level, stability, its two successors or None, its top node
    groups: list[dict] = []
    left = np.zeros(n)  # level at which a point leaves the last group it is in

    def grow(node: int, birth: float) -> int:
        g = {"node": node, "mass": 0.0, "next": None, "birth": birth, "top": birth}
        groups.append(g)
        me = len(groups) - 1
        while node >= n:
            level = g["top"] = 1 / max(height[node], 1e-12)
            left[points(node)] = level
            a, b = kids[node]
            if size[a] >= least and size[b] >= least:
                g["mass"] += (level - birth) * size[node]
                g["next"] = (grow(a, level), grow(b, level))
                return me
            small, node_next = (a, b) if size[a] < size[b] else (b, a)
            g["mass"] += (level - birth) * size[small]
            if size[node_next] < least:
                g["mass"] += (level - birth) * size[node_next]
                return me
            node = node_next
        return me

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    grow(2 * n - 2, 0.0)
    chosen: list[int] = []

    def best(g: int) -> tuple[float, list[int]]:
        nxt = groups[g]["next"]
        if nxt is None:
            return groups[g]["mass"], [g] if g else []
        below = [best(c) for c in nxt]
        mass = sum(b[0] for b in below)
        if g and groups[g]["mass"] >= mass:
            return groups[g]["mass"], [g]
        return mass, [c for b in below for c in b[1]]

    chosen = best(0)[1]
    label, strength = np.full(n, -1), np.zeros(n)
    chosen.sort(key=lambda g: min(points(groups[g]["node"])))
    for i, g in enumerate(chosen):
        at = points(groups[g]["node"])
        label[at], strength[at] = i, np.minimum(left[at] / groups[g]["top"], 1)
    return label, strength, core, np.array([groups[g]["birth"] for g in chosen]), np.array([groups[g]["top"] for g in chosen])


def density_groups(df: DataFrame, key: str, x: str, least: int = 20, n: int = PAIR_SAMPLE) -> DataFrame:
    """(key, label, distance, strength) of every row: HDBSCAN of a sample of n rows at most, extended to all; -1 is noise.

    Sampled rows keep their label and strength. Any other row takes the group of the sampled point of least mutual reachability
    if that is within the group's reach (the distance at which the group came into being); else it is noise, as with a
    sampled point that is. ``distance`` is that to the nearest other sampled point.
    """
    keys, m = _collect(df, key, x, n)
    label, strength, core, birth, top = density_model(m, least)
    place = {k: i for i, k in enumerate(keys)}
    points = df.select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = len(b["key"])
            p = np.asarray(b["x"].flatten(), float).reshape(rows, -1)
            own = np.array([place.get(k, -1) for k in b["key"].to_pylist()], int)
            out, sure, near = np.full(rows, -1), np.zeros(rows), np.full(rows, np.nan)
            for s in range(0, rows if len(m) > 1 else 0, 512):
                part = slice(s, min(s + 512, rows))
                d = _apart(p[part], m)
                at = np.flatnonzero(own[part] >= 0)
                d[at, own[part][at]] = np.inf
                near[part] = d.min(axis=1)
                if not len(birth):
                    continue
                mine = np.partition(d, min(least, len(m) - 1) - 1, axis=1)[:, min(least, len(m) - 1) - 1]
                reach = np.maximum(np.maximum(d, core[None]), mine[:, None])
                best = reach.argmin(axis=1)
                level, g = 1 / np.maximum(reach[np.arange(len(best)), best], 1e-12), label[best]
                inside = (g >= 0) & (level >= birth[g])
                out[part] = np.where(inside, g, -1)
                sure[part] = np.where(inside, np.minimum(level / top[g], 1), 0)
            seen = own >= 0
            out[seen], sure[seen] = label[own[seen]], strength[own[seen]]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(out.astype(np.int32)), pa.array(near), pa.array(sure)], ["key", "label", "distance", "strength"])

    return points.mapInArrow(run, f"key {kind}, label int, distance double, strength double").withColumnRenamed("key", key)


def extend(df: DataFrame, key: str, x: str, data: np.ndarray, label: np.ndarray) -> DataFrame:
    """(key, label, distance) of every row by the nearest mean of the sample's groups."""
    centres = [(int(g), data[label == g].mean(axis=0).tolist()) for g in np.unique(label) if g >= 0]
    points = df.select(key, F.col(x).cast("array<double>").alias("x"))
    return clusters.assign_nearest(points, centres, key, "x", lambda a, b: F.sqrt(clusters.squared_distance(a, b)))


def sampled_groups(df: DataFrame, key: str, x: str, method: str, n: int = PAIR_SAMPLE, **options) -> DataFrame:
    """(key, label, distance): ``method`` (ward, affinity) on a sample of n rows at most, extended to all rows."""
    _, m = _collect(df, key, x, min(n, FEATURE_LIMIT))
    if method == "ward":
        label = ward(m, options.get("k", 5))
    else:
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = u @ u.T
        above = s[np.triu_indices(len(s), 1)]
        label = np.unique(affinity(s, float(np.quantile(above, options.get("quantile", 0.1))) if len(above) else 0.0), return_inverse=True)[1]
    return extend(df, key, x, m, label)


def ward_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, height) of all merges of Ward linkage, the new group keeping the name i < j; heights are distances."""
    n = len(x)
    d = _apart(x, x) ** 2
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    out = []
    for _ in range(n - 1):
        i, j = sorted(int(v) for v in np.unravel_index(int(np.argmin(d)), d.shape))
        out.append((i, j, float(np.sqrt(d[i, j]))))
        with np.errstate(invalid="ignore"):
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        row[[i, j]] = np.inf
        d[i, :], d[:, i] = row, row
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out


def cophenetic(x: np.ndarray) -> float:
    """Correlation of the distances of all pairs with the heights at which Ward linkage joins them; NaN if either is constant."""
    n = len(x)
    members = {i: [i] for i in range(n)}
    joined = np.zeros((n, n))
    for i, j, height in ward_merges(x):
        joined[np.ix_(members[i], members[j])] = height
        members[i] += members.pop(j)
    joined += joined.T
    above = np.triu_indices(n, 1)
    a, b = _apart(x, x)[above], joined[above]
    return float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else float("nan")


def ward_sweep(df: DataFrame, key: str, x: str, ks: list[int], n: int = PAIR_SAMPLE) -> list[dict]:
    """For each number of groups the silhouette of a sample of n rows at most, and the cophenetic correlation of its tree."""
    _, m = _collect(df, key, x, n)
    distance, tree = _apart(m, m), cophenetic(m)
    return [{"k": k, "silhouette": clusters.silhouette_of(distance, ward(m, k)), "cophenetic": tree} for k in ks]


def preference_sweep(df: DataFrame, key: str, x: str, quantiles: list[float], n: int = 500) -> list[dict]:
    """For preferences at quantiles of the similarities: groups of affinity propagation and their silhouette, on a sample of n rows at most."""
    _, m = _collect(df, key, x, n)
    s = 1 - clusters.apart(m, m, "cosine")
    above = s[np.triu_indices(len(s), 1)]
    out = []
    for q in quantiles if len(above) else []:
        label = affinity(s, float(np.quantile(above, q)))
        out.append({"quantile": q, "groups": len(np.unique(label)), "silhouette": clusters.silhouette_of(1 - s, label)})
    return out


def boosted(df: DataFrame, key: str, label: str, columns: list[str], test_share: float = 0.2, rounds: int = 20, depth: int = 4, seed: int = 42) -> tuple[DataFrame, list[tuple[str, float]]]:
    """As ``forest``, by gradient-boosted trees, one model for each class against the rest; the class of the highest raw score
    wins and the probabilities are the classes' own, scaled to add up to 1."""
    data = df.select(key, F.col(label).cast("string").alias("truth"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    data = tables.split(data, key, ["truth"], test_share)
    classes = sorted(r[0] for r in data.select("truth").distinct().collect() if r[0] is not None)
    wide = VectorAssembler(inputCols=columns, outputCol="features").transform(data).select(key, "truth", "part", "features").persist()
    out, importance = wide.filter("part = 'test'"), np.zeros(len(columns))
    for i, c in enumerate(classes):
        train = wide.filter("part = 'train'").withColumn("y", (F.col("truth") == c).cast("double"))
        model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed).fit(train)
        importance += model.featureImportances.toArray()
        out = model.setProbabilityCol(f"p{i}").setRawPredictionCol(f"r{i}").setPredictionCol(f"d{i}").transform(out)
    p = F.array(*[vector_to_array(f"p{i}")[1] for i in range(len(classes))])
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    best = F.array_max(F.array(*[F.struct(vector_to_array(f"r{i}")[1].alias("r"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))["c"]
    out = out.select(key, "truth", best.alias("predicted"), F.transform(p, lambda v: v / total).alias("probability"))
    return out, sorted(zip(columns, (importance / max(len(classes), 1)).tolist()), key=lambda t: (-t[1], t[0]))


def forest(df: DataFrame, key: str, label: str, columns: list[str], test_share: float = 0.2, trees: int = 60, depth: int = 6, seed: int = 42) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(key, truth, predicted, probability array) of the held-out rows, and (feature, importance), highest first."""
    data = df.select(key, F.col(label).cast("string").alias("truth"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    data = tables.split(data, key, ["truth"], test_share)
    index = StringIndexer(inputCol="truth", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    wide = VectorAssembler(inputCols=columns, outputCol="features").transform(index.transform(data))
    model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(wide.filter("part = 'train'"))
    names = F.array(*[F.lit(v) for v in index.labels])
    out = model.transform(wide.filter("part = 'test'")).select(key, "truth", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), vector_to_array("probability").alias("probability"))
    return out, sorted(zip(columns, (float(v) for v in model.featureImportances.toArray())), key=lambda t: (-t[1], t[0]))


def cross_validate(df: DataFrame, key: str, label: str, columns: list[str], k: int = 5, trees: int = 20, depth: int = 5, seed: int = 42) -> tuple[float, float]:
    """Mean and population sd of the accuracy over k stratified folds (as many as the smallest class has rows, at most k)."""
    data = df.select(key, F.col(label).cast("string").alias("truth"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    least = data.groupBy("truth").count().agg(F.min("count")).collect()[0][0] or 0
    k = max(2, min(k, least))
    data = tables.folds(data, key, ["truth"], k)
    index = StringIndexer(inputCol="truth", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    wide = VectorAssembler(inputCols=columns, outputCol="features").transform(index.transform(data))
    scores = []
    for f in range(k):
        m = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(wide.filter(F.col("fold") != f))
        scores.append(m.transform(wide.filter(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).collect()[0][0])
    return float(np.mean(scores)), float(np.std(scores))
