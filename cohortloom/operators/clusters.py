"""Groups given by labels: sizes, profiles, drivers, distances, graph and validity measures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .quantiles import exact_quantiles

MARGIN_LIMIT = 20_000  # different labels of one side of a contingency table that reach the driver


def sizes(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def long_features(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(label), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))


def profile(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, feature, n, mean, median, sd, min, max): feature by feature, the transposed form of a profile."""
    long = long_features(df, label, columns).toDF("label", "feature", "v")
    stats = long.groupBy("label", "feature").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    middle = exact_quantiles(long, ["label", "feature"], "v", [0.5])
    joined = stats.alias("l").join(middle.alias("r"), F.col("l.label").eqNullSafe(F.col("r.label")) & (F.col("l.feature") == F.col("r.feature")), "left")
    return joined.select(F.col("l.label").alias(label), "l.feature", "n", "mean", F.round("q0", 6).alias("median"), "sd", "min", "max")


def drivers(df: DataFrame, label: str, columns: list[str], top: int, standardized: bool = True) -> DataFrame:
    """The ``top`` features by |difference of the group's mean to the overall one|, in population sds if standardized."""
    both = long_features(df, label, columns)
    overall = both.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    g = both.groupBy(label, "feature").agg(F.avg("v").alias("gm")).join(F.broadcast(overall), "feature")
    d = F.coalesce(F.try_divide(F.col("gm") - F.col("m"), F.col("s")), F.lit(0.0)) if standardized else F.col("gm") - F.col("m")
    diff = g.select(label, "feature", d.alias("difference"))
    share = F.coalesce(F.try_divide(100 * F.abs("difference"), F.sum(F.abs("difference")).over(Window.partitionBy(label))), F.lit(0.0))
    ranked = diff.withColumns({"driver_pct": share, "rnk": F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round(F.abs("difference"), 9)), "feature"))})
    return ranked.filter(F.col("rnk") <= top).select(
        label, F.col("rnk").cast("int").alias("rnk"), "feature", F.round("difference", 6).alias("difference"), F.round("driver_pct", 6).alias("driver_pct"), F.when(F.col("difference") >= 0, "higher").otherwise("lower").alias("direction")
    )


def merged_profile(df: DataFrame, label: str, binary: list[str], continuous: list[str]) -> DataFrame:
    """One row per group: size, share, prevalence of each flag in percent, mean of each measure."""
    means = df.groupBy(label).agg(*[F.round(100 * F.avg(c), 4).alias(f"{c}_pct") for c in binary], *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in continuous])
    return sizes(df, label).join(means, label)


def flag_share(df: DataFrame, label: str, flag: Column) -> DataFrame:
    """(label, n, n_flag, prevalence_pct, share_pct) of a 0/1 flag."""
    one = F.coalesce(flag.cast("int"), F.lit(0))
    g = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(one).alias("n_flag"))
    return g.withColumns({"prevalence_pct": F.round(100.0 * F.col("n_flag") / F.col("n"), 4), "share_pct": F.round(100.0 * F.try_divide(F.col("n_flag"), F.sum("n_flag").over(Window.partitionBy(F.lit(0)))), 4)})


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def gower(a: Column, b: Column, spans: list[float | None]) -> Column:
    """Mean over features of mismatch (span None) or absolute difference relative to the span, 1 at most."""
    r = F.array(*[F.lit(s if s else 0.0) for s in spans])
    pairs = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), r, lambda p, s: F.when(s == 0.0, (p.x != p.y).cast("double")).otherwise(F.least(F.abs(p.x - p.y) / s, F.lit(1.0))))
    return _total(pairs) / len(spans)


def assign_nearest(points: DataFrame, centres: list[tuple], key: str, x: str, distance) -> DataFrame:
    """(key, label, distance) of the nearest of a few centres (label, vector), the smallest label on ties; no join at all."""
    options = F.array(*[F.struct(F.round(distance(F.col(x), F.array(*[F.lit(float(v)) for v in c])), 9).alias("distance"), F.lit(label).alias("label")) for label, c in centres])
    best = F.array_min(options)
    return points.select(key, best["label"].alias("label"), best["distance"].alias("distance"))


QUERY_LIMIT = 5_000  # queries of a block of exact search
SAMPLE_LIMIT = 10_000  # points of a block that a silhouette is summed over


def _blocks(df: DataFrame, key: str, limit: int) -> list[DataFrame]:
    """The frame in parts of about ``limit`` rows, by hash of the key: whole if it has no more."""
    n = df.count()
    if n <= limit:
        return [df]
    parts = math.ceil(n / (0.9 * limit))
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _matrix(rows: list, x: str) -> np.ndarray:
    return np.array([r[x] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _arrays(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(n, -1)


def exact_neighbours(points: DataFrame, queries: DataFrame, key: str, x: str, k: int) -> DataFrame:
    """(q, key, similarity, rnk): the k most cosine-similar points of each query, ties by key.

    Blocks of about 5,000 queries go to every task in turn, one at a time on the driver, so any number is searched exactly.
    Each batch of points is one matrix product against a block and keeps its k best per query, so only those rows are shuffled.
    """
    parts = _blocks(queries, key, QUERY_LIMIT)
    if len(parts) == 1:
        return _block_neighbours(points, parts[0], key, x, k)
    out = None
    for part in parts:
        found = written(_block_neighbours(points, part, key, x, k), "neighbours")
        out = out.unionByName(found) if out is not None else found
    return out


def _block_neighbours(points: DataFrame, queries: DataFrame, key: str, x: str, k: int) -> DataFrame:
    rows = queries.select(key, F.col(x).cast("array<double>").alias("x")).collect()
    kind = points.schema[key].dataType.simpleString()
    names = np.array([r[key] for r in rows])
    q = _matrix(rows, "x")
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for b in batches:
            ids = np.asarray(b["key"])
            p = _arrays(b["x"], b.num_rows)
            p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
            out = []
            for s in range(0, len(q), 512):
                sim = np.round(q[s : s + 512] @ p.T, 9)
                sim[names[s : s + 512][:, None] == ids[None, :]] = -np.inf
                m = min(k, sim.shape[1])
                # everything as good as the k-th best stays, so that ties are settled over all batches
                limit = -np.partition(-sim, m - 1, axis=1)[:, m - 1 : m]
                i, j = np.nonzero((sim >= limit) & (sim > -np.inf))
                out.append((names[s + i], ids[j], sim[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["q", "key", "similarity"])

    if not rows:
        return points.sparkSession.createDataFrame([], f"q {kind}, {key} {kind}, similarity double, rnk int")
    found = points.select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, f"q {kind}, key {kind}, similarity double")
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k).withColumnRenamed("key", key)


def shared_neighbours(near: DataFrame) -> DataFrame:
    """(a, b, jaccard) of neighbours a -> b in (a, b): shared over united neighbour sets."""
    sets = near.groupBy("a").agg(F.collect_set("b").alias("s"))
    j = near.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("s").alias("t")), "b")
    return j.select("a", "b", (F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("jaccard"))


def undirected(near: DataFrame) -> DataFrame:
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(modularity, n_edges) of undirected (a, b, w) and (id, label); nodes of label -1 and self-loops are left out."""
    l = labels.filter("label <> -1")
    e = edges.filter("a <> b").join(l.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(l.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    ends = e.select(F.inline(F.array(F.struct(F.col("la").alias("label"), "w", F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("lb").alias("label"), "w", F.lit(0.0).alias("i")))))
    per = ends.groupBy("label").agg(F.sum("w").alias("d"), F.sum("i").alias("inside"))
    m = F.sum("d").over(Window.partitionBy(F.lit(0))) / 2
    return per.withColumn("m", m).agg(F.round(F.sum(F.col("inside") / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), 2)), 6).alias("modularity"), F.round(F.max("m"), 6).alias("total_weight"))


def small_to_outlier(labels: DataFrame, label: str, least: int) -> DataFrame:
    """Labels with fewer than ``least`` rows become -1; rows are counted before anything is joined."""
    n = labels.groupBy(label).agg(F.count("*").alias("_n"))
    return labels.join(n, label, "left").withColumn(label, F.when(F.coalesce("_n", F.lit(0)) < least, -1).otherwise(F.col(label))).select(*labels.columns)


def apart(p: np.ndarray, q: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of p to all rows of q: euclidean, manhattan, cosine or correlation (1 minus the similarity)."""
    if metric == "manhattan":
        return sum(np.abs(p[:, i][:, None] - q[:, i][None, :]) for i in range(p.shape[1])) if p.shape[1] else np.zeros((len(p), len(q)))
    if metric in ("cosine", "correlation"):
        if metric == "correlation":
            p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
        p, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (p, q))
        return np.maximum(1 - p @ q.T, 0)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return np.sqrt(np.maximum((p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None] - 2 * p @ q.T, 0))


def silhouette_of(d: np.ndarray, label: np.ndarray) -> float | None:
    """Mean silhouette from a matrix of given distances; members of single-member groups count 0, None without points."""
    if not len(label):
        return None
    names, own = np.unique(label, return_inverse=True)
    one = np.eye(len(names))[own]
    size = one.sum(axis=0)
    sums = d @ one
    rows = np.arange(len(own))
    mates = size[own] - 1
    a = sums[rows, own] / np.maximum(mates, 1)
    mean = sums / size
    mean[rows, own] = np.inf
    b = mean.min(axis=1)
    ok = (mates > 0) & np.isfinite(b)
    return float(np.where(ok, (np.where(ok, b, 0) - a) / np.maximum(np.maximum(a, np.where(ok, b, 1)), 1e-300), 0.0).mean())


def silhouette(points: DataFrame, sample: DataFrame, key: str, x: str, label: str, metric: str = "euclidean") -> DataFrame:
    """(silhouette, n) over a stated sample against itself by one of the metrics of ``apart``; members of single-member groups count 0.

    Blocks of about 10,000 points of it go to every task in turn; each adds its distances by label to the sums of every point.
    """
    data = sample.select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.coalesce(F.col(label).cast("string"), F.lit("None")).alias("label"))
    # one row per label
    counts = sorted((r["label"], r["count"]) for r in data.groupBy("label").count().collect())
    if not counts:
        return sample.sparkSession.createDataFrame([(None, 0)], "silhouette double, n long")
    place, size = {name: i for i, (name, _) in enumerate(counts)}, np.array([n for _, n in counts], float)

    def adder(rows: list):
        all_, one = _matrix(rows, "x"), np.eye(len(place))[[place[r["label"]] for r in rows]]

        def add(batches):
            for b in batches:
                p, sums = _arrays(b["x"], b.num_rows), _arrays(b["sums"], b.num_rows).copy()
                for s in range(0, len(p), 256):
                    sums[s : s + 256] += apart(p[s : s + 256], all_, metric) @ one
                yield pa.RecordBatch.from_arrays([b["x"], b["label"], pa.array(sums.tolist(), pa.list_(pa.float64()))], ["x", "label", "sums"])

        return add

    def score(batches):
        for b in batches:
            sums, own = _arrays(b["sums"], b.num_rows), np.array([place[v] for v in b["label"].to_pylist()], int)
            rows = np.arange(len(sums))
            mates = size[own] - 1
            a = sums[rows, own] / np.maximum(mates, 1)
            mean = sums / size[None]
            mean[rows, own] = np.inf
            other = mean.min(axis=1)
            ok = (mates > 0) & np.isfinite(other)
            v = np.where(ok, (other - a) / np.maximum(np.maximum(a, np.where(ok, other, 1)), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(v)], ["v"])

    state = data.select("x", "label", F.array_repeat(F.lit(0.0), len(place)).alias("sums"))
    parts = _blocks(data, "key", SAMPLE_LIMIT)
    for part in parts:
        rows = part.select("x", "label").collect()
        if not rows:
            continue
        state = state.mapInArrow(adder(rows), "x array<double>, label string, sums array<double>")
        state = written(state, "silhouette") if len(parts) > 1 else state
    return state.mapInArrow(score, "v double").agg(F.round(F.avg("v"), 6).alias("silhouette"), F.count("*").alias("n"))


def dispersion(points: DataFrame, x: str, label: str, size: int) -> tuple[list, list[float], int, float]:
    """Per group (label, n, centre, mean distance, sum of squares), overall centre, n: sums over all points, one row per group."""
    mean = lambda: [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)]
    p = points.select(F.col(x).cast("array<double>").alias("x"), F.col(label).alias("label"))
    centres = {r["label"]: [r[f"m{i}"] for i in range(size)] for r in p.groupBy("label").agg(*mean()).collect()}
    whole = p.agg(*mean(), F.count("*").alias("n")).collect()[0]
    table = F.create_map(*[v for k, c in centres.items() for v in (F.lit(k), F.array(*[F.lit(float(z)) for z in c]))])
    d2 = squared_distance(F.col("x"), table[F.col("label")])
    groups = p.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w")).collect()
    return [(r["label"], r["n"], centres[r["label"]], r["s"], r["w"]) for r in groups], [whole[f"m{i}"] for i in range(size)], whole["n"], 0.0


def davies_bouldin(groups: list) -> float:
    worst = []
    for i, (_, _, ci, si, _) in enumerate(groups):
        worst.append(max((si + sj) / (math.dist(ci, cj) or math.inf) for j, (_, _, cj, sj, _) in enumerate(groups) if i != j))
    return sum(worst) / len(worst)


def calinski_harabasz(groups: list, centre: list[float], n: int) -> float:
    k = len(groups)
    between = sum(m * math.dist(c, centre) ** 2 for _, m, c, _, _ in groups)
    within = sum(w for *_, w in groups)
    return (between / (k - 1)) / (within / (n - k))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): from the contingency table, whatever the number of rows."""
    t = contingency(df, a, b)
    pairs = lambda c: c * (c - 1) / 2.0
    s = t.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ra = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    rb = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    # single rows
    return s.join(ra).join(rb).select(F.round(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)), 6).alias("ari"))


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """AMI (arithmetic mean). Cells are summed where they lie; only the sizes of the labels of either side reach the driver,
    how many labels have which size, at most ``MARGIN_LIMIT`` of them.

    The expected information takes, for each pair of sizes, the overlaps within 40 standard deviations of the expected one:
    beyond that their chance is below what a float holds.
    """
    cells = contingency(df, a, b)
    ra, rb = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    n = cells.agg(F.sum("n")).collect()[0][0] or 0
    many = [{r[0]: r[1] for r in m.groupBy(f"n{c}").count().limit(MARGIN_LIMIT + 1).collect()} for m, c in ((ra, "a"), (rb, "b"))]
    if max(map(len, many)) > MARGIN_LIMIT:
        raise ValueError(f"labels of more than {MARGIN_LIMIT} different sizes")
    if not n or all(list(m.items()) == [(n, 1)] for m in many):
        return 1.0
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"{c}.{c}"))
    met = cells.alias("l").join(ra.alias("a"), same("a")).join(rb.alias("b"), same("b"))
    share = F.col("l.n") / F.lit(float(n))
    mi = met.agg(F.sum(share * F.log(share * F.lit(float(n)) / F.col("na") * F.lit(float(n)) / F.col("nb")))).collect()[0][0]
    h = [-sum(k * v / n * math.log(v / n) for v, k in m.items()) for m in many]
    emi = sum(i * j * _expected_overlap(x, y, n) for x, i in many[0].items() for y, j in many[1].items())
    mean = sum(h) / 2
    return (mi - emi) / (mean - emi) if abs(mean - emi) > 1e-15 else 1.0


def _expected_overlap(x: int, y: int, n: int) -> float:
    """Expected information of the overlap of two random sets of x and y out of n."""
    g = math.lgamma
    middle = x * y / n
    sd = math.sqrt(max(middle * (n - x) * (n - y) / (n * max(n - 1, 1)), 1.0))
    low, high = max(1, x + y - n, math.floor(middle - 40 * sd)), min(x, y, math.ceil(middle + 40 * sd))
    fixed = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1)
    out = 0.0
    for k in range(low, high + 1):
        chance = math.exp(fixed - g(k + 1) - g(x - k + 1) - g(y - k + 1) - g(n - x - y + k + 1))
        out += k / n * math.log(n * k / (x * y)) * chance
    return out
