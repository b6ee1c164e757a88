"""Neighbour graphs: fuzzy weights, communities by modularity with refinement, stability over seeds.

Graphs of any size are first shrunk by rounds of local moves over the distributed edges, until what is left fits the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import task_slots, written

NODE_LIMIT = 50_000  # nodes and edges up to which a graph is settled on the driver
EDGE_LIMIT = 2_000_000
MOVES = 6  # rounds of local moves of a level
SETTLED = 0.01  # share of the nodes that must move for another round to follow


def local_move(edges: DataFrame, parts: DataFrame, total: float, turn: int, gamma: float, slots: int) -> DataFrame:
    """(a, c, k, went): half of the nodes, by hash, move to the neighbouring community that raises modularity most.

    ``edges`` lie by b already; the labels come to them, and one shuffle by a brings each node's links together.
    """
    strength = parts.groupBy("c").agg(F.sum("k").alias("kc"))
    label = parts.join(strength, "c").select(F.col("a").alias("b"), "c", "kc")
    to = edges.join(label, "b").repartition(slots, "a").groupBy("a", "c").agg(F.sum("w").alias("w"), F.first("kc").alias("kc"))
    here = parts.select("a", F.col("c").alias("own"), "k")
    gain = F.col("w") - F.lit(gamma / total) * F.col("k") * (F.col("kc") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0))
    # staying alone costs nothing: a node without edges into its own community gains by any positive move
    choice = F.struct(gain.alias("g"), F.xxhash64("c", F.lit(turn)).alias("h"), F.col("c").alias("to"))
    best = here.join(to, "a", "left").groupBy("a").agg(F.first("own").alias("c"), F.first("k").alias("k"), F.max_by("c", choice).alias("to"), F.max(gain).alias("g"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay"))
    go = F.coalesce((F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0) & (F.col("g") > F.coalesce("stay", F.lit(0.0)) + 1e-12), F.lit(False))
    return best.select("a", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), "k", go.alias("went"))


def shrink(edges: DataFrame, nodes: int, links: int, gamma: float = 1.0, moves: int = MOVES) -> tuple[DataFrame, DataFrame, int]:
    """A smaller graph (a, b, w) whose nodes are communities of symmetric ``edges``, the community (a, c) of every node, and the
    number of edges between different ones.

    Levels of local moves follow each other until at most ``nodes`` communities and ``links`` edges are left, or no edges
    between communities. A level that shrinks the graph by less than a tenth halves the resolution for the next.
    """
    level = written(edges, "edges")
    total = level.agg(F.sum("w")).collect()[0][0] or 1.0
    chain: list[DataFrame] = []
    before, slots = None, task_slots(edges.sparkSession)
    while True:
        parts = written(level.groupBy("a").agg(F.sum("w").alias("k")).select("a", F.col("a").alias("c"), "k"), "parts")
        count = parts.count()
        size = level.agg(F.count("*").alias("n"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("between")).collect()[0]
        if chain and (not size["between"] or count <= nodes and size["n"] <= links):
            break
        if before and count > 0.9 * before:
            gamma /= 2
        before = count
        # laid out once for all moves; a lost part is read again from the written table
        between = level.filter("a <> b").repartition(slots, "b").sortWithinPartitions("b").persist(StorageLevel.DISK_ONLY)
        for turn in range(moves):
            now = written(local_move(between, parts, total, len(chain) * moves + turn, gamma, slots), "parts")
            went = now.filter("went").count()
            parts = now.drop("went")
            if went < SETTLED * count:
                break
        between.unpersist()
        chain.append(parts.select("a", "c"))
        level = written(
            level.join(parts.select("a", F.col("c").alias("ca")), "a")
            .join(parts.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
            .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")),
            "level",
        )
    members = chain[0]
    for up in chain[1:]:
        members = members.join(up.select(F.col("a").alias("c"), F.col("c").alias("c2")), "c").select("a", F.col("c2").alias("c"))
    return level, written(members, "members"), size["between"]


def fuzzy_weights(near: DataFrame) -> DataFrame:
    """(a, b, w): symmetric membership strengths of (a, b, d).

    Each node's nearest distance counts as 0 and its scale is set so that its strengths add up to log2 of the number of
    neighbours (found by bisection, node by node); a + b - ab joins the two directions of an edge.
    """
    lists = near.groupBy("a").agg(F.collect_list(F.struct("b", "d")).alias("l"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, w = [], [], []
            for node, members in zip(batch["a"].to_pylist(), batch["l"].to_pylist()):
                d = np.array([m["d"] for m in members], float)
                s = _smooth(d)
                a += [node] * len(d)
                b += [m["b"] for m in members]
                w += s.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, batch["a"].type), pa.array(b, batch["a"].type), pa.array(w, pa.float64())], ["a", "b", "w"])

    kind = near.schema["a"].dataType.simpleString()
    one = lists.mapInArrow(run, f"a {kind}, b {kind}, w double")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n")).select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def _smooth(d: np.ndarray) -> np.ndarray:
    rho = d[d > 0].min() if (d > 0).any() else 0.0
    goal, low, high, sigma = math.log2(max(len(d), 2)), 0.0, math.inf, 1.0
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
        if abs(total - goal) < 1e-5:
            break
        if total > goal:
            high, sigma = sigma, (low + sigma) / 2
        else:
            low, sigma = sigma, sigma * 2 if high == math.inf else (sigma + high) / 2
    return np.exp(-np.maximum(d - rho, 0) / max(sigma, 1e-12))


def _moves(near: list[dict[int, float]], k: np.ndarray, c: np.ndarray, gamma: float, two_m: float, order: np.ndarray, bound: np.ndarray | None = None) -> bool:
    """Local moves until nothing gains; with ``bound``, nodes only join communities of their own part."""
    strength = np.bincount(c, weights=k, minlength=len(k)).astype(float)
    any_ = False
    for _ in range(30):
        moved = 0
        for i in order:
            links: dict[int, float] = defaultdict(float)
            for j, v in near[i].items():
                if bound is None or bound[j] == bound[i]:
                    links[c[j]] += v
            own = c[i]
            strength[own] -= k[i]
            best, to = links.get(own, 0.0) - gamma * k[i] * strength[own] / two_m, own
            for g, v in links.items():
                gain = v - gamma * k[i] * strength[g] / two_m
                if gain > best + 1e-12:
                    best, to = gain, g
            strength[to] += k[i]
            if to != own:
                c[i] = to
                moved += 1
        any_ |= moved > 0
        if not moved:
            break
    return any_


def partition(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, seed: int = 42, refine: bool = True) -> np.ndarray:
    """Communities of a symmetric graph: local moves, refinement within communities, aggregation, until stable.

    With ``refine`` the next level's nodes are the well-connected parts of each community rather than the whole
    community, which keeps a community from falling apart unseen.
    """
    label = np.arange(n)
    start: np.ndarray | None = None
    while True:
        near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        k = np.zeros(n)
        for i, j, v in zip(a.tolist(), b.tolist(), w.tolist()):
            k[i] += v
            if i != j:
                near[i][j] += v
        two_m = k.sum() or 1.0
        order = np.random.default_rng(seed).permutation(n)
        c = np.arange(n) if start is None else start.copy()
        changed = _moves(near, k, c, gamma, two_m, order)
        _, c = np.unique(c, return_inverse=True)
        if not changed and start is None:
            return c[label]
        parts = c
        if refine:
            parts = np.arange(n)
            _moves(near, k, parts, gamma, two_m, order, c)
            _, parts = np.unique(parts, return_inverse=True)
        m = int(parts.max()) + 1 if n else 0
        if m == n:
            return c[label]
        start = np.zeros(m, int)
        start[parts] = c
        label = parts[label]
        packed = parts[a].astype(np.int64) * m + parts[b]
        keys, inverse = np.unique(packed, return_inverse=True)
        w, a, b, n = np.bincount(inverse, weights=w), keys // m, keys % m, m


def graph_communities(edges: DataFrame, gamma: float = 1.0, least: int = 1, seed: int = 42, nodes: int = NODE_LIMIT, links: int = EDGE_LIMIT) -> DataFrame:
    """(id, label) of every node of symmetric (a, b, w), labels by falling size, -1 for communities under ``least`` nodes.

    Graphs of at most ``nodes`` and ``links`` are settled on the driver as they are, larger ones after ``shrink``: then the
    nodes that move together are its communities, and the rest is the same.
    """
    kind = edges.schema["a"].dataType.simpleString()
    small, members = edges.select("a", "b", "w"), None
    if edges.count() > links or edges.select("a").distinct().count() > nodes:
        small, members, between = shrink(small, nodes, links, gamma)
        if not between:  # nothing left to join: the communities are the labels
            return _ranked(members.select(F.col("a").alias("id"), "c"), least)
    e = small.toPandas()
    ids, flat = np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()]), return_inverse=True) if len(e) else (np.zeros(0, int), np.zeros(0, int))
    label = partition(flat[: len(e)], flat[len(e) :], e["w"].to_numpy(float), len(ids), gamma, seed) if len(e) else np.zeros(0, int)
    found = edges.sparkSession.createDataFrame([(i.item(), int(g)) for i, g in zip(ids, label)], f"id {kind}, c int")
    if members is not None:
        found = members.select(F.col("a").alias("id"), F.col("c").alias("of")).join(F.broadcast(found.withColumnRenamed("id", "of")), "of").select("id", "c")
    return _ranked(found, least)


def _ranked(found: DataFrame, least: int) -> DataFrame:
    """(id, label): communities c numbered by falling size, then by c."""
    found = written(found, "communities")
    size = found.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rank = size.select("c", (F.row_number().over(Window.orderBy(F.desc("n"), "c")) - 1).alias("label"))
    return found.join(rank, "c", "left").select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def stability(edges: DataFrame, runs: int = 5, gamma: float = 1.0) -> list[float]:
    """Adjusted Rand index of each of ``runs`` other seeds against the first partition."""
    from .clusters import adjusted_rand

    first = graph_communities(edges, gamma)
    out = []
    for s in range(runs):
        other = graph_communities(edges, gamma, seed=100 + s).withColumnRenamed("label", "other")
        out.append(float(adjusted_rand(first.join(other, "id"), "label", "other").collect()[0][0]))
    return out


def stability_report(edges: DataFrame, runs: int = 5, gamma: float = 1.0) -> list[dict]:
    """Adjusted Rand index and mutual information of ``runs`` other seeds against the first partition: mean, population sd and least."""
    from .clusters import adjusted_mutual_information, adjusted_rand

    first = graph_communities(edges, gamma)
    scores: dict[str, list[float]] = {"ari": [], "ami": []}
    for s in range(runs):
        both = written(first.join(graph_communities(edges, gamma, seed=100 + s).withColumnRenamed("label", "other"), "id"), "runs")
        scores["ari"].append(float(adjusted_rand(both, "label", "other").collect()[0][0]))
        scores["ami"].append(adjusted_mutual_information(both, "label", "other"))
    return [{"score": k, "runs": runs, "mean": float(np.mean(v)), "sd": float(np.std(v)), "least": min(v)} for k, v in scores.items() if v]
