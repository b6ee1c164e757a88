"""Records in groups of mutually similar ones.

An approximate nearest-neighbour graph of the distinct records is built by neighbour descent: random-projection leaves
give every record some neighbours, then each round compares the neighbours of a record, and those that it is a neighbour
of, with each other wherever one of them is new, and keeps whatever is nearer, until almost no list changes.

Communities of the symmetric, weighted graph are found by modularity: rounds of local moves over the distributed edges,
the communities becoming the nodes of a smaller graph. Once that is small, its communities are merged one pair after the
other, each time the pair that modularity joins at the highest resolution, until no links are left. Which step of that
hierarchy gives the groups is read off the resolutions at which it merges, so it needs no grid and doesn't depend on the
number of records: groups hold together over a wide range of resolutions.

Communities are described by size and by the members of highest internal weighted degree; members of very low
internal weighted degree are stragglers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import shrink
from ..session import task_slots, written

LEAST_NEIGHBOURS = 12  # of each record; more if ln(records) is larger, as connectivity needs
LEAF = 120  # records of a random-projection leaf
TREES = 3
CHUNK = 20_000  # records of a range of one projection that a task splits into leaves
CHANGE = 0.002  # share of all list entries that a round must renew for another to follow
DRIVER_NODES = 2_500  # communities up to which the hierarchy is built on the driver
DRIVER_EDGES = 100_000
STRAGGLER = 0.005  # share of all records under which a community is no group
MISSING = -128  # in a vector: the record lacks the number
UNKNOWN = 687  # squared difference that counts where one of two records lacks a number: that of two records drawn at random
DEGREE = 0.07  # share of its group's median internal weighted degree under which a record is a straggler


def neighbours(n: int) -> int:
    """Neighbours of each record in a graph of n: a graph of k nearest needs k in proportion to log n to hold together."""
    return max(LEAST_NEIGHBOURS, math.ceil(math.log(max(n, 2))))


def records(df: DataFrame, key: str, flags: tuple[str, ...], numbers: dict[str, tuple[float, float]]) -> DataFrame:
    """(row, key, x) of every row: flags as 0/1 and numbers, robustly scaled on the log scale, as one byte vector.

    Numbers outside their possible range, null and NaN are missing (-128): a record that lacks a number is equally far in it
    from all others, and so not set apart from its group. Null flags count as 0. ``row`` numbers the rows, so that null or
    repeated keys are records of their own.
    """
    value = lambda c: F.when((F.col(c).cast("double") >= numbers[c][0]) & (F.col(c).cast("double") <= numbers[c][1]) & ~F.isnan(F.col(c).cast("double")), F.log(F.col(c).cast("double")))
    q = df.agg(F.count("*").alias("n"), *[F.percentile_approx(value(c), [0.25, 0.5, 0.75], 1000).alias(c) for c in numbers]).collect()[0]
    parts = [F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, 50).otherwise(0) for c in flags]
    for c in numbers:
        low, mid, high = q[c] or (0.0, 0.0, 0.0)
        spread = high - low if high > low else 1.0
        scaled = F.greatest(F.least((value(c) - F.lit(mid)) / F.lit(spread), F.lit(2.5)), F.lit(-2.5))
        parts.append(F.when(value(c).isNull(), F.lit(MISSING)).otherwise(F.round(scaled * 25).cast("int")))  # greatest and least skip nulls
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.array(*[p.cast("tinyint") for p in parts]).alias("x"))


def vectors(rows: DataFrame, turn: int = 0) -> DataFrame:
    """(id, n, x): the distinct vectors of (row, key, x) and how many rows have each. The id is a hash of the vector, so that
    every choice made by it is the same whatever the order and partitions of the rows."""
    found = rows.groupBy("x").agg(F.count("*").alias("n"))
    return found.select(F.xxhash64(F.lit(turn), "x").alias("id"), "n", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return np.asarray(flat).astype(np.float32).reshape(len(column), -1)


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of x; infinite from a row to itself. Exact, as all terms are whole numbers below 2**24."""
    there = (x != MISSING).astype(np.float32)
    some = there.min(axis=0) == 0  # places where a row lacks the number
    x = x * there
    if some.any():
        q = x * x
        d = q @ there.T
        d += d.T - 2 * x @ x.T
        m = there[:, some]
        d += UNKNOWN * (m.shape[1] - m @ m.T)
    else:
        q = (x * x).sum(1)
        d = q[:, None] + q[None, :] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return d


def _leaves(x: np.ndarray, rng: np.random.Generator, leaf: int) -> Iterator[np.ndarray]:
    """Random-projection splits at the median until a leaf is small; equal records are split all the same."""
    x = np.where(x == MISSING, 0, x)
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        a, b = x[rng.choice(at, 2, replace=False)]
        side = x[at] @ (a - b) + rng.normal(scale=1e-3, size=len(at))
        order = np.argsort(side, kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def _first_neighbours(nodes: DataFrame, tree: int, k: int, leaf: int, chunk: int, ranges: int) -> DataFrame:
    """(a, b, d): neighbours within the leaves of one tree over ranges of one random projection."""
    size = len(nodes.select("x").head(1)[0][0])
    plane = np.random.default_rng(100 + tree).normal(size=size)
    score = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(p)) for p in plane]), lambda u, v: F.when(u == MISSING, F.lit(0.0)).otherwise(u * v)), F.lit(0.0), lambda s, v: s + v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, x = np.asarray(t["id"]), _matrix(t["x"])
            rng = np.random.default_rng(tree)
            a, b, d = [], [], []
            for at in _leaves(x, rng, leaf):
                if len(at) < 2:
                    continue
                dist = _squared(x[at])
                m = min(k, len(at) - 1)
                near = np.argpartition(dist, m - 1, axis=1)[:, :m]
                a.append(np.repeat(ids[at], m))
                b.append(ids[at][near].ravel())
                d.append(np.take_along_axis(dist, near, 1).ravel())
            return _nearest(a, b, d, k)

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * chunk:  # ranges are only about even
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    # as many ranges as hold a chunk each, whatever the number of partitions elsewhere: narrower ones cut neighbours apart
    return nodes.select("id", "x", score.alias("s")).repartitionByRange(ranges, "s", "id").sortWithinPartitions("s", "id").select("id", "x").mapInArrow(run, "a long, b long, d float")


def _nearest(a: list[np.ndarray], b: list[np.ndarray], d: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The k nearest distinct b of each a among the pairs, as (a, b, d)."""
    cat = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
    x, y, z = cat(a, np.int64), cat(b, np.int64), cat(d, np.float32)
    order = np.lexsort((y, z, x))
    x, y, z = x[order], y[order], z[order]
    if len(x):
        once = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        x, y, z = x[once], y[once], z[once]
        start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        near = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)])) < k
        x, y, z = x[near], y[near], z[near]
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z)], ["a", "b", "d"])


def _groups_of(batches: Iterator[pa.RecordBatch], key: str, f: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f of tables that hold all rows of their keys, from batches sorted by the key."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        last = int(np.searchsorted(np.asarray(t[key]), t[key][-1].as_py())) if t.num_rows else 0
        if last:
            yield f(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield f(rest)


def _best(pairs: DataFrame, k: int, slots: int) -> DataFrame:
    """(a, b, d, new, rank, worst): the k nearest distinct neighbours of each record, ranked from 0, ties by id; new are those
    that weren't ``old``; ``worst`` is the distance of the last, infinite if there are fewer than k."""

    def keep(t: pa.Table) -> pa.RecordBatch:
        a, b, d, old = (np.asarray(t[c]) for c in ("a", "b", "d", "old"))
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # the old one comes first
        a, b, d, old = a[once], b[once], d[once], old[once]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[start, len(a)])
        rank = np.arange(len(a)) - np.repeat(start, size)
        worst = np.repeat(np.where(size >= k, d[start + np.minimum(size, k) - 1], np.inf), size).astype(np.float32)
        m = rank < k
        return pa.RecordBatch.from_arrays([pa.array(a[m]), pa.array(b[m]), pa.array(d[m]), pa.array(~old[m]), pa.array(rank[m].astype(np.int32)), pa.array(worst[m])], ["a", "b", "d", "new", "rank", "worst"])

    laid = pairs.repartition(slots, "a").sortWithinPartitions("a", "d", "b", F.col("old").desc()).select("a", "b", "d", "old")
    return laid.mapInArrow(lambda batches: _groups_of(batches, "a", keep), "a long, b long, d float, new boolean, rank int, worst float")


def _descend(nodes: DataFrame, graph: DataFrame, k: int, turn: int, slots: int) -> DataFrame:
    """One round of neighbour descent: better neighbours found among neighbours of neighbours, as (a, b, d).

    Only pairs of which one is new are compared, as the others have been. Of a record that very many point at, an even
    choice of about three times ``k``, another in each round, speaks; those not chosen lose nothing, their own lists stay.
    """
    ends = F.array(F.struct(F.col("a").alias("centre"), F.col("b").alias("id"), F.lit(0).alias("back")), F.struct(F.col("b").alias("centre"), F.col("a").alias("id"), F.lit(1).alias("back")))
    around = Window.partitionBy("centre")
    draw = F.pmod(F.xxhash64("id", "centre", F.lit(turn)), F.lit(1 << 20)) * F.col("pointing") < F.lit(3 * k << 20)
    members = (
        graph.select("new", F.inline(ends))
        .withColumns({"pointing": F.sum("back").over(around), "moves": F.max("new").over(around)})
        .filter(F.col("moves") & ((F.col("back") == 0) | draw)).select("centre", "id", "new")
    )
    loaded = members.join(nodes.select("id", "x"), "id").join(graph.filter("rank = 0").select(F.col("a").alias("id"), "worst"), "id")

    def found(t: pa.Table) -> pa.RecordBatch:
        centre, ids, worst_, x, new = np.asarray(t["centre"]), np.asarray(t["id"]), np.asarray(t["worst"]), _matrix(t["x"]), np.asarray(t["new"])
        start = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
        end = np.r_[start[1:], len(centre)]
        a, b, d = [], [], []
        for s, e in zip(start, end):
            dist = _squared(x[s:e])
            i, j = np.nonzero((dist < worst_[s:e][:, None]) & (new[s:e][:, None] | new[s:e][None, :]) & (ids[s:e][:, None] != ids[s:e][None, :]))
            a.append(ids[s:e][i])
            b.append(ids[s:e][j])
            d.append(dist[i, j])
        return _nearest(a, b, d, k)

    laid = loaded.repartition(slots, "centre").sortWithinPartitions("centre", "id")
    return laid.select("centre", "id", "new", "worst", "x").mapInArrow(lambda batches: _groups_of(batches, "centre", found), "a long, b long, d float")


def neighbour_graph(nodes: DataFrame, k: int | None = None, trees: int = TREES, change: float = CHANGE, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """(a, b, d): approximately the k nearest neighbours b of every record a of (id, x), by distance squared.

    ``k``: by default as ``neighbours`` has it. Rounds of descent go on until one renews at most the share ``change`` of the
    list entries; as lists only get nearer, that comes. Every record with at least one other has neighbours; frames of none
    or one give an empty graph.
    """
    n = nodes.count()
    k = k or neighbours(n)
    ranges, slots = max(1, round(n / chunk)), task_slots(nodes.sparkSession)
    if n:
        found = _first_neighbours(nodes, 0, k, leaf, chunk, ranges)
        for t in range(1, trees):
            found = found.unionByName(_first_neighbours(nodes, t, k, leaf, chunk, ranges))
    else:
        found = nodes.sparkSession.createDataFrame([], "a long, b long, d float")
    graph = written(_best(found.withColumn("old", F.lit(False)), k, slots), "graph")
    turn = 0
    while True:
        old = graph.select("a", "b", "d", F.lit(True).alias("old"))
        better = _descend(nodes, graph, k, turn, slots).withColumn("old", F.lit(False))
        graph = written(_best(old.unionByName(better), k, slots), "graph")
        renewed = graph.agg(F.avg(F.col("new").cast("int"))).collect()[0][0] or 0.0
        if renewed <= change:
            return graph.select("a", "b", "d")
        turn += 1


def weighted_edges(graph: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(a, b, w) in both directions: similarity falls with distance relative to the typical distance; mutual edges count twice.

    ``copies`` (id, n): a record of n equal rows has these for neighbours first, as a loop of weight 2 each, up to as many as
    its list is long.
    """
    scale = graph.agg(F.percentile_approx("d", 0.5, 1000)).collect()[0][0] or 1.0
    w = F.exp(-F.col("d") / F.lit(float(scale)))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = graph.select(w.alias("w"), F.inline(both)).groupBy("a", "b").agg(F.sum("w").alias("w"))
    if copies is None:
        return edges
    longest = graph.groupBy("a").count().agg(F.max("count")).collect()[0][0] or 1
    loops = copies.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), (F.least(F.col("n") - 1, F.lit(longest)) * 2.0).alias("w"))
    return edges.unionByName(loops)


def communities(edges: DataFrame, copies: DataFrame, min_groups: int = 1, max_groups: int = 1_000_000, straggler: float = STRAGGLER) -> DataFrame:
    """(a, c): the group of every node of (a, b, w), numbered from 0 by size; -1 for communities too small to be one.

    ``edges`` are symmetric; ``copies`` (id, n) has the rows that each node stands for. Levels of local moves shrink the graph
    until it has at most ``DRIVER_NODES`` communities and ``DRIVER_EDGES`` edges. Only that summary, checked for its size,
    goes to the driver, where ``cut_tree`` chooses the groups. If no links are left before it is small, its communities
    are what there is to find, and only those with the share ``straggler`` of the rows are groups.
    """
    if not edges.head(1):
        return edges.select("a").withColumn("c", F.lit(-1).cast("long"))
    level, members, between = shrink(edges, DRIVER_NODES, DRIVER_EDGES)
    mass = members.join(copies.select(F.col("id").alias("a"), "n"), "a").groupBy("c").agg(F.sum("n").alias("n"))
    if between:
        small = level.toPandas()
        weights = {r["c"]: r["n"] for r in mass.collect()}  # one of at most DRIVER_NODES communities
        labels = cut_tree(small["a"].to_numpy(), small["b"].to_numpy(), small["w"].to_numpy(), weights, min_groups, max_groups, straggler)
    else:
        least = straggler * (copies.agg(F.sum("n")).collect()[0][0] or 0)
        big = mass.filter(F.col("n") >= F.lit(least)).collect()  # at most 1 / straggler
        labels = {r["c"]: i for i, r in enumerate(sorted(big, key=lambda r: (-r["n"], r["c"])))}
    table = edges.sparkSession.createDataFrame([(int(c), int(g)) for c, g in labels.items()], "c long, g long")
    return members.join(F.broadcast(table), "c", "left").select("a", F.coalesce("g", F.lit(-1).cast("long")).alias("c"))


def merge_tree(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> list[tuple[float, int, int]]:
    """(resolution, i, j) of every merge of a symmetric graph of n nodes (loops allowed), the highest resolution first.

    Modularity gains by joining i and j up to the resolution w_ij * total / (k_i * k_j). The pair for which it is highest is
    joined, as ``n``, ``n + 1``, ..., until no links are left. Ties go to the smaller numbers.
    """
    links: list[dict[int, float]] = [{} for _ in range(n)]
    k = [0.0] * n
    for i, j, v in zip(a.tolist(), b.tolist(), w.tolist()):
        k[i] += v
        if i != j:
            links[i][j] = links[i].get(j, 0.0) + v
    total = sum(k) or 1.0
    heap = [(-v * total / (k[i] * k[j]), i, j) for i in range(n) for j, v in links[i].items() if i < j]
    heapq.heapify(heap)
    gone: set[int] = set()
    out = []
    while heap:
        top, i, j = heapq.heappop(heap)
        if i in gone or j in gone:
            continue
        new = len(links)
        out.append((-top, i, j))
        gone |= {i, j}
        joint: dict[int, float] = {}
        for x in (i, j):
            for y, v in links[x].items():
                if y not in gone:
                    joint[y] = joint.get(y, 0.0) + v
            links[x] = {}
        k.append(k[i] + k[j])
        links.append(joint)
        for y, v in joint.items():
            links[y][new] = v
            links[y].pop(i, None)
            links[y].pop(j, None)
            heapq.heappush(heap, (-v * total / (k[new] * k[y]), y, new))
    return out


def cut_tree(a: np.ndarray, b: np.ndarray, w: np.ndarray, weights: dict[int, int], min_groups: int, max_groups: int, straggler: float) -> dict[int, int]:
    """The group of each node of the summary graph, by size from 0; nodes of communities under the straggler share are -1.

    Of all steps of the merge tree with ``min_groups`` to ``max_groups`` communities larger than stragglers, those belong
    together between which that number stays. The stretch over the widest range of resolutions (as a ratio) is taken, at
    its end: everything smaller has then joined the community that its links point to. Resolutions under that at which a
    single link would join the two largest of the last communities can't be told from none. If no step has such a number,
    the nearest number counts, the larger one first.
    """
    ids = np.array(sorted(weights))
    at = {int(v): i for i, v in enumerate(ids)}
    merges = merge_tree(np.array([at[int(v)] for v in a], int), np.array([at[int(v)] for v in b], int), w, len(ids))
    mass = [float(weights[int(v)]) for v in ids]
    least = straggler * sum(mass)
    big = sum(m >= least for m in mass)
    strength = np.bincount([at[int(v)] for v in a], weights=w, minlength=len(ids)).tolist()
    # number of communities, from which resolution, to which, after how many merges
    stretches: list[list] = [[big, max([1.0, *(m[0] for m in merges[:1])]), 0.0, len(merges)]]
    for step, (gamma, i, j) in enumerate(merges, 1):
        mass.append(mass[i] + mass[j])
        strength.append(strength[i] + strength[j])
        now = big - (mass[i] >= least) - (mass[j] >= least) + (mass[-1] >= least)
        if now != big:
            stretches[-1][2:] = [gamma, step - 1]
            stretches.append([now, gamma, 0.0, len(merges)])
        big = now
    miss = lambda s: max(min_groups - s[0], s[0] - max_groups, 0)
    joined = {x for _, i, j in merges for x in (i, j)}
    last = sorted((strength[x] for x in range(len(strength)) if x not in joined), reverse=True)
    floor = w.sum() / max(last[0] * last[1], 1e-300) if len(last) > 1 and last[1] > 0 else 1e-300
    width = lambda s: max(s[1], floor) / max(s[2], floor)
    best = min(stretches, key=lambda s: (miss(s), -width(s), -s[0]))
    root = list(range(len(ids) + best[3]))
    for new, (_, i, j) in enumerate(merges[: best[3]], len(ids)):
        root[i] = root[j] = new
    for x in range(len(root) - 1, -1, -1):  # a node's parent is always later
        root[x] = root[root[x]]
    label = np.array(root[: len(ids)])
    sums = {int(g): float(sum(mass[i] for i in np.flatnonzero(label == g))) for g in np.unique(label)}
    rank = {g: i for i, (g, m) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0]))) if m >= least}
    return {int(v): rank.get(int(g), -1) for v, g in zip(ids, label)}


def _to_rows(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(row, key, id, group) of the rows; vectors that over 1 % of the rows have go by a broadcast of at most 100."""
    own = rows.select("row", "key", F.xxhash64(F.lit(0), "x").alias("id"))
    n = nodes.agg(F.sum("n")).collect()[0][0] or 0
    hot = nodes.filter(F.col("n") > F.lit(0.01 * n)).select("id")
    label = found.select(F.col("a").alias("id"), F.col("c").cast("int").alias("group"))
    often = own.join(F.broadcast(hot.join(label, "id", "left")), "id")
    rest = own.join(F.broadcast(hot), "id", "left_anti").join(label, "id", "left")
    return often.unionByName(rest).select("row", "key", "id", F.coalesce("group", F.lit(-1)).alias("group"))


def group_records(df: DataFrame, key: str, flags: tuple[str, ...], numbers: dict[str, tuple[float, float]], min_groups: int, max_groups: int) -> tuple[DataFrame, DataFrame]:
    """The rows (row, key, id, group), and the distinct records (id, n, group, degree) with their number of rows.

    Groups are numbered from 0 by size; -1 are stragglers: records of communities too small to be a group, and those whose
    internal weighted degree is under ``DEGREE`` of their group's median. Equal rows are one record of the graph and get
    the same group. An empty frame gives empty results.
    """
    rows = written(records(df, key, flags, numbers), "rows")
    nodes = written(vectors(rows), "nodes")
    if nodes.count() != nodes.select("id").distinct().count():
        raise RuntimeError("two records share a hash of 64 bits")
    edges = written(weighted_edges(neighbour_graph(nodes), nodes), "edges")
    found = written(communities(edges, nodes, min_groups, max_groups), "found")
    label = found.filter("c >= 0")
    inside = (
        edges.join(label, "a").join(label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
        .filter(F.col("c") == F.col("cb")).groupBy("a").agg(F.sum("w").alias("degree"))
    )
    degrees = written(found.join(inside, "a", "left").select("a", "c", F.coalesce("degree", F.lit(0.0)).alias("degree")), "degrees")
    usual = degrees.filter("c >= 0").groupBy("c").agg(F.percentile_approx("degree", 0.5, 1000).alias("usual"))  # a row for each group
    settled = degrees.join(F.broadcast(usual), "c", "left").select("a", F.when(F.col("degree") >= DEGREE * F.col("usual"), F.col("c")).otherwise(F.lit(-1)).alias("c"), "degree")
    settled = written(settled, "settled")
    described = nodes.select("id", "n").join(settled.withColumnRenamed("a", "id"), "id", "left")
    return _to_rows(rows, nodes, settled), described.select("id", "n", F.coalesce("c", F.lit(-1)).cast("int").alias("group"), F.coalesce("degree", F.lit(0.0)).alias("degree"))


def describe_groups(rows: DataFrame, described: DataFrame, top: int = 5) -> DataFrame:
    """(group, size, share, rank, key, degree): the ``top`` members of highest internal weighted degree; ties by key, row.

    Takes what ``group_records`` gives. The best records of each group are found first, by partial lists; only their rows are ordered.
    """
    first = F.struct((-F.col("degree")).alias("d"), "id")
    best = (
        described.groupBy("group", F.pmod(F.col("id"), F.lit(64)).alias("salt")).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list(first)), 1, top).alias("t"))
        .groupBy("group").agg(F.sum("n").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, top).alias("t"))
    )
    typical = F.struct("d", "key", "row")
    # the rows of at most ``top`` records of a group; copies are cut to ``top`` before they meet
    wanted = best.select("group", "size", F.inline("t"))
    named = (
        rows.join(F.broadcast(wanted), ["group", "id"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
        .groupBy("group", "salt").agg(F.first("size").alias("size"), F.slice(F.array_sort(F.collect_list(typical)), 1, top).alias("t"))
        .groupBy("group").agg(F.first("size").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, top).alias("t"))
    )
    total = described.agg(F.sum("n")).collect()[0][0] or 1
    return named.select("group", "size", (F.col("size") / F.lit(total)).alias("share"), F.posexplode("t").alias("rank", "m")).select("group", "size", "share", (F.col("rank") + 1).alias("rank"), F.col("m.key").alias("key"), (-F.col("m.d")).alias("degree"))
