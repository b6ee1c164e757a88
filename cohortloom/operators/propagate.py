"""Missing values filled from similar records by label propagation over group-and-similarity edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..session import written

TABLES = 6  # independent similarity groupings of the records for each column
AIM = 40  # records that a similarity group holds on average
ROUNDS = 10  # at most
SETTLED = 1e-3  # mean change of the fills, in spreads of their column, that ends the rounds


def real(column: Column, low: float, high: float) -> Column:
    """The number if it can be one of a living patient, else null (null, NaN and stand-ins such as 999 included)."""
    c = column.cast("double")
    return F.when((c >= low) & (c <= high) & ~F.isnan(c), c)


def _scaled(column: Column, quartiles: list[float] | None) -> Column:
    """Robustly scaled, on the log scale where the middle half is positive; a missing value counts as the middle."""
    low, mid, high = quartiles or (0.0, 0.0, 0.0)
    if low > 0:
        column, low, mid, high = F.log(F.when(column > 0, column)), math.log(low), math.log(mid), math.log(high)
    spread = high - low if high > low else 1.0
    return F.coalesce(clip((column - F.lit(mid)) / spread, 6.0), F.lit(0.0))


def _regressions(base: DataFrame, numeric: list[str], features: list[str], n: int) -> dict[str, tuple[np.ndarray, float]]:
    """Ridge weights of the features (and a constant) for each column, and the spread of the weighted sum.

    Each task sums the moments of its rows; the driver gets one number per pair of features and column.
    """
    size = len(features) + 1
    skip = [[i for i, f in enumerate(features) if f == c] for c in numeric]

    def run(batches):
        total = np.zeros((len(numeric), size + 1, size + 1))
        for b in batches:
            x = np.asarray(b["_x"].flatten()).reshape(b.num_rows, size)
            for k, c in enumerate(numeric):
                y = b[f"_v_{c}"].to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(y)
                z = np.column_stack([x[ok], y[ok]])
                total[k] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    sums = base.select("_x", *[f"_v_{c}" for c in numeric]).mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((len(numeric), size + 1, size + 1))
    total.ravel()[[r["at"] for r in sums]] = [r["value"] for r in sums]
    out = {}
    for k, c in enumerate(numeric):
        gram, target = total[k, :size, :size].copy(), total[k, :size, size].copy()
        seen = gram[size - 1, size - 1]
        gram[skip[k], :], gram[:, skip[k]], target[skip[k]] = 0, 0, 0
        w = np.linalg.solve(gram + np.eye(size) * (1.0 + 1e-6 * seen), target)
        w[skip[k]] = 0
        mean = (gram[size - 1] @ w) / max(seen, 1)
        out[c] = w, float(max(math.sqrt(max((w @ gram @ w) / max(seen, 1) - mean * mean, 0.0)), 1e-6))
    return out


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of whole numbers, element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


class _Hubs:
    """The hubs of each record for each column: its group, and an interval of the column's score in every table."""

    def __init__(self, scores: list[tuple[np.ndarray, float]], shifts: np.ndarray, grouped: bool) -> None:
        self.scores, self.shifts, self.grouped = scores, shifts, grouped

    def __call__(self, k: int, x: np.ndarray | None, group: np.ndarray) -> np.ndarray:
        """Of column k, one row per record."""
        out = [_mixed(k, -1, group)] if self.grouped or not self.scores else []
        if self.scores:
            w, width = self.scores[k]
            at = np.clip((x @ w) / width, -1e15, 1e15)
            for t, shift in enumerate(self.shifts[k]):
                cell = np.floor(at + shift).astype(np.int64)
                out.append(_mixed(k, t, cell, *([group] if t % 2 else [])))
        return np.column_stack(out)


def fill_missing(
    df: DataFrame,
    key: str,
    numeric: dict[str, tuple[float, float]],
    categorical: tuple[str, ...] = (),
    groups: tuple[str, ...] = (),
    features: tuple[str, ...] = (),
    tables: int = TABLES,
    aim: int = AIM,
    rounds: int = ROUNDS,
    seed: int = 7,
) -> DataFrame:
    """``df`` with the columns of ``numeric`` and ``categorical`` filled, a boolean ``<column>_filled`` for each, and
    ``<column>_basis``: ``similar`` if similar records gave the value, ``overall`` if none of them had one, null if observed.

    ``numeric`` maps a column to the range of possible values; anything else there is taken as missing. A categorical
    column lacks a value where it is null or blank.

    Records are linked through hubs: for every column to fill one for the combination of ``groups`` (same group), and
    ``tables`` hubs of records that are similar in what bears on that column: the features are weighted by a ridge
    regression of the column (from moments summed over all records, positive features on the log scale), and a hub is
    one interval of that weighted sum, the intervals of each table shifted anew and so narrow that they hold about
    ``aim`` records, however many there are. Every other table also keeps the groups apart. Observed cells are clamped: what
    they give a hub is summed once. In each round a hub takes the mean of its members' numbers and the distribution of
    their categories, and every missing cell the average over its hubs, tighter hubs weighing more, until the fills
    settle. As a hub stands for all pairs of its members, the edges are a fixed multiple of the records and no pair is
    ever formed; a hub with a third of all records is a partial aggregate like any other. Categories have the hubs of
    their group, and of all numeric columns.

    A cell no hub of which has an observed value gets the overall mean (most frequent category); a column without any
    observed value stays null. Rows with a null or repeated ``key`` are rows like any other. Columns of ``df`` named as
    the results are replaced. An empty frame gives an empty frame.
    """
    names = [*numeric, *categorical]
    lines = df.drop(*[f"{c}_{x}" for c in names for x in ("filled", "basis")])
    kept = lines.columns
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    observed = [real(F.col(c), *span).alias(f"_v_{c}") for c, span in numeric.items()] + [blank(c).alias(f"_v_{c}") for c in categorical]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    spans = {c: real(F.col(c), *numeric[c]) if c in numeric else number(c) for c in features}
    stats = lines.agg(
        F.count("*").alias("_n"),
        *[a for c in numeric for a in (F.avg(real(F.col(c), *numeric[c])).alias(f"_m_{c}"), F.stddev_pop(real(F.col(c), *numeric[c])).alias(f"_s_{c}"))],
        *[F.mode(blank(c), deterministic=True).alias(f"_m_{c}") for c in categorical],
        *[F.percentile_approx(spans[c], [0.25, 0.5, 0.75], 1000).alias(f"_q_{c}") for c in features],
    ).collect()[0]
    group = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in groups]) if groups else F.lit(0).cast("long")
    vector = F.array(*[_scaled(spans[c], stats[f"_q_{c}"]) for c in features], F.lit(1.0))
    # written once, so that the row numbers stay the same in every round
    base = written(lines.select(F.struct(*kept).alias("_row"), F.monotonically_increasing_id().alias("_id"), *observed, group.alias("_g"), vector.alias("_x")), "fill-rows")
    scores: list[tuple[np.ndarray, float]] = []
    if features and numeric:
        weights = _regressions(base, list(numeric), list(features), stats["_n"])
        # most scores lie within five spreads
        scores = [(weights[c][0], 5 * weights[c][1] / max(4.0, stats["_n"] / aim)) for c in numeric]
    hubs = _Hubs(scores, np.random.default_rng(seed).random((len(numeric), tables)), bool(groups))
    # a category asks the hubs of all numeric columns
    own = {c: [k] if k < len(numeric) else list(range(len(numeric))) or [0] for k, c in enumerate(names)}
    if not scores:
        own = {c: [0] for c in names}
    size = len(features) + 1

    def of(b: pa.RecordBatch, c: str, rows: np.ndarray) -> np.ndarray:
        x = np.asarray(b["_x"].flatten()).reshape(b.num_rows, size)[rows] if scores else None
        g = np.asarray(b["_g"])[rows]
        # columns keep apart, as each counts its own values
        return _mixed(names.index(c), np.column_stack([hubs(k, x, g) for k in own[c]]))

    def linked(mine: list[str], missing: bool) -> DataFrame:
        """(_hub, _id, _k) of the missing cells of the columns, or (_hub, _v) of the observed ones, in one pass."""

        def run(batches):
            for b in batches:
                parts = []
                for k, c in enumerate(mine):
                    rows = np.flatnonzero(b[f"_v_{c}"].is_null() if missing else b[f"_v_{c}"].is_valid())
                    at = of(b, c, rows)
                    again = pa.array(np.repeat(rows, at.shape[1]))
                    parts.append([pa.array(at.ravel()), b["_id"].take(again), pa.array(np.full(at.size, k, np.int32))] if missing else [pa.array(at.ravel()), b[f"_v_{c}"].take(again)])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in zip(*parts)], ["_hub", "_id", "_k"] if missing else ["_hub", "_v"])

        kind = "_id long, _k int" if missing else f"_v {'double' if mine[0] in numeric else 'string'}"
        return base.select("_id", "_g", "_x", *[f"_v_{c}" for c in mine]).mapInArrow(run, f"_hub long, {kind}")

    done = base.select("_row", "_id", *[f"_v_{c}" for c in names])
    for mine in (list(numeric), list(categorical)):
        if mine:
            spreads = [float(stats[f"_s_{c}"] or 1.0) for c in mine] if mine[0] in numeric else None
            step = _propagate(linked(mine, False), linked(mine, True), spreads, rounds)
            fills = step.groupBy("_id").agg(*[F.max(F.when(F.col("_k") == k, F.col("_f"))).alias(f"_f_{c}") for k, c in enumerate(mine)])
            done = done.join(fills, "_id", "left")
    fallback = {c: F.lit(stats[f"_m_{c}"]).cast("double" if c in numeric else "string") for c in names}
    result = [F.coalesce(f"_v_{c}", f"_f_{c}", fallback[c]).alias(c) if c in names else F.col(f"_row.`{c}`").alias(c) for c in kept]
    for c in names:
        there = F.col(f"_v_{c}").isNull() & fallback[c].isNotNull()
        basis = F.when(there, F.when(F.col(f"_f_{c}").isNotNull(), "similar").otherwise("overall"))
        result += [there.alias(f"{c}_filled"), basis.alias(f"{c}_basis")]
    return done.select(*result)


def _propagate(known: DataFrame, ask: DataFrame, spreads: list[float] | None, rounds: int) -> DataFrame:
    """(_id, _k, _f) of the cells in ``ask`` (_hub, _id, _k), from the observed values ``known`` (_hub, _v) of the hubs; hubs of
    different columns are different. ``spreads``: of the numeric columns; None for categories."""
    ask = written(ask, "fill-ask")
    size = ask.groupBy("_hub").agg(F.count("*").alias("k"))
    total = ask.count()
    # hubs that many cells ask (a group with a third of all records) come to them by a broadcast of at most 100
    often = written(size.filter(F.col("k") > F.lit(0.01 * total)).select("_hub"), "fill-often")
    many, rest = ask.join(F.broadcast(often), "_hub", "left_semi"), ask.join(F.broadcast(often), "_hub", "left_anti")
    told = lambda hub: many.join(F.broadcast(hub.join(F.broadcast(often), "_hub", "left_semi")), "_hub").unionByName(rest.join(hub, "_hub"))
    cell = ["_id", "_k"]
    filled = lambda now: ask.join(now, cell).select("_hub", F.col("_f").alias("_v"))
    current: DataFrame | None = None
    if spreads is not None:
        spread = F.array(*[F.lit(v) for v in spreads])[F.col("_k")]
        moments = lambda df: df.groupBy("_hub").agg(F.count("_v").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
        fixed = written(moments(known), "fill-hubs")
        for _ in range(rounds):
            hub = fixed if current is None else fixed.unionByName(moments(filled(current))).groupBy("_hub").agg(*[F.sum(x).alias(x) for x in ("n", "s", "q")])
            # a hub with few members or spread-out values says less; its prior variance is the column's
            mean = F.col("s") / F.col("n")
            var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
            weight = 1 / ((F.col("var") * F.col("n") + 4 * spread * spread) / (F.col("n") + 4) * (1 + 1 / F.col("n")))
            step = told(hub.select("_hub", mean.alias("m"), var.alias("var"), "n")).withColumn("w", weight).groupBy(*cell).agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("_f"))
            before, current = current, written(step, "fill-round")
            if before is not None:
                moved = current.join(before.withColumnRenamed("_f", "_b"), cell, "left").agg(F.avg(F.abs(F.col("_f") - F.coalesce("_b", F.lit(0.0))) / spread)).collect()[0][0] or 0.0
                if moved <= SETTLED:
                    break
        return current
    counts = lambda df: df.groupBy("_hub", "_v").agg(F.count("*").alias("k"))
    fixed = written(counts(known), "fill-hubs")
    for _ in range(rounds):
        each = fixed if current is None else fixed.unionByName(counts(filled(current))).groupBy("_hub", "_v").agg(F.sum("k").alias("k"))
        hub = each.join(each.groupBy("_hub").agg(F.sum("k").alias("n")), "_hub").select("_hub", "_v", (F.col("k") / F.col("n")).alias("share"))
        # a hub has a row for each of its categories; the broadcast is of the most asked hubs times those
        votes = told(hub).groupBy(*cell, "_v").agg(F.sum("share").alias("p"))
        step = votes.groupBy(*cell).agg(F.max_by("_v", F.struct("p", "_v")).alias("_f"))
        before, current = current, written(step, "fill-round")
        if before is not None and not current.join(before.withColumnRenamed("_f", "_b"), cell, "left").filter(~F.col("_f").eqNullSafe(F.col("_b"))).head(1):
            break
    return current
