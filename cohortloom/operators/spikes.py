"""Implausible readings of a source (one patient's series of one attribute): impossible values, spikes, stuck runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import task_slots, written

# What a living patient can have, in common units (systolic and diastolic for bp).
BOUNDS = {
    "bp": (20.0, 400.0),
    "bp_diastolic": (5.0, 300.0),
    "pulse": (8.0, 400.0),
    "temperature": (13.0, 47.0),
    "respirations": (2.0, 120.0),
    "spo2": (10.0, 100.5),
    "height": (25.0, 275.0),
    "weight": (1.5, 640.0),
    "bmi": (6.0, 210.0),
    "potassium": (0.8, 15.0),
}
# Spread of a person's readings around their level that is usual, in common units. A short series' own
# spread is a poor estimate; it counts as if ten readings of the usual spread had been seen beside its own.
USUAL = {"bp": 5.0, "pulse": 3.5, "temperature": 0.2, "respirations": 1.5, "spo2": 1.3, "height": 0.6, "weight": 1.0, "bmi": 0.4, "potassium": 0.17}
USUAL_WEIGHT = 10
SIDE = 6  # neighbours on each side that make the level around a day
NEED = 10  # distinct readings that a series needs for spikes
STUCK = 7  # successive identical readings that are stuck
SPREADS = 5.3  # half axes of the ellipsoids in ordinary spreads (shrunk towards the usual one); "about six" of its own
SIDES = 0.8  # share of the half axis by which a spike must leave the readings before it and those after it
HOT = 20_000  # readings of a series beyond which it is cut into chunks
BROADCAST_SERIES = 4_000  # long series up to which their cuts are sent to every task
PER_CHUNK = 8  # bins of a chunk of a long series; the two nearest of the next one go along as context


def impossible(attribute: Column, x: Column, y: Column) -> Column:
    """Whether no living patient can have the reading; a diastolic not below its systolic included. Never null."""
    out = F.lit(False)
    for name, (low, high) in BOUNDS.items():
        if name != "bp_diastolic":
            out = F.when(attribute == name, F.coalesce((x < low) | (x > high), F.lit(False))).otherwise(out)
    low, high = BOUNDS["bp_diastolic"]
    return out | F.coalesce((attribute == "bp") & ((y >= x) | (y < low) | (y > high)), F.lit(False))


def _chunked(series: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``chunk`` and ``core``; rows of a long series near the end of a chunk also go, as context, to the next.

    Series of up to ``hot`` readings are one chunk. A longer one is cut at quantiles of its days into bins of about
    ``hot / PER_CHUNK`` readings, however many that takes; days that are several quantiles at once are cut along ``rep``
    into as many bins. Second result: the long series (pid, attribute, n), None if there are none.
    """
    keys = ["pid", "attribute"]
    size = written(series.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot), "long-series")
    found = size.agg(F.count("*").alias("series"), F.max("n").alias("most")).collect()[0]
    if not found["series"]:
        return series.withColumns({"chunk": F.lit(0), "core": F.lit(True)}), None
    hint = F.broadcast if found["series"] <= BROADCAST_SERIES else lambda df: df
    bins = -(-found["most"] * PER_CHUNK // hot)
    long_ = series.join(hint(size), keys).groupBy(*keys).agg(F.percentile_approx("day", [i / bins for i in range(1, bins)], max(10_000, 20 * bins)).alias("cuts"))
    # a few kB for each long series; where there are many, no single one is much of the whole and a shuffle is fair
    cuts = written(size.join(long_, keys).select(*keys, F.greatest(F.lit(1), F.floor(F.lit(bins * hot) / F.col("n"))).cast("int").alias("per"), "cuts"), "cuts")
    joined = series.join(hint(cuts), keys, "left")
    below, upto = F.size(F.filter("cuts", lambda c: c < F.col("day"))), F.size(F.filter("cuts", lambda c: c <= F.col("day")))
    # a day that is several quantiles has all bins between them but the first, which holds the days before it
    within = F.floor((F.col("rep") / F.lit(2.0**64) + 0.5) * (F.col("upto") - F.col("below") - 1))
    bin_ = F.when(F.col("cuts").isNull(), 0).when(F.col("upto") - F.col("below") < 2, F.col("below")).otherwise(F.col("below") + 1 + F.least(within, F.col("upto") - F.col("below") - 2)).cast("int")
    at, chunk = F.col("bin") % F.col("per"), F.floor(F.col("bin") / F.col("per")).cast("int")
    context = lambda near, c: F.when(F.col("cuts").isNotNull() & near, F.struct(c.alias("chunk"), F.lit(False).alias("core")))
    # with one bin in a chunk the second nearest is two chunks away
    places = [F.struct(chunk.alias("chunk"), F.lit(True).alias("core")), context(at < 2, chunk - 1), context(at >= F.col("per") - 2, chunk + 1), context(F.col("per") == 1, chunk - 2), context(F.col("per") == 1, chunk + 2)]
    rows = joined.withColumns({"below": below, "upto": upto}).withColumns({"bin": bin_, "per": F.coalesce("per", F.lit(1))})
    return rows.select(*series.columns, F.inline(F.array_compact(F.array(*places)))), size


def _segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return start, np.diff(np.r_[start, len(keys)])


def _by_group(values: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Median of each group's values (groups contiguous, NaN last)."""
    order = np.lexsort((values, group))
    v = values[order]
    known = np.add.reduceat(~np.isnan(values), start) if len(start) else size
    lo, hi = start + np.maximum(known - 1, 0) // 2, start + np.maximum(known, 1) // 2
    hi = np.minimum(hi, start + np.maximum(known - 1, 0))
    return np.where(known > 0, (v[lo] + v[hi]) / 2, np.nan)


def _around(x: np.ndarray, group: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medians of up to ``side`` neighbours on each side within the group: of both sides, those before, those after."""
    n = len(x)
    near = np.full((n, 2 * side), np.nan)
    for k in range(1, side + 1):
        same = group[k:] == group[:-k]
        near[k:, side - k][same] = x[:-k][same]
        near[:-k, side + k - 1][same] = x[k:][same]
    return _row_median(near), _row_median(near[:, :side]), _row_median(near[:, side:])


def _row_median(near: np.ndarray) -> np.ndarray:
    """Median of the numbers of each row, NaN where there is none."""
    near = np.sort(near, axis=1)
    known = (~np.isnan(near)).sum(axis=1)
    lo, hi = np.maximum(known - 1, 0) // 2, np.minimum(np.maximum(known, 1) // 2, np.maximum(known - 1, 0))
    rows = np.arange(len(near))
    return (near[rows, lo] + near[rows, hi]) / 2


def _differences(live: np.ndarray, number: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deviation u from the level around each reading, its first and second central differences d1 and d2 (0 at the ends), and the levels before and after."""
    level, before, after = _around(live, number, side)
    u = live - level
    clean = np.nan_to_num(u)
    d1, d2 = np.zeros(len(live)), np.zeros(len(live))
    if len(live) > 2:
        inner = (number[2:] == number[1:-1]) & (number[:-2] == number[1:-1])
        d1[1:-1] = np.where(inner, (clean[2:] - clean[:-2]) / 2, 0)
        d2[1:-1] = np.where(inner, clean[2:] - 2 * clean[1:-1] + clean[:-2], 0)
    return u, d1, d2, before, after


def _agreement(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 where p and q have the same sign, -1 where not: its mean is the quadrant correlation, which no spike can move far."""
    return np.sign(p) * np.sign(q)


def _outside(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Distance of (p, q), both in spreads, from the centre, in half axes of the ellipse rotated as the correlation ``r`` has it."""
    return np.sqrt((p * p - 2 * r * p * q + q * q) / (1 - r * r))


def phase_space_spikes(
    x: np.ndarray,
    group: np.ndarray,
    usual: np.ndarray | float = 0.0,
    stuck: np.ndarray | None = None,
    need: int = NEED,
    spreads: float = SPREADS,
    side: int = SIDE,
    rounds: int = 8,
    given: np.ndarray | None = None,
    ellipsoids: bool = True,
) -> np.ndarray:
    """Spikes of many series at once; ``group`` (contiguous) numbers the series, ``x`` is in order of time.

    ``usual``: usual spread, of all or of each reading's series. ``stuck``: readings of stuck runs, or without a number, which
    tell nothing of level and spread and are no spikes. ``given``: for each reading the ``_statistics`` of its whole series, NaN
    where ``x`` has the whole series.

    Phase-space thresholding: u is the deviation from the level around the reading (median of its neighbours), d1 and d2
    are its first and second central differences. A reading is a spike if it lies outside one of the rotated ellipses of
    (u, d1), (u, d2), (d1, d2), whose half axes are ``spreads`` robust spreads (median absolute deviations), or the
    universal threshold sqrt(2 ln n) where that is more, and it leaves both the readings before and those after it by
    most of the half axis: beside a step or a spike only differences are large. Spikes are taken out and levels and
    differences computed again until no new one appears; the spreads and rotations are robust, those of all readings. Series with fewer than ``need`` readings have none. ``ellipsoids``: False leaves
    them out, to see what they decide.
    """
    spike = np.zeros(len(x), bool)
    if not len(x):
        return spike
    start, size = _segments(group)
    number = np.repeat(np.arange(len(start)), size)
    stuck = np.zeros(len(x), bool) if stuck is None else stuck
    prior = np.broadcast_to(np.asarray(usual, float), x.shape)[start] + 1e-9
    u, d1, d2, before, after = _differences(np.where(stuck, np.nan, x), number, side)
    own = _statistics(u, d1, d2, stuck, number, start, size)
    whole = own if given is None else np.where(np.isnan(given[start, :1]), own, given[start])
    n, mad, sign = whole[:, 0], whole[:, 1:4] * 1.4826, whole[:, 4:7]
    spread = np.sqrt((n * mad[:, 0] ** 2 + USUAL_WEIGHT * prior**2) / (n + USUAL_WEIGHT))
    # of independent readings d1 has 0.7 and d2 2.4 of their spread (ties of rounded values leave less), and u and d2 differ
    # in sign four times out of five
    s1, s2 = np.maximum(mad[:, 1], spread * 0.7), np.maximum(mad[:, 2], spread * 2.4)
    turn = np.sin(np.pi / 2 * (n[:, None] * sign + USUAL_WEIGHT * np.array([0, -0.6, 0])) / (n[:, None] + USUAL_WEIGHT))
    turn = np.clip(turn, -0.95, 0.95)[number]
    axis = np.maximum(spreads, np.sqrt(2 * np.log(np.maximum(n, 2))))[number]
    spread, s1, s2, enough = spread[number], s1[number], s2[number], (np.maximum(n, size) >= need)[number]
    for _ in range(rounds):
        a, b, c = np.nan_to_num(u) / spread, d1 / s1, d2 / s2
        out = np.maximum.reduce([_outside(p, q, turn[:, i]) for i, (p, q) in enumerate(((a, b), (a, c), (b, c)))]) > axis
        # past a step in level the reading agrees with one side; at an end only one side speaks
        alone = np.fmin(np.abs(x - before), np.abs(x - after)) > SIDES * axis * spread
        new = (out if ellipsoids else True) & alone & enough & ~(spike | stuck | np.isnan(u))
        if not new.any():
            break
        spike |= new
        u, d1, d2, before, after = _differences(np.where(spike | stuck, np.nan, x), number, side)
    return spike


def _statistics(u: np.ndarray, d1: np.ndarray, d2: np.ndarray, stuck: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each series: readings that aren't stuck, median |u|, |d1| and |d2|, and quadrant correlation of (u, d1), (u, d2), (d1, d2)."""
    n = np.add.reduceat(~stuck, start)
    median = lambda v: np.nan_to_num(_by_group(np.abs(np.where(stuck, np.nan, v)), number, start, size))
    agree = lambda p, q: np.add.reduceat(np.where(stuck, 0, _agreement(np.nan_to_num(p), q)), start) / np.maximum(n, 1)
    return np.column_stack([n, median(u), median(d1), median(d2), agree(u, d1), agree(u, d2), agree(d1, d2)])


def stuck_runs(x: np.ndarray, y: np.ndarray, group: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Members of runs of at least ``least`` successive readings without difference, within a group."""
    if not len(x):
        return np.zeros(0, bool)
    differ = (group[1:] != group[:-1]) | (x[1:] != x[:-1]) | ((y[1:] != y[:-1]) & ~(np.isnan(y[1:]) & np.isnan(y[:-1])))
    start = np.flatnonzero(np.r_[True, differ])
    size = np.diff(np.r_[start, len(x)])
    return np.repeat(size >= least, size)


_ORDER = ["pid", "attribute", "chunk", "day", "rep", "row_id", "pos"]


def _series(t: pa.Table) -> dict:
    """A table in ``_ORDER`` as arrays of its distinct readings, and ``of``, the place among them of each row."""
    cols = {c: t[c].combine_chunks() for c in t.column_names}
    x, y, day, rep = (np.array(cols[c].to_numpy(zero_copy_only=False)) for c in ("x", "y", "day", "rep"))
    coded = cols["attribute"].dictionary_encode()
    attribute, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
    pid, chunk = np.asarray(cols["pid"].dictionary_encode().indices), np.asarray(cols["chunk"].to_numpy(zero_copy_only=False))
    new = np.r_[True, (pid[1:] != pid[:-1]) | (attribute[1:] != attribute[:-1]) | (chunk[1:] != chunk[:-1])]
    first = new | np.r_[True, (day[1:] != day[:-1]) | (rep[1:] != rep[:-1])]
    attribute = attribute[first]
    out = {"x": x[first], "y": y.astype(float)[first], "group": np.cumsum(new)[first], "of": np.cumsum(first) - 1, "first": first}
    out |= {"attribute": attribute, "names": names, "usual": np.array([USUAL[a] for a in names])[attribute]}
    out["stuck"] = stuck_runs(out["x"], out["y"], out["group"]) & (attribute != (names.index("height") if "height" in names else -1))
    return out


def _whole_series(batches: Iterator[pa.RecordBatch], f: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f of tables that hold whole chunks of series, about 50,000 rows at a time, from batches in ``_ORDER``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        # everything before the last series of the batch is complete
        keys = [b[c].dictionary_encode().indices.to_numpy() for c in ("pid", "attribute")] + [b["chunk"].to_numpy()]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) if b.num_rows > 1 else np.zeros(0, int)
        fresh = bool(held) and any(held[-1][c][len(held[-1]) - 1].as_py() != b[c][0].as_py() for c in ("pid", "attribute", "chunk"))
        if fresh and rows > 50_000:
            yield f(pa.Table.from_batches(held))
            held, rows = [], 0
        if len(change) and rows + b.num_rows > 50_000:
            cut = int(change[-1]) + 1
            yield f(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held, rows = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
            rows += b.num_rows
    if held:
        yield f(pa.Table.from_batches(held))


def _spreads(chunked: DataFrame, size: DataFrame, few: bool, slots: int) -> DataFrame:
    """(pid, attribute, m): the ``_statistics`` of each long series over all its chunks, of the first number of a reading,
    then of the second, of those that have one."""
    names = [f"{v}{k}" for k in (1, 2) for v in ("u", "d", "e", "ud", "ue", "de")]

    def measure(t: pa.Table) -> pa.RecordBatch:
        s = _series(t)
        start, length = _segments(s["group"])
        number = np.repeat(np.arange(len(start)), length)
        values = []
        for x in (s["x"], s["y"]):
            u, d1, d2, _, _ = _differences(np.where(s["stuck"], np.nan, x), number, SIDE)
            z, there = np.nan_to_num(u), ~np.isnan(x)
            values += [np.where(there, v, np.nan) for v in (np.abs(u), np.abs(d1), np.abs(d2), _agreement(z, d1), _agreement(z, d2), _agreement(d1, d2))]
        mine = np.flatnonzero(s["first"])
        keep = np.asarray(t["core"].to_numpy(), bool)[mine] & ~s["stuck"]
        rows = pa.array(mine[keep])
        return pa.RecordBatch.from_arrays([t["pid"].combine_chunks().take(rows), t["attribute"].combine_chunks().take(rows), *[pa.array(v[keep], from_pandas=True) for v in values]], ["pid", "attribute", *names])

    long_ = chunked.join(F.broadcast(size) if few else size, ["pid", "attribute"], "left_semi").repartition(slots, "pid", "attribute", "chunk").sortWithinPartitions(*_ORDER)
    each = long_.mapInArrow(lambda batches: _whole_series(batches, measure), "pid string, attribute string, " + ", ".join(f"{v} double" for v in names))
    of = lambda v: F.percentile_approx(v, 0.5, 10_000) if len(v) == 2 else F.avg(v)
    part = lambda k: [F.count(names[6 * k]).cast("double"), *[F.coalesce(of(v), F.lit(0.0)) for v in names[6 * k : 6 * k + 6]]]
    return written(each.groupBy("pid", "attribute").agg(F.array(*part(0), *part(1)).alias("m")), "spreads")


def flag_series(readings: DataFrame, hot: int = HOT) -> DataFrame:
    """(tbl, row_id, pos, fault) of all implausible readings of series: spikes, stuck and impossible ones.

    ``readings``: tbl, row_id, pos, pid, day, attribute, x, y, rep. Rows without pid, day or x belong to no series and are
    left out. Readings of the same series, day and ``rep`` are repeats: they count once, and all are flagged if one is.
    Order is by day, then rep. Attributes without bounds are left alone; heights are never stuck.

    The shuffle is by chunk of a series and each task streams over its sorted rows, so memory holds a chunk at most. A
    long series is judged by the spreads and the size of the whole of it, measured over its chunks beforehand.
    """
    second = F.when(F.col("attribute") == "bp", F.col("y")).alias("y")
    series = readings.filter(_in_series()).select("tbl", "row_id", "pos", "pid", "day", "attribute", "x", second, "rep")
    slots = task_slots(readings.sparkSession)
    chunked, size = _chunked(series, hot)
    told: dict[tuple[str, str], list[float]] = {}
    if size is not None:
        few = size.count() <= BROADCAST_SERIES
        spreads = _spreads(chunked, size, few, slots)
        if few:  # 14 numbers for each
            told = {(r["pid"], r["attribute"]): r["m"] for r in spreads.collect()}
        else:
            chunked = chunked.join(spreads, ["pid", "attribute"], "left")
    laid = chunked.repartition(slots, "pid", "attribute", "chunk").sortWithinPartitions(*_ORDER)

    def whole(t: pa.Table, first: np.ndarray) -> np.ndarray:
        """The statistics of the whole series for each distinct reading, NaN where the table has it whole."""
        given = np.full((len(first), 14), np.nan)
        if "m" in t.column_names:
            m = t["m"].combine_chunks().take(pa.array(first))
            given[m.is_valid().to_numpy(zero_copy_only=False)] = np.asarray(m.drop_null().flatten()).reshape(-1, 14)
        elif told:
            pids, attributes = (t[c].combine_chunks().take(pa.array(first)).dictionary_encode() for c in ("pid", "attribute"))
            p, a = np.asarray(pids.indices), np.asarray(attributes.indices)
            where = [{v: i for i, v in enumerate(c.dictionary.to_pylist())} for c in (pids, attributes)]
            for (pid, attribute), m in told.items():
                if pid in where[0] and attribute in where[1]:
                    given[(p == where[0][pid]) & (a == where[1][attribute])] = m
        return given

    def flags(t: pa.Table) -> pa.RecordBatch:
        s = _series(t)
        first = np.flatnonzero(s["first"])
        given = whole(t, first)
        judge = lambda x, m: phase_space_spikes(x, s["group"], s["usual"], s["stuck"] | np.isnan(x), given=m)
        spike = judge(s["x"], given[:, :7])
        paired = ~np.isnan(s["y"])
        if paired.any():
            spike |= judge(s["y"], given[:, 7:])
        low, high = np.array([BOUNDS[a] for a in s["names"]]).T
        under, over = BOUNDS["bp_diastolic"]
        bad = (s["x"] < low[s["attribute"]]) | (s["x"] > high[s["attribute"]]) | (paired & ((s["y"] >= s["x"]) | (s["y"] < under) | (s["y"] > over)))
        fault = np.where(bad, "impossible", np.where(s["stuck"], "stuck", np.where(spike, "spike", None)))[s["of"]]
        keep = np.asarray(t["core"].to_numpy(), bool) & (fault != None)  # noqa: E711
        mask = pa.array(keep)
        own = [t[c].combine_chunks().filter(mask) for c in ("tbl", "row_id", "pos")]
        return pa.RecordBatch.from_arrays([*own, pa.array(fault[keep], pa.string())], ["tbl", "row_id", "pos", "fault"])

    return laid.mapInArrow(lambda batches: _whole_series(batches, flags), "tbl string, row_id long, pos int, fault string")


def _in_series() -> Column:
    known = [a for a in BOUNDS if a != "bp_diastolic"]
    return F.col("pid").isNotNull() & F.col("day").isNotNull() & F.col("x").isNotNull() & F.coalesce(F.col("attribute").isin(known), F.lit(False))


def implausible(readings: DataFrame, hot: int = HOT) -> DataFrame:
    """(tbl, row_id, pos, fault) of all implausible readings, one row each; fault: impossible, spike or stuck, the first that holds.

    ``readings`` as for flag_series; impossible values need neither patient nor day: rows outside all series are judged
    where they lie, without a shuffle. Impossible values stay in their series (they are outliers there as well), so a
    run of them is also a run.
    """
    outside = readings.filter(~_in_series()).filter(impossible(F.col("attribute"), F.col("x"), F.col("y")))
    return outside.select("tbl", "row_id", "pos", F.lit("impossible").alias("fault")).unionByName(flag_series(readings, hot))
