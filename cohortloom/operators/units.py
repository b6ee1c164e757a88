"""Quantities recorded in different units: which unit a number was really recorded in, and its value in the common one.

A mixture on the log scale per quantity: the components are the population's distribution in the common unit, shifted by
the known conversion of each unit; the weights depend on the unit the label claims (or that it claims none) and are
learnt, so a label is trusted as far as the numbers bear it out. Where the population leaves a reading open, the level
of its own patient's sure readings decides. A broad component stands for readings that fit no unit; those keep the
label's unit, or the common one, and are flagged as uncertain.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import QUANTITY_UNITS
from ..session import written

# Conversions to the common unit, value * factor + offset.
CONVERSIONS = {
    "kg": (1.0, 0.0), "lb": (0.45359237, 0.0), "oz": (0.028349523125, 0.0),
    "cm": (1.0, 0.0), "in": (2.54, 0.0), "ft_in": (2.54, 0.0), "m": (100.0, 0.0),
    "degC": (1.0, 0.0), "degF": (1 / 1.8, -32 / 1.8),
    "mmHg": (1.0, 0.0), "kPa": (7.500616827, 0.0),
    "pct": (1.0, 0.0), "fraction": (100.0, 0.0),
    "mg/dL": (1.0, 0.0), "umol/L": (1 / 88.4, 0.0),
}
BINS = 40
BROAD = 2e-3  # share and density of readings that fit no unit
BROAD_DENSITY = 0.1
SURE = 0.99
PATIENT_SD = 0.08
NONE = "-"


@dataclass
class UnitModel:
    """Centre and spread of log(value in the common unit) per quantity; weight of each unit per (quantity, label)."""

    centre: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)
    weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def units(self, quantity: str) -> list[str]:
        # feet and inches are told from inches by the text alone, not by the number
        return [u for u in QUANTITY_UNITS[quantity] if u != "ft_in"]

    def prior(self, quantity: str, label: str) -> np.ndarray:
        units = self.units(quantity)
        label = "in" if label == "ft_in" else label
        if (w := self.weights.get((quantity, label))) is not None:
            return w
        w = np.full(len(units), 0.002 if label in units else 0.02)
        w[units.index(label) if label in units else 0] = 1
        return w / w.sum()

    def scores(self, quantity: str, label: str, values: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each unit for each value; levels: log of the patient's level in the common unit, or NaN."""
        units, prior = self.units(quantity), self.prior(quantity, label)
        out = np.zeros((len(values), len(units)))
        for k, u in enumerate(units):
            factor, offset = CONVERSIONS[u]
            common = values * factor + offset
            ok = (common > 0) & (values > 0)
            x = np.log(np.where(ok, common, 1.0))
            stretch = np.where(ok, values * factor / np.where(ok, common, 1.0), 1.0)  # d log(common) / d log(value)
            dens = _normal(x, self.centre[quantity], self.spread[quantity])
            if levels is not None:
                dens = np.where(np.isnan(levels), dens, _normal(x, np.nan_to_num(levels), PATIENT_SD))
            out[:, k] = prior[k] * ((1 - BROAD) * np.where(ok, dens * stretch, 0.0) + BROAD * BROAD_DENSITY)
        return out / out.sum(axis=1, keepdims=True)


def _normal(x: np.ndarray, m: float | np.ndarray, s: float) -> np.ndarray:
    return np.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))


def _quantile(x: np.ndarray, n: np.ndarray, q: float) -> float:
    order = np.argsort(x)
    return float(x[order][np.searchsorted(np.cumsum(n[order]), q * n.sum())])


def fit_units(readings: DataFrame, rounds: int = 30) -> UnitModel:
    """Expectation-maximisation over exact counts of all readings: (quantity, label, bin of log value).

    Only the counts reach the driver: at most quantities x labels x 40 bins for each factor of e, whatever the rows.
    Quantities without positive readings keep wide defaults.
    """
    quantities = list(QUANTITY_UNITS)
    counts = (
        readings.filter(F.col("attribute").isin(quantities) & (F.col("v1") > 1e-6) & (F.col("v1") < 1e9))
        .groupBy("attribute", F.coalesce("label", F.lit(NONE)).alias("label"), F.round(F.log("v1") * BINS).cast("int").alias("bin"))
        .count()
        .collect()
    )
    by: dict[str, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for q, label, b, n in counts:
        own = "in" if label == "ft_in" else label
        by[q][own if own in QUANTITY_UNITS[q] else NONE].append((b, n))
    model = UnitModel()
    for q in quantities:
        units = model.units(q)
        model.centre[q], model.spread[q] = 0.0, 3.0
        if not by[q]:
            continue
        data = {label: (np.exp(np.array([b for b, _ in rows]) / BINS), np.array([n for _, n in rows], float)) for label, rows in sorted(by[q].items())}
        start = [(v * CONVERSIONS[label][0] + CONVERSIONS[label][1], n) for label, (v, n) in data.items() if label in units] or [(v, n) for v, n in data.values()]
        xs, ns = np.log(np.maximum(np.concatenate([v for v, _ in start]), 1e-6)), np.concatenate([n for _, n in start])
        model.centre[q] = _quantile(xs, ns, 0.5)
        model.spread[q] = max(0.03, (_quantile(xs, ns, 0.8) - _quantile(xs, ns, 0.2)) / 1.68)
        for _ in range(rounds):
            moments = np.zeros(3)
            for label, (v, n) in data.items():
                prior = model.prior(q, label)
                fit = np.zeros((len(v), len(units)))
                x = np.zeros((len(v), len(units)))
                for k, u in enumerate(units):
                    common = v * CONVERSIONS[u][0] + CONVERSIONS[u][1]
                    x[:, k] = np.log(np.maximum(common, 1e-6))
                    fit[:, k] = np.where(common > 0, prior[k] * (1 - BROAD) * _normal(x[:, k], model.centre[q], model.spread[q]) * v * CONVERSIONS[u][0] / np.maximum(common, 1e-6), 0)
                fit /= fit.sum(axis=1, keepdims=True) + BROAD * BROAD_DENSITY
                mass = fit * n[:, None]
                moments += [mass.sum(), (mass * x).sum(), (mass * x * x).sum()]
                pseudo = np.full(len(units), 1e-4 * n.sum() + 0.05)
                pseudo[units.index(label) if label in units else 0] += 1.0
                w = mass.sum(axis=0) + pseudo
                model.weights[q, label] = w / w.sum()
            if moments[0] > 0:
                m = moments[1] / moments[0]
                model.centre[q], model.spread[q] = m, max(0.02, math.sqrt(max(0.0, moments[2] / moments[0] - m * m)))
    return model


UNIT_SCHEMA = "from_unit string, posterior double, x double, y double"


def _assign(readings: DataFrame, model: UnitModel, level: str | None) -> DataFrame:
    """Adds from_unit, posterior, x, y (v1 and v2 in the common unit). level: column with the log of the patient's level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            q, label = b["attribute"].dictionary_encode(), pa.compute.fill_null(b["label"], NONE).dictionary_encode()
            qs, labels = q.dictionary.to_pylist(), label.dictionary.to_pylist()
            v1, v2 = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("v1", "v2"))
            levels = b[level].to_numpy(zero_copy_only=False).astype(float) if level else None
            group = np.asarray(q.indices) * len(labels) + np.asarray(label.indices)
            unit, post, x, y = np.full(n, None, object), np.full(n, 1.0), v1.copy(), v2.copy()
            for g in np.unique(group):
                name, claimed = qs[g // len(labels)], labels[g % len(labels)]
                if name not in QUANTITY_UNITS:
                    continue
                at = np.flatnonzero((group == g) & ~np.isnan(v1))
                units = model.units(name)
                claimed_in = "in" if claimed == "ft_in" else claimed
                score = model.scores(name, claimed_in if claimed_in in units else NONE, v1[at], levels[at] if level else None)
                best = score.argmax(axis=1)
                factor, offset = (np.array([CONVERSIONS[u][i] for u in units])[best] for i in (0, 1))
                names = np.array(units, object)[best]
                if claimed == "ft_in":
                    names[names == "in"] = "ft_in"
                unit[at], post[at] = names, score[np.arange(len(at)), best]
                x[at], y[at] = v1[at] * factor + offset, v2[at] * factor + offset
            new = [pa.array(unit, pa.string()), pa.array(post, pa.float64()), pa.array(x, pa.float64(), from_pandas=True), pa.array(y, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "from_unit", "posterior", "x", "y"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema.fields)
    return readings.mapInArrow(run, f"{fields}, {UNIT_SCHEMA}")


def to_common_units(readings: DataFrame, model: UnitModel | None = None) -> DataFrame:
    """Readings (row_id, pid, attribute, v1, v2, label, ...) with from_unit, posterior, uncertain, x, y.

    ``x`` and ``y`` are v1 and v2 in the common unit; quantities without a unit table keep their numbers and get no
    from_unit. Rows without a number keep nulls. Readings that the population leaves open (posterior under 0.99) are
    decided by their patient's level, the median of the sure readings; only those rows are joined, and the levels are
    one small row per patient and quantity. ``uncertain`` marks a final posterior under 0.9.

    ``readings`` is read twice, for the fit and for the assignment, which is written; pass a written table, not an
    expensive plan.
    """
    model = model or fit_units(readings)
    first = written(_assign(readings, model, None), "assigned")
    open_ = F.col("v1").isNotNull() & F.col("from_unit").isNotNull() & (F.col("posterior") < SURE)
    asked = first.filter(open_)
    levels = (
        first.filter(F.col("from_unit").isNotNull() & ~open_ & (F.col("x") > 0) & F.col("pid").isNotNull())
        .join(asked.select("pid", "attribute").distinct(), ["pid", "attribute"], "left_semi")
        .groupBy("pid", "attribute")
        .agg(F.percentile_approx(F.log("x"), 0.5, 200).alias("level"))
    )
    kept = first.filter(~open_)
    again = asked.select(*readings.columns).join(levels, ["pid", "attribute"], "left").select(*readings.columns, "level")
    decided = written(_assign(again, model, "level").drop("level"), "decided")
    return kept.unionByName(decided).withColumn("uncertain", F.col("from_unit").isNotNull() & (F.col("posterior") < 0.9))
