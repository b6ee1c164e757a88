"""Feature matrix: roles of columns, scaling, indicators, one-hot, correlation filter, principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import clip
from .quantiles import column_quantiles, exact_quantiles


def roles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, role, n_present, n_distinct): binary if all values are 0 or 1 (a column of nulls too), constant if one value, else continuous."""
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    # distinct values are only told up to three, so nothing grows with the data
    g = df.select(F.inline(each)).groupBy("column_name").agg(F.count("v").alias("n_present"), F.coalesce(F.bool_and(F.col("v").isin(0.0, 1.0) | F.col("v").isNull()), F.lit(True)).alias("b"), (F.min("v") < F.max("v")).alias("varies"))
    return g.select("column_name", F.when(F.col("b"), "binary").otherwise("continuous").alias("role"), "n_present", F.coalesce(~F.col("varies"), F.lit(True)).cast("int").alias("is_constant"))


def scale(df: DataFrame, columns: list[str], kind: str, bound: float | None = None) -> DataFrame:
    """Columns scaled: robust (median, quartile range), standard (mean, population sd) or minmax; a zero spread counts as 1. Nulls stay."""
    if kind == "robust":
        r = {c: (mid, None if mid is None else high - low) for c, (low, mid, high) in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    else:
        centre, spread = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda v: F.max(v) - F.min(v))}[kind]
        row = df.agg(*[F.struct(centre(v), spread(v)).alias(c) for c in columns for v in [F.col(c).cast("double")]]).collect()[0]
        r = {c: tuple(row[c]) for c in columns}
    out = {}
    for c in columns:
        x = (F.col(c).cast("double") - F.lit(r[c][0]).cast("double")) / F.lit(r[c][1] or 1.0)
        out[c] = clip(x, bound) if bound is not None else x
    return df.withColumns(out)


def indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_missing`` for each column that has nulls."""
    r = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).collect()[0]
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns if r[c]})


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, r) of all pairs of varying columns, over the rows where both are present.

    One Arrow pass: each task sums products of its rows for all pairs at once; k * k numbers a task reach the driver.
    Columns are centred beforehand, so that the sums stay exact enough.
    """
    from .codes import varying

    names = varying(df, columns)
    spark, k = df.sparkSession, len(names)
    kind = "feature_1 string, feature_2 string, r double"
    if k < 2:
        return spark.createDataFrame([], kind)
    centre = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(names)]).collect()[0]
    mean = np.array([centre[f"c{i}"] for i in range(k)], float)

    def run(batches):
        total = np.zeros((4, k, k))  # of each pair (i, j): rows, sum of i, of its square, of the product
        for b in batches:
            x = np.column_stack([b[i].to_numpy(zero_copy_only=False).astype(float) for i in range(k)]) - mean
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += [there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    total = np.zeros(4 * k * k)
    for r in values.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    n, s, q, xy = total.reshape(4, k, k)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            m = n[i, j] or 1.0
            spread = (q[i, j] - s[i, j] ** 2 / m) * (q[j, i] - s[j, i] ** 2 / m)
            r = (xy[i, j] - s[i, j] * s[j, i] / m) / spread**0.5 if n[i, j] > 1 and spread > 1e-12 * q[i, j] * q[j, i] else None
            out.append((names[i], names[j], None if r is None else float(r)))
    return spark.createDataFrame(out, kind)


def correlation_filter(df: DataFrame, columns: list[str], least: float = 0.8, prefer: set[str] | None = None) -> tuple[list[str], list[tuple[str, str, float, str]]]:
    """Columns kept, and (feature_1, feature_2, r, dropped): pairs by falling |r|; of a pair still whole the second goes,
    or the one that is not in ``prefer``."""
    pairs = sorted((tuple(r) for r in correlations(df, columns).filter(F.abs("r") >= least).collect()), key=lambda p: (-abs(p[2]), p[0], p[1]))
    gone: set[str] = set()
    report = []
    for a, b, r in pairs:
        if a in gone or b in gone:
            continue
        drop = a if prefer and b in prefer and a not in prefer else b
        gone.add(drop)
        report.append((a, b, r, drop))
    return [c for c in columns if c not in gone], report


def principal_components(df: DataFrame, key: str, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """(key, pc array) of the centred columns, and the share of variance of each component."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).collect()[0]
    centred = df.select(key, *[F.coalesce(F.col(c).cast("double") - F.lit(means[c] or 0.0), F.lit(0.0)).alias(c) for c in columns])
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(centred)
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="pc").fit(data)
    return model.transform(data).select(key, vector_to_array("pc").alias("pc")), [float(v) for v in model.explainedVariance]


def component_report(loadings: np.ndarray, shares: list[float], columns: list[str], least: float = 0.85, top: int = 5) -> tuple[int, list[tuple[int, int, str, float]]]:
    """How many components reach the share ``least`` of the variance together, and of each of these the ``top`` features by
    |loading|: (component, rank, feature, loading), ties by name."""
    reached = np.cumsum(shares)
    n = min(int(np.searchsorted(reached, least - 1e-12)) + 1, len(shares))
    rows = []
    for c in range(n):
        order = sorted(range(len(columns)), key=lambda i: (-round(abs(loadings[i, c]), 9), columns[i]))[:top]
        # the sign of a component is arbitrary: its largest loading counts as positive
        sign = 1.0 if loadings[order[0], c] >= 0 else -1.0
        rows += [(c + 1, r, columns[i], float(sign * loadings[i, c])) for r, i in enumerate(order, 1)]
    return n, rows


def principal_loadings(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, list[float]]:
    """Loadings (features by components) and variance shares of all components of the centred columns, nulls as the mean."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
    centred = df.select(*[F.coalesce(F.col(c).cast("double") - F.lit(means[f"c{i}"] or 0.0), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    data = VectorAssembler(inputCols=centred.columns, outputCol="features").transform(centred)
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(data)
    return model.pc.toArray(), [float(v) for v in model.explainedVariance]


def without_suffixes(columns: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Columns that end in none of the suffixes."""
    return [c for c in columns if not c.endswith(suffixes)]


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_present, n_numeric, share): of the values that aren't missing, how many are numbers; 0 where none is there."""
    text = lambda c: F.col(c).cast("string")
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), C.missing_kinds(text(c))["any"].alias("gone"), C.strict_number(text(c)).isNotNull().alias("number")) for c in columns])
    g = df.select(F.inline(each)).groupBy("column_name").agg(F.count_if(~F.col("gone")).alias("n_present"), F.count_if(~F.col("gone") & F.col("number")).alias("n_numeric"))
    return g.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n_numeric").cast("double"), F.col("n_present")), F.lit(0.0)), 6))


def mostly_numeric(df: DataFrame, columns: list[str], least: float = 0.8) -> list[str]:
    """Columns of which at least the share ``least`` of the values present are numbers, in the order given."""
    kept = {r["column_name"] for r in numeric_shares(df, columns).filter(F.col("share") >= least).collect()}
    return [c for c in columns if c in kept]


def quantile_spans(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(feature, low, high, span): range of each feature between two quantiles, for Gower distances that outliers don't stretch; a span of 0 counts as 1."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    q = exact_quantiles(df.select(F.inline(each)), ["feature"], "v", [low, high]).toDF("feature", "low", "high")
    return q.withColumn("span", F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(1.0)))


def column_kinds(df: DataFrame, columns: list[str], alike: float = 0.95) -> DataFrame:
    """(column_name, kind, n_distinct, id_like): numeric or categorical by type; id_like columns have nearly as many different
    values as rows (about, by a sketch) without being fractions, and tell a model nothing."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    numeric = ("byte", "short", "integer", "long", "float", "double", "boolean")
    row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).collect()[0]
    of = lambda c: "numeric" if kinds[c] in numeric or kinds[c].startswith("decimal") else "categorical"
    rows = [(c, of(c), row[f"d{i}"], bool(row["n"] > 20 and row[f"d{i}"] >= alike * row["n"] and kinds[c] not in ("float", "double"))) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, n_distinct long, id_like boolean")


def cumulative(df: DataFrame, share: str, order: str) -> DataFrame:
    """Running sum of shares; for lists as short as a spectrum."""
    return df.withColumn("cumulative", F.sum(share).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def validate_binary(df: DataFrame, columns: list[str]) -> None:
    """Raises if a column holds anything but 0, 1 and null."""
    r = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1) | F.col(c).isNull()), F.lit(True)).alias(c) for c in columns]).collect()[0]
    if bad := [c for c in columns if not r[c]]:
        raise ValueError(f"not 0/1: {bad}")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities as null."""
    ok = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.withColumns({c: F.when(ok(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Diagnoses alone, with drugs, and everything."""
    diagnoses = [c for c in columns if c.startswith("has_")]
    drugs = [c for c in columns if c.startswith("med_")]
    return {"diagnosis": diagnoses, "diagnosis_meds": diagnoses + drugs, "all": list(columns)}
