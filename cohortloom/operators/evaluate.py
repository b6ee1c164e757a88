"""Scores of classifiers from predictions: confusion, precision and recall, ranking curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class, a column ``pred_<class>`` for each class."""
    wide = df.groupBy(F.col(truth).alias("true_class")).pivot(predicted, classes).agg(F.count(F.lit(1)))
    return wide.select("true_class", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes])


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, support, predicted, precision, recall, f1) per class that occurs on either side; 0 where undefined."""
    both = df.select(F.inline(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))))
    g = both.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = zero(F.col("hit"), F.col("predicted")), zero(F.col("hit"), F.col("support"))
    return g.select("class", "support", "predicted", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(zero(2 * F.col("hit"), F.col("support") + F.col("predicted")), 6).alias("f1"))


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1, weighted_f1)."""
    r = report(df, truth, predicted)
    return r.agg(
        F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 4).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 4).alias("balanced_accuracy"),
        F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
    )


def curve(df: DataFrame, keys: list[str], score: str, positive: Column, slices: int = 64) -> DataFrame:
    """(keys, threshold, p, q, tp, fp, pos, neg): one row per distinct score, counts of scores at or above it.

    Rows are first counted by score. Running sums go within slices of the scores, cut at quantiles, and start at the sums
    of the slices above, so that no task holds all scores of a key. Null scores are the lowest.
    """
    n = df.select(*keys, F.col(score).alias("threshold"), positive.cast("int").alias("y")).groupBy(*keys, "threshold").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    at = n.agg(F.percentile_approx(F.col("threshold").cast("double"), [i / slices for i in range(1, slices)], 10_000)).collect()[0][0] or []
    cuts = F.array(*[F.lit(float(v)) for v in sorted(set(at))]).cast("array<double>")
    place = F.size(F.filter(cuts, lambda c: c <= F.col("threshold").cast("double")))
    n = n.withColumn("slice", F.when(F.col("threshold").isNull(), F.lit(-1)).otherwise(place))
    sums = n.groupBy(*keys, "slice").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    above = whole.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*keys, "slice", zero(F.sum("sp").over(above)).alias("bp"), zero(F.sum("sq").over(above)).alias("bq"), F.sum("sp").over(whole).alias("pos"), F.sum("sq").over(whole).alias("neg"))
    within = Window.partitionBy(*keys, "slice").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = n.select(*keys, "slice", "threshold", "p", "q", F.sum("p").over(within).alias("wp"), F.sum("q").over(within).alias("wq"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "slice"]]
    joined = run.alias("a").join(F.broadcast(sums.alias("b")) if not keys else sums.alias("b"), reduce(lambda x, y: x & y, same))
    return joined.select(*[F.col(f"a.{c}") for c in [*keys, "threshold", "p", "q"]], (F.col("wp") + F.col("bp")).alias("tp"), (F.col("wq") + F.col("bq")).alias("fp"), "pos", "neg")


def precision_points(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, threshold, precision, recall) at every distinct score; recall is null without a positive."""
    c = curve(df, keys, score, positive)
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), b), 6)
    return c.select(*keys, "threshold", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("pos")).alias("recall"))


def one_against_rest(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(class, score, y): each row once for every class, whose column of scores ``scores`` names."""
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score"), (F.col(truth).cast("string") == F.lit(c)).cast("int").alias("y")) for c, s in scores.items()])
    return df.select(F.inline(each))


def averaged_scores(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(average, auroc, auprc): macro is the mean over the classes that have both sides, micro that of all decisions together."""
    each = one_against_rest(df, truth, scores)
    macro = ranking_scores(each, ["class"], "score", F.col("y") == 1).agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.avg("auprc"), 6).alias("auprc"))
    micro = ranking_scores(each, [], "score", F.col("y") == 1)
    return macro.select(F.lit("macro").alias("average"), "auroc", "auprc").unionByName(micro.select(F.lit("micro").alias("average"), "auroc", "auprc"))


def mean_curve(df: DataFrame, truth: str, scores: dict[str, str], points: int = 1001) -> DataFrame:
    """(fpr, tpr): the mean over the classes of their true positive rates at ``points`` even false positive rates.

    Between two points of a class's curve the rate lies on the straight line; of several points with the same false
    positive rate the highest counts. Each stretch between two points is filled with the grid points in it.
    """
    c = curve(one_against_rest(df, truth, scores), ["class"], "score", F.col("y") == 1).filter("pos > 0 AND neg > 0")
    last = F.lit(points - 1)
    # corners only: of equal false positives the most true ones; and of those between two grid points the first and the last
    corner = c.groupBy("class", "fp").agg(F.max("tp").alias("tp"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    corner = corner.select("class", (F.col("fp") / F.col("neg")).alias("x"), (F.col("tp") / F.col("pos")).alias("y"))
    point = F.struct("x", "y")
    corner = corner.groupBy("class", F.floor(F.round(F.col("x") * last, 9)).alias("cell")).agg(F.min(point).alias("a"), F.max(point).alias("b")).select("class", F.inline(F.array_distinct(F.array("a", "b"))))
    back = Window.partitionBy("class").orderBy("x")
    steps = corner.withColumns({"x0": F.lag("x").over(back), "y0": F.lag("y").over(back)})
    first = F.when(F.col("x0").isNull(), F.lit(0)).otherwise(F.floor(F.round(F.col("x0") * last, 9)) + 1)
    grid = F.when(first <= F.floor(F.round(F.col("x") * last, 9)), F.sequence(first.cast("long"), F.floor(F.round(F.col("x") * last, 9)).cast("long")))
    # before the first corner the curve rises from the origin
    x0, y0 = F.coalesce("x0", F.lit(0.0)), F.coalesce("y0", F.lit(0.0))
    at = F.col("g") / last
    line = F.when(F.col("x") == x0, F.col("y")).otherwise(y0 + (F.col("y") - y0) * (at - x0) / (F.col("x") - x0))
    return steps.withColumn("g", F.explode(grid)).withColumn("v", line).groupBy("g").agg(F.round(F.avg("v"), 6).alias("tpr")).select(F.round(F.col("g") / last, 6).alias("fpr"), "tpr")


def ranking_scores(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, auroc, auprc, prevalence, n): ties share their area; null where a class is empty."""
    c = curve(df, keys, score, positive)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / (F.max("pos") * F.max("neg").cast("double"))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")) / F.max("pos")
    ok = (F.max("pos") > 0) & (F.max("neg") > 0)
    n = F.max("pos") + F.max("neg")
    return c.groupBy(*keys).agg(F.round(F.when(ok, area), 6).alias("auroc"), F.round(F.when(ok, ap), 6).alias("auprc"), F.round(F.max("pos") / n, 6).alias("prevalence"), n.alias("n"))
