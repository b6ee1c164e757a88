"""Events matched to other events of the same entity within a window of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_match(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, window: int) -> DataFrame:
    """All pairs at most ``window`` days apart, both ends included.

    Days are cut into buckets as wide as the window; a left row meets the buckets before, at and after its own. The join is
    an equality on entity and bucket, so one entity's rows spread over its time and are never compared all with all.
    """
    width = max(1, window)
    l = left.filter(F.col(left_day).isNotNull()).withColumn("_b", F.explode(F.array(*[(F.floor(F.col(left_day) / width) + d).cast("long") for d in (-1, 0, 1)])))
    r = right.filter(F.col(right_day).isNotNull()).withColumn("_b", F.floor(F.col(right_day) / width).cast("long"))
    return l.join(r, [key, "_b"]).filter(F.abs(F.col(right_day) - F.col(left_day)) <= window).drop("_b")


def nearest_match(left: DataFrame, right: DataFrame, key: str, left_id: str, kind: str, left_day: str, right_day: str, order: list[str], take: list[str], window: int) -> DataFrame:
    """For each left row and kind the nearest right row in the window; of equally near ones that on or before, then the first in ``order``."""
    diff = F.col(right_day) - F.col(left_day)
    best = F.min_by(F.struct(right_day, *take), F.struct(F.abs(diff), diff > 0, *order))
    return range_match(left, right, key, left_day, right_day, window).groupBy(left_id, key, left_day, kind).agg(best.alias("m")).select(left_id, key, left_day, kind, "m.*")
