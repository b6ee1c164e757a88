"""Set algebra on ids, joins with checks, first and modal rows, profiles of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import exact_quantiles


def common_ids(frames: list[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def inner_chain(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner joins on the key; of columns with the same name the first stays."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(key, *[c for c in f.columns if c not in out.columns]), key)
    return out


def first_rows(df: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """The first row per key in the order of the sort columns."""
    return df.groupBy(key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("r")).select(key, "r.*")


def join_labels(left: DataFrame, labels: DataFrame, key: str, label: str, how: str = "inner", on_duplicate: str = "error", order: list[str] | None = None) -> DataFrame:
    """m:1 join; several labels per key are an error, or the first by ``order``, or the most frequent (smallest on ties) is taken."""
    if on_duplicate == "error":
        if labels.groupBy(key).count().filter("count > 1").head(1):
            raise ValueError(f"several labels for one {key}")
        one = labels.select(key, label)
    elif on_duplicate == "first":
        one = first_rows(labels, key, order or [label], [label])
    else:
        n = labels.groupBy(key, label).count()
        one = n.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), label))[label].alias(label))
    return left.join(one, key, how)


def missing_rows(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """(column, n_rows, null, blank, text, any, pct_any[, entities_any]) for each column."""
    parts = []
    for c in columns:
        kinds = C.missing_kinds(F.col(c))
        parts.append(F.struct(F.lit(c).alias("column_name"), *[k.cast("long").alias(f"n_{n}") for n, k in kinds.items()]))
    rows = df.select(*([F.col(key).alias("_k")] if key else []), F.inline(F.array(*parts)))
    out = [F.count("*").alias("n_rows"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in ("null", "blank", "text", "any")], F.round(100.0 * F.sum("n_any") / F.count("*"), 4).alias("pct_any")]
    return rows.groupBy("column_name").agg(*out, *([F.countDistinct(F.when(F.col("n_any") == 1, F.col("_k"))).alias("entities_any")] if key else []))


def missing_entities(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n_entities, any_missing, all_missing, any_present): entities by whether some or all of their rows lack it."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), C.missing_kinds(F.col(c))["any"].cast("int").alias("m")) for c in columns])
    per = df.select(F.col(key).alias("_k"), F.inline(parts)).groupBy("_k", "column_name").agg(F.max("m").alias("some"), F.min("m").alias("all"))
    return per.groupBy("column_name").agg(F.count("*").alias("n_entities"), F.sum("some").alias("any_missing"), F.sum("all").alias("all_missing"), F.sum(1 - F.col("all")).alias("any_present"))


def category_counts(df: DataFrame, column: Column, by: Column | None = None) -> DataFrame:
    """(category[, by_value], n, pct): pct within the category where there is a second column, of all rows else; missing is ``Missing``."""
    name = lambda c: F.when(C.missing_kinds(c)["any"], "Missing").otherwise(C.strip(c))
    keys = ["category"] + (["by_value"] if by is not None else [])
    n = df.select(name(column).alias("category"), *([name(by).alias("by_value")] if by is not None else [])).groupBy(*keys).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("category") if by is not None else Window.partitionBy(F.lit(0))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 4))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_numeric, n_other, n_zero, min, max, mean, median of whole numbers)."""
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), C.missing_kinds(F.col(c).cast("string"))["any"].alias("gone"), C.strict_number(F.col(c).cast("string")).alias("v")) for c in columns])
    long = df.select(F.inline(parts))
    stats = long.groupBy("column_name").agg(
        F.count("*").alias("n"), F.count("v").alias("n_numeric"), F.count_if(F.col("v").isNull() & ~F.col("gone")).alias("n_other"), F.count_if(F.col("v") == 0).alias("n_zero"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.round(F.avg("v"), 6).alias("mean_value"),
    )
    middle = exact_quantiles(long.select("column_name", F.bround("v").alias("v")), ["column_name"], "v", [0.5]).withColumnRenamed("q0", "median_value")
    return stats.join(middle, "column_name", "left")


def age_quality(df: DataFrame, key: str, age: str) -> DataFrame:
    """Counts of entities by the state of their ages: some number, none, some zero, only zeros, some other text."""
    v = C.strict_number(F.col(age))
    other = (v.isNull() & ~C.missing_kinds(F.col(age))["any"]).cast("int")
    per = df.groupBy(key).agg(F.count(v).alias("n"), F.sum((v == 0).cast("int")).alias("z"), F.max(other).alias("o"))
    z = F.coalesce("z", F.lit(0))
    return per.agg(
        F.count("*").alias("n_entities"), F.count_if(F.col("n") > 0).alias("any_numeric"), F.count_if(F.col("n") == 0).alias("no_numeric"), F.count_if(z > 0).alias("any_zero"),
        F.count_if((F.col("n") > 0) & (z == F.col("n"))).alias("only_zero"), F.count_if(F.col("o") == 1).alias("any_other"),
    )


def by_hash_rank(df: DataFrame, key: str, strata: list[str], seed: int = 42) -> DataFrame:
    """(…, rnk, n_stratum): a fixed random order within strata. Whole-number keys are ordered by key * 2654435761 + seed
    modulo 2^32, the same in any engine, others by xxhash64."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    h = F.xxhash64(key, F.lit(seed)) if not whole else F.pmod(F.col(key).cast("decimal(30,0)") * F.lit(2654435761).cast("decimal(20,0)") + F.lit(seed), F.lit(4294967296).cast("decimal(20,0)")).cast("long")
    # ranks within slices of the hash, and the number of rows in the slices before: no task holds a whole stratum
    slices = 1024
    low, width = (-(2**63), 2**64 // slices) if not whole else (0, 2**32 // slices)
    keyed = df.withColumn("_h", h).withColumn("_s", F.floor((F.col("_h").cast("decimal(30,0)") - F.lit(low).cast("decimal(30,0)")) / width).cast("int"))
    by = [*strata, "_s"]
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*(strata or [F.lit(0)]))
    sizes = sizes.select(*by, (F.sum("_n").over(over.orderBy("_s")) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("n_stratum"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = ranked.alias("l").join(sizes.alias("r"), reduce(lambda x, y: x & y, same))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_before") + F.col("_r")).cast("long").alias("rnk"), "n_stratum")


def split(df: DataFrame, key: str, strata: list[str], test_share: float = 0.2) -> DataFrame:
    """Adds ``part`` (test or train), the same share of every stratum."""
    return by_hash_rank(df, key, strata).withColumn("part", F.when(F.col("rnk") <= F.floor(F.col("n_stratum") * test_share), "test").otherwise("train")).drop("rnk", "n_stratum")


def folds(df: DataFrame, key: str, strata: list[str], k: int = 5) -> DataFrame:
    return by_hash_rank(df, key, strata).withColumn("fold", (F.col("rnk") % k).cast("int")).drop("rnk", "n_stratum")


def explode_categories(mapping: DataFrame, code: str, prefix: str) -> DataFrame:
    """(code, category) from a code list with one column per category: all columns whose name begins with the prefix."""
    names = [c for c in mapping.columns if c.upper().startswith(prefix.upper())]
    rows = mapping.select(C.strip(F.col(code)).alias("code"), F.explode(F.array(*[C.strip(F.col(c).cast("string")) for c in names])).alias("category"))
    return rows.filter("category IS NOT NULL AND category <> ''").distinct()


def missing_by_class(df: DataFrame, kind: Column, value: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Per class: rows by how the value is missing; entities with rows, with some value, with only missing values."""
    kinds = C.missing_kinds(value)
    rows = df.select(F.col(key).alias("_k"), kind.alias("class"), *[k.cast("long").alias(f"n_{n}") for n, k in kinds.items()]).filter("class IS NOT NULL")
    by_row = rows.groupBy("class").agg(F.count("*").alias("n_rows"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in kinds])
    per = rows.groupBy("_k", "class").agg(F.min("n_any").alias("all_missing"))
    by_entity = per.groupBy("class").agg(F.count("*").alias("with_rows"), F.sum(1 - F.col("all_missing")).alias("with_value"), F.sum("all_missing").alias("only_missing"))
    return by_row, by_entity


def missing_in_cohort(df: DataFrame, cohort: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column_name, n_cohort, with_rows, without_rows, any_null, any_blank, any_text, any_missing, only_missing, pct_any): entities
    of the cohort by how their rows lack the column; pct_any is of the whole cohort, rows or not."""
    parts = []
    for c in columns:
        kinds = C.missing_kinds(F.col(c))
        parts.append(F.struct(F.lit(c).alias("column_name"), *[k.cast("int").alias(n) for n, k in kinds.items()]))
    rows = df.join(cohort.select(key).distinct(), key, "left_semi").select(F.col(key).alias("_k"), F.inline(F.array(*parts)))
    per = rows.groupBy("_k", "column_name").agg(*[F.max(n).alias(n) for n in ("null", "blank", "text", "any")], F.min("any").alias("only"))
    n = cohort.select(key).distinct().count()
    out = per.groupBy("column_name").agg(
        F.count("*").alias("with_rows"), F.sum("null").alias("any_null"), F.sum("blank").alias("any_blank"), F.sum("text").alias("any_text"), F.sum("any").alias("any_missing"), F.sum("only").alias("only_missing")
    )
    whole = F.lit(n).cast("long")
    return out.select("column_name", whole.alias("n_cohort"), "with_rows", (whole - F.col("with_rows")).alias("without_rows"), "any_null", "any_blank", "any_text", "any_missing", "only_missing", F.round(100.0 * F.col("any_missing") / F.lit(max(n, 1)), 4).alias("pct_any"))


def stratified_sample(df: DataFrame, key: str, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows in which every stratum has its share: the rounded share of n, at least one row, in a fixed random order."""
    total = max(df.count(), 1)
    want = F.greatest(F.lit(1), F.round(F.col("n_stratum") * F.lit(n / total)).cast("long"))
    return by_hash_rank(df, key, strata, seed).filter(F.col("rnk") <= want).drop("rnk", "n_stratum")
