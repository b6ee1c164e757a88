"""Reading delimited extracts and tables, writing tables and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "ISO-8859-1", quote: str = '"', columns: list[str] | None = None, required: list[str] | None = None, literal_missing: bool = False, skip_blanks: bool = False) -> DataFrame:
    """An extract as text columns with trimmed names; latin-1 is decoded here, once. ``literal_missing`` keeps empty cells as ''."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, quote=quote, escape='"', inferSchema=False, ignoreLeadingWhiteSpace=skip_blanks)
    df = df.toDF(*[c.strip() for c in df.columns])
    if gone := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"columns missing in {path}: {gone}")
    df = df.select(*(existing(df, columns) if columns else df.columns))
    return df.fillna("") if literal_missing else df


def ingest(spark: SparkSession, path: str, out: str, force: bool = False, **options) -> DataFrame:
    """The extract as a Parquet table; an existing one is kept unless ``force``."""
    read_delimited(spark, path, **options).write.mode("overwrite" if force else "ignore").parquet(out)
    return spark.read.parquet(out)


def sniff_separator(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> str:
    """The separator that occurs most often in the first line."""
    first = spark.read.option("encoding", encoding).text(path).head(1)
    line = first[0][0] if first else ""
    return max([",", "|", "\t", ";", ":"], key=line.count)


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def find_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first candidate that is a column, in any case."""
    by = {c.strip().lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in by:
            return by[c.lower()]
    if required:
        raise ValueError(f"none of {candidates} is a column")
    return None


def series_columns(df: DataFrame, suffixes: tuple[str, str, str] = ("_days", "_value", "_unit")) -> dict[str, dict[str, str]]:
    """name -> its day, value and unit columns, found by suffix; names without both days and values are left out."""
    out: dict[str, dict[str, str]] = {}
    for c in df.columns:
        for kind, s in zip(("days", "value", "unit"), suffixes):
            if c.lower().endswith(s):
                out.setdefault(c[: -len(s)], {})[kind] = c
    return {k: v for k, v in out.items() if {"days", "value"} <= set(v)}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix; without one, the Parquet table of that name, else the CSV file."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return read_delimited(spark, path, encoding="UTF-8")
    try:
        return spark.read.parquet(path + ".parquet")
    except Exception:  # noqa: BLE001 - whatever keeps it from being read
        return read_delimited(spark, path + ".csv", encoding="UTF-8")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV by suffix; arrays, maps and structs become JSON text in CSV."""
    if path.endswith(".csv"):
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def read_arrays(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text back to arrays; column -> element type. A bare value is a list of one; null, blank and what is neither are null."""
    text = lambda c: F.trim(F.col(c))
    bare = lambda c: ~text(c).startswith("[") & (text(c) != "")
    return df.withColumns({c: F.from_json(F.when(bare(c), F.concat(F.lit("["), text(c), F.lit("]"))).otherwise(text(c)), f"array<{t}>") for c, t in columns.items()})


LONG_VITALS = "row_id long, id string, vital string, day int, value double, unit string"


def write_both(df: DataFrame, path: str, schema: str = LONG_VITALS, mode: str = "overwrite") -> DataFrame:
    """``path``.parquet and ``path``.csv with the columns and types of ``schema``, computed once; the Parquet table is returned."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    df.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields]).write.mode(mode).parquet(f"{path}.parquet")
    table = df.sparkSession.read.schema(schema).parquet(f"{path}.parquet")
    write_table(table, f"{path}.csv", mode)
    return table


def metadata(spark: SparkSession, path: str) -> dict:
    """Files, bytes, rows and columns with their types of a Parquet table; rows come from the files' footers."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    df = spark.read.parquet(path)
    return {"files": len(df.inputFiles()), "bytes": size.getLength(), "rows": df.count(), "columns": dict(df.dtypes)}


def preview(df: DataFrame, rows: int = 5) -> dict:
    return {"rows": df.count(), "columns": df.columns, "head": [r.asDict() for r in df.limit(rows).collect()]}


def verify_ids(spark: SparkSession, path: str, key: str, expected: int) -> bool:
    """Whether the written table holds as many distinct ids."""
    return spark.read.parquet(path).select(key).distinct().count() == expected


def report(spark: SparkSession, path: str, content: dict) -> None:
    """A small report as JSON, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(content, indent=2, sort_keys=True, default=str), "utf-8"))
    finally:
        out.close()
