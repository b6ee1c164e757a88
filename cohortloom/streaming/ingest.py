"""Incremental ingestion: new files of an extract are parsed once each and added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_extract(spark: SparkSession, folder: str, columns: list[str], sep: str = ",", encoding: str = "ISO-8859-1") -> DataFrame:
    """Files that appear in a folder, as a stream of text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).csv(folder, sep=sep, header=True, encoding=encoding)


def append_new(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Everything new, then stop; the state folder remembers what has been taken, so that each file counts once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "2 days") -> DataFrame:
    """Events per day and kind over a stream; what comes later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), kind).agg(F.count("*").alias("n"))
