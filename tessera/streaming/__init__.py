"""Queries over streams: a registered stream is a table like any other, and the compiled query is a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, with the schema of the files that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a streaming query over all that is there, into a table in memory."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
