"""Idempotent ingest of token dumps: each file once, into a table partitioned by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources.files import TOKEN_SCHEMA


def dump_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New CSV dumps of a folder as they arrive, rows that cannot be scored left out."""
    rows = spark.readStream.schema(TOKEN_SCHEMA).option("header", "true").csv(folder)
    named = rows.withColumn("cell_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:\.gz)?$", 1))
    return named.where("nll is not null and not isnan(nll) and nll >= 0")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there and ends; run again it takes only what is new."""
    return dump_stream(spark, folder).writeStream.format("parquet").partitionBy("cell_name").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
