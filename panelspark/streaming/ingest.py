"""Incremental ingest: files that arrive in a folder become year partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import with_year


def arriving(spark: SparkSession, schema: StructType, path: str, date: str, form: str = "parquet") -> DataFrame:
    """Rows of new files with their date parsed and a year; rows without a date go."""
    return with_year(spark.readStream.schema(schema).format(form).load(path), date)


def ingest_new_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run, each file once, and stop; `checkpoint` remembers the files."""
    return rows.writeStream.format("parquet").partitionBy("year").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
