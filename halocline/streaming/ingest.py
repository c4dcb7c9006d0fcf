"""Files of one campaign as they arrive: the same row-local operators on a stream.

Loaders, filters, thermodynamics, bulk fluxes and predictions only look at one row, so they
run unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving_files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ingest(stream: DataFrame, loader: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Load everything that has arrived since the last run, once each, and stop."""
    query = (loader(stream).writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
