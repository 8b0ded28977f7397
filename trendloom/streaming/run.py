"""A stream run to the end of what is there, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import new_path


def drained(stream: DataFrame) -> DataFrame:
    """Run a streaming frame over all its input that is there, and read what it appended; rows and state go to the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
