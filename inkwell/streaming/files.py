"""Convert files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.convert import convert

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*", files_a_trigger: int = 1000) -> DataFrame:
    """A stream of new files, converted."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return convert(stream)


def write(converted: DataFrame, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet; ``once`` ends when all files there are done."""
    writer = converted.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
