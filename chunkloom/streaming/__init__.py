"""The pipeline as a stream: files are parsed and chunked as they arrive. Documents are independent, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans import pipeline
from ..sources import reader


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files below a folder, at most max_files in a batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path).select("path", "length", "content")


def stream_chunks(files: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of a stream of files, with the common settings."""
    docs = reader.parse_documents(reader.detect(files))
    return pipeline.to_chunks(pipeline.with_settings(docs, None, settings), settings)


def start(chunks: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the columnar projection of the chunks as Parquet, exactly once."""
    from ..operators.render import columnar

    return columnar(chunks, ["path"]).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
