"""Scoring a stream with what was fitted on a batch: narrow, stateless, the same rows as a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they come, in the schema of a frame."""
    reader = spark.readStream.format(format).schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score_stream(stream: DataFrame, model, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:  # noqa: ANN001
    """Writes the model's rows for every row of the stream, exactly once by the checkpoint; ``once`` stops when the present input is done."""
    writer = model.transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()
