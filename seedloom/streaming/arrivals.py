"""The row-wise operators over tagged files and responses as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seedloom.functions.text import clean_generated, unix_newlines
from seedloom.operators.exchange import Exchange, failed
from seedloom.operators.parsing import parse_tagged


def arriving_rows(spark: SparkSession, folder: str, fields: Sequence[str], *, files_per_batch: int = 1000) -> DataFrame:
    """Template rows of each tagged file put into a folder, as a stream."""
    reader = spark.readStream.format("text").option("wholetext", True)
    files = reader.option("maxFilesPerTrigger", files_per_batch).load(folder)
    content = files.select(
        F.col("_metadata.file_path").alias("file"), unix_newlines(F.col("value")).alias("content")
    )
    return parse_tagged(content, "content", fields, keep=["file"])


def cleaned_responses(responses: DataFrame, question: str) -> Exchange:
    """Clean a stream of responses (request_id, content, question flag).

    Two streams: what is usable, and what failed, as it came.
    """
    bad = failed(F.col("content"))
    cleaned = clean_generated(F.trim("content"), F.col(question))
    return Exchange(responses.filter(~bad).withColumn("content", cleaned), responses.filter(bad))


def write_exchange(responses: DataFrame, question: str, path: str, checkpoint: str) -> StreamingQuery:
    """Clean a stream of responses and write rows and rejects in one pass over it.

    Batch n goes to ``path/batch=n`` with a folder ``usable=true`` and one
    ``usable=false``, and replaces what an earlier try of the batch left there,
    so a rerun adds nothing. Cleaned contents stand in ``content``, those of
    rejects as they came. Stops when caught up.
    """
    bad = failed(F.col("content"))
    cleaned = F.when(bad, F.col("content")).otherwise(clean_generated(F.trim("content"), F.col(question)))
    judged = responses.withColumn("content", cleaned).withColumn("usable", ~bad)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("usable").parquet(f"{path}/batch={number}")

    stream = judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_exchange(spark: SparkSession, path: str) -> Exchange:
    """What ``write_exchange`` has written so far: usable rows, and rejects."""
    found = spark.read.option("basePath", path).parquet(path)
    usable = F.col("usable").cast("boolean")
    return Exchange(found.filter(usable).drop("usable"), found.filter(~usable).drop("usable"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, each row exactly once; stops when caught up."""
    writer = stream.writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
