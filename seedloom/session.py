"""Session settings the jobs in this package expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of repeated keys in a JSON object the last counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Prompts can be long; a batch of them has to fit into a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a builder; master and sizes stay with the caller.

    On a cluster set ``spark.checkpoint.dir`` to a shared folder and
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` to roughly
    input bytes / 128 MB; AQE merges what turns out to be too small.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
