"""Tables written midway through a job, so that later steps read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_chosen: list[str] = []


def use_staging_folder(path: str) -> None:
    """Name the folder for sessions that do not set ``spark.checkpoint.dir``.

    All executors have to share it; on one machine any folder will do.
    """
    _chosen[:] = [path.rstrip("/")]


def staging_folder(spark: SparkSession) -> str:
    """The shared folder set as ``spark.checkpoint.dir``, else the one chosen."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if _chosen:
        return _chosen[0]
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def new_staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet and return it read back.

    Readers get column pruning and a fixed row set, and a lost executor costs
    a file read instead of a rerun of everything before.
    """
    spark = df.sparkSession
    path = new_staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stage``, with aggregates that the write itself collects: no further scan.

    """
    seen = Observation(label)
    kept = stage(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    return kept, {n: seen.get[n] or 0 for n in counts}
