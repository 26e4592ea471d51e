"""Small named settings (template sets, prompt sets) next to the data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """Content of a small text file, or None if it does not exist."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows[0][0] if rows else None


def save_setting(spark: SparkSession, folder: str, name: str, value: str) -> None:
    row = spark.createDataFrame([(value,)], "value string")
    row.write.mode("overwrite").parquet(f"{folder}/setting={name}")


def load_setting(spark: SparkSession, folder: str, name: str) -> str | None:
    try:
        rows = spark.read.parquet(f"{folder}/setting={name}").take(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows[0]["value"] if rows else None


def setting_names(spark: SparkSession, folder: str) -> list[str]:
    try:
        found = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    names = found.select(F.col("setting").cast("string")).distinct()
    return sorted(row[0] for row in names.collect())
