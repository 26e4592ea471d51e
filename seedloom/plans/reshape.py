"""Reshaping stored datasets: slice, edit, combine, convert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from seedloom.operators.combining import combine, combine_texts
from seedloom.operators.rows import apply_edits, drop_columns
from seedloom.sources.readers import read_json_records
from seedloom.sources.writers import write_lines, write_parquet
from seedloom.sources.zones import Zones, combined_name, edited_name, sliced_name, stem


def slice_dataset(spark: SparkSession, zones: Zones, name: str, columns: Sequence[str]) -> list[str]:
    """Save a dataset without some columns as ``_sliced``; returns what was removed."""
    sliced = drop_columns(spark.read.parquet(zones.locate(spark, name)), columns)
    write_parquet(sliced.rows, zones.path("edits", sliced_name(name)))
    return sliced.removed


def save_edits(
    spark: SparkSession, zones: Zones, name: str, edits: DataFrame, *, columns: Sequence[str] | None = None
) -> str:
    """Save a dataset with edited cells as ``_edited``; ``columns`` may name new ones.

    Spark cannot overwrite what it reads, so the original always stays.
    """
    edited = apply_edits(spark.read.parquet(zones.locate(spark, name)), edits, columns=columns)
    target = zones.path("edits", edited_name(name))
    write_parquet(edited, target)
    return target


def combine_datasets(spark: SparkSession, zones: Zones, names: Sequence[str]) -> str:
    """Combine datasets of one type into the salad zone."""
    target = zones.path("salad", combined_name(names))
    paths = [zones.locate(spark, n) for n in names]
    if target.endswith(".parquet"):
        write_parquet(combine([spark.read.parquet(p) for p in paths]), target)
    elif target.endswith(".json"):
        # Joined arrays are no JSON; the records are combined instead.
        combine([read_json_records(spark, p) for p in paths]).write.json(target, ignoreNullFields=False)
    else:
        write_lines(combine_texts(spark, paths), target, "line", ["text_no", "place"])
    return target


def json_to_parquet(spark: SparkSession, zones: Zones, name: str, schema: str | None = None) -> str:
    records = read_json_records(spark, zones.locate(spark, name), schema)
    target = zones.path("ingredients", f"{stem(name)}.parquet")
    write_parquet(records, target)
    return target
