"""What a dataset holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shape(NamedTuple):
    rows: int
    columns: list[str]


def shape(df: DataFrame) -> Shape:
    return Shape(df.count(), df.columns)


def column_stats(
    df: DataFrame, columns: Sequence[str] | None = None, *, before: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows, filled (not NULL) and, with ``before``, changed cells per column, in one pass.

    ``before`` maps a column to the one of the same row that holds its former cell.
    """
    columns = list(columns or df.columns)
    before = before or {}
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(columns)],
        *[F.count_if(~F.col(c).eqNullSafe(F.col(old))).alias(f"__{c}_changed") for c, old in before.items()],
    )

    def changed(c: str) -> list[Column]:
        count = F.col(f"__{c}_changed") if c in before else F.lit(None).cast("long")
        return [count.alias("changed")] if before else []

    rows = [
        F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"__{i}").alias("filled"), *changed(c))
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def provenance(df: DataFrame, columns: Sequence[str] = ("generationModel", "task")) -> DataFrame:
    """Rows per generating model and task."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
