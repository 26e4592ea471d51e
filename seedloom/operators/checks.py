"""Checks of an amplified table against its seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.operators.roles import DYNAMIC, REFERENCE, STATIC, columns_with


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def _cell_prints(df: DataFrame, columns: Sequence[str], row_id: str, side: str) -> DataFrame:
    """(row_id, column, print) with one row per cell; equal cells print equally."""

    def cell(c: str):
        value = F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column"), F.coalesce(F.md5(value), F.lit("")).alias("print"))

    cells = df.select(F.col(row_id).alias("row_id"), F.inline(F.array(*[cell(c) for c in columns])))
    return cells.withColumn("__seed", F.lit(side == "seed"))


def compare_with_seeds(
    seeds: DataFrame,
    result: DataFrame,
    columns: Sequence[str],
    *,
    row_id: str = "row_id",
) -> DataFrame:
    """Per column: rows, and rows whose cell equals, or not, the seed's cell.

    Cells are compared by grouping equal ones, not by a join: the many samples
    of one seed shrink to few rows before the shuffle. NULL equals NULL.
    """
    if not columns:
        raise ValueError("there are no columns to compare")
    both = _cell_prints(seeds, columns, row_id, "seed").unionByName(
        _cell_prints(result, columns, row_id, "result")
    )
    groups = both.groupBy("row_id", "column", "print").agg(
        F.count_if("__seed").alias("seeds"), F.count_if(~F.col("__seed")).alias("rows")
    )
    same = F.when(F.col("seeds") > 0, F.col("rows")).otherwise(0)
    return groups.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum(same).alias("same_rows"),
        F.sum(F.col("rows") - same).alias("changed_rows"),
    )


def invariance_report(
    seeds: DataFrame, result: DataFrame, roles: Mapping[str, str], *, row_id: str = "row_id"
) -> DataFrame:
    """Comparison of the static and reference columns; all rows must be the same."""
    return compare_with_seeds(seeds, result, columns_with(roles, STATIC, REFERENCE), row_id=row_id)


def change_report(
    seeds: DataFrame, result: DataFrame, roles: Mapping[str, str], *, row_id: str = "row_id"
) -> DataFrame:
    """Comparison of the dynamic columns, with the share of changed rows."""
    report = compare_with_seeds(seeds, result, columns_with(roles, DYNAMIC), row_id=row_id)
    share = F.when(F.col("rows") > 0, F.col("changed_rows") / F.col("rows"))
    return report.withColumn("changed_share", share)


def check_generated(
    seeds: DataFrame, result: DataFrame, roles: Mapping[str, str], *, row_id: str = "row_id"
) -> list[str]:
    """Fail if a static or reference cell was changed.

    Returns the dynamic columns in which no row differs from its seed, which
    deserve a warning. Both answers come from one pass.
    """
    report = compare_with_seeds(seeds, result, list(roles), row_id=row_id).collect()
    changed = {r["column"]: r["changed_rows"] for r in report}
    bad = [c for c in columns_with(roles, STATIC, REFERENCE) if changed.get(c)]
    if bad:
        raise ValueError(f"columns that must not change were changed: {', '.join(bad)}")
    return [c for c in columns_with(roles, DYNAMIC) if changed.get(c) == 0]


def sample_counts(
    seeds: DataFrame, result: DataFrame, *, row_id: str = "row_id"
) -> DataFrame:
    """Samples per seed id, 0 for a seed without samples; strangers have ``seeds`` 0."""
    tagged = seeds.select(row_id, F.lit(1).alias("__s"), F.lit(0).alias("__r")).unionByName(
        result.select(row_id, F.lit(0).alias("__s"), F.lit(1).alias("__r"))
    )
    return tagged.groupBy(row_id).agg(F.sum("__s").alias("seeds"), F.sum("__r").alias("samples"))
