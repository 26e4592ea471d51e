"""Dense row numbers without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.expr import whole_div
from seedloom.sources.staging import stage

_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits
BLOCK = 1 << 18  # row ids per join key when a group's first id is looked up


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def with_row_id(
    df: DataFrame,
    order_by: Sequence[str | Column],
    *,
    name: str = "row_id",
    num_partitions: int | None = None,
) -> DataFrame:
    """Number the rows 0..n-1 in the given order.

    Rows are range-partitioned and sorted, so equal values of the leading
    order column still spread over tasks as long as later columns differ. The
    sorted table is staged: the numbers cannot change when a task reruns. Only
    one count per partition is broadcast.
    """
    order = _columns(order_by)
    ranged = (
        df.repartitionByRange(num_partitions, *order)
        if num_partitions
        else df.repartitionByRange(*order)
    )
    in_partition = F.monotonically_increasing_id().bitwiseAND((1 << _OFFSET_BITS) - 1)
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", in_partition)
    )
    placed = stage(placed, "row-ids")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    # One row per range partition: always small enough to broadcast.
    numbered = placed.join(F.broadcast(starts), "__part")
    return numbered.select(*df.columns, (F.col("__start") + F.col("__at")).alias(name))


def number_within(
    df: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[str | Column],
    *,
    name: str = "position",
    size_name: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Number the rows 0.. within each group, without a task per group.

    Rows get dense ids in (group, order), so each group is one interval of
    ids. The intervals are staged and joined by (group, block of ids), which
    cuts a group of any size into join keys of at most ``block`` rows. Spark
    knows the size of the staged intervals and broadcasts few of them itself.
    """
    ids = with_row_id(df, [*groups, *order_by], name="__id")
    spans = ids.groupBy(*groups).agg(
        F.min("__id").alias("__first"), F.max("__id").alias("__last")
    )
    spans = stage(spans, "spans")
    at = whole_div(F.col("__id"), block)
    blocks = F.sequence(whole_div(F.col("__first"), block), whole_div(F.col("__last"), block))
    left = ids.withColumn("__block", at).alias("l")
    right = spans.withColumn("__block", F.explode(blocks)).alias("r")
    same = F.col("l.__block") == F.col("r.__block")
    for g in groups:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    matched = left.join(right, same)
    extra = [(F.col("l.__id") - F.col("r.__first")).alias(name)]
    if size_name:
        extra.append((F.col("r.__last") - F.col("r.__first") + 1).alias(size_name))
    return matched.select(*[F.col(f"l.{c}") for c in df.columns], *extra)
