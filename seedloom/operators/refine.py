"""Refining a made dataset: duplicates, leftovers, labels, splits, reference use."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.text import py_strip
from seedloom.operators.exchange import Exchange

# What prompts fill in, and the marks around a cell.
PLACEHOLDERS = ("{text}", "{command}")
CELL_MARKS = ('$("', '")')


def normalised(text: Column) -> Column:
    """Lower case, with single blanks and none at the ends."""
    return F.lower(py_strip(F.regexp_replace(text, r"\s+", " ")))


def _print(columns: Sequence[str]) -> Column:
    parts = [F.coalesce(normalised(F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("\n", *parts))


def exact_dedup(df: DataFrame, columns: Sequence[str], *, row_id: str = "row_id") -> DataFrame:
    """The first row by id of all that agree in their normalised columns.

    A hash aggregate over digests finds the ids; copies shrink before the
    shuffle, however many there are of one text.
    """
    first = df.groupBy(_print(columns).alias("__print")).agg(F.min(row_id).alias(row_id))
    return df.join(first.select(row_id), row_id, "left_semi")


def row_fault(columns: Sequence[str]) -> Column:
    """What one row alone shows: ``empty`` cell, unfilled ``placeholder``, stray cell ``mark``, or null."""

    def some(test: Callable[[Column], Column]) -> Column:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(test(F.col(c).cast("string")), F.lit(False))
        return found

    empty = F.lit(False)
    for c in columns:
        empty = empty | (F.coalesce(py_strip(F.col(c).cast("string")), F.lit("")) == "")
    leftover = some(lambda v: v.contains(PLACEHOLDERS[0]) | v.contains(PLACEHOLDERS[1]))
    marked = some(lambda v: v.contains(CELL_MARKS[0]) | v.contains(CELL_MARKS[1]))
    return F.when(empty, "empty").when(leftover, "placeholder").when(marked, "mark")


def refine(df: DataFrame, columns: Sequence[str], *, row_id: str = "row_id") -> Exchange:
    """Rows fit for training, and the others with a reason.

    Reasons, the first that holds: those of ``row_fault``, or ``duplicate`` of
    a row with a smaller id that has none of them.
    """
    judged = df.select(row_id, row_fault(columns).alias("reason"), _print(columns).alias("__print"))
    good = judged.filter("reason IS NULL")
    first = good.groupBy("__print").agg(F.min(row_id).alias("__first"))
    again = good.join(first, "__print").filter(F.col(row_id) > F.col("__first"))
    rejects = judged.filter("reason IS NOT NULL").select(row_id, "reason")
    rejects = rejects.unionByName(again.select(row_id, F.lit("duplicate").alias("reason")))
    return Exchange(df.join(rejects, row_id, "left_anti"), rejects)


def drop_flagged(
    df: DataFrame, labels: DataFrame, rules: Mapping[str, tuple[str, float]], *, row_id: str = "row_id"
) -> DataFrame:
    """Rows that no label speaks against.

    ``rules`` maps a label column to an operator (``<``, ``<=``, ``>``, ``>=``,
    ``=``) and a limit; one that holds removes the row. Unlabelled rows stay.
    """
    tests = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__"}
    bad = F.lit(False)
    for column, (sign, limit) in rules.items():
        bad = bad | F.coalesce(getattr(F.col(column), tests[sign])(limit), F.lit(False))
    return df.join(labels.filter(bad).select(row_id), row_id, "left_anti")


def split_by_seed(
    df: DataFrame, shares: Mapping[str, int], *, row_id: str = "row_id", seed: int = 42, name: str = "split"
) -> DataFrame:
    """Add the name of a split, by a digest of the seed row's id.

    All variants of a seed get the same one, on any cluster and in any run.
    """
    total, upto = sum(shares.values()), 0
    if total <= 0:
        raise ValueError("shares must be positive")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))), 1, 8)
    drawn, split = F.conv(digits, 16, 10).cast("long"), F.lit(None).cast("string")
    for part, share in shares.items():
        upto += share
        split = F.coalesce(split, F.when(drawn < (upto << 32) // total, part))
    return df.withColumn(name, split)


def reference_use(df: DataFrame, dynamic: Sequence[str], reference: Sequence[str], *, row_id: str = "row_id") -> Exchange:
    """How many dynamic cells name every reference value, and those that do not.

    The rows are (column, rows, used, rate); a row without reference values
    uses them all.
    """

    def uses(column: str) -> Column:
        found = F.lit(True)
        for r in reference:
            value = F.col(r).cast("string")
            found = found & (value.isNull() | F.coalesce(F.col(column).cast("string").contains(value), F.lit(False)))
        return found

    cells = F.array(*[F.struct(F.lit(c).alias("column"), uses(c).alias("used")) for c in dynamic])
    keys = [c for c in (row_id, "sample_no") if c in df.columns]
    each = df.select(*keys, F.inline(cells))
    counted = each.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count_if("used").alias("used"))
    report = counted.withColumn("rate", F.col("used") / F.col("rows"))
    return Exchange(report, each.filter("not used").drop("used"))
