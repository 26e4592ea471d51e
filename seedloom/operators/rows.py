"""Addressing rows and cells: drop columns, pages, previews, edits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators.numbering import with_row_id
from seedloom.sources.staging import stage

PAGE_ROWS = 10
PREVIEW_ROWS = 100


class Sliced(NamedTuple):
    rows: DataFrame
    removed: list[str]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> Sliced:
    """Drop columns; unknown names are ignored, none at all is an error."""
    if not columns:
        raise ValueError("name at least one column to remove")
    removed = [c for c in columns if c in df.columns]
    return Sliced(df.drop(*removed), removed)


def page_rows(
    df: DataFrame, page: int = 0, rows_per_page: int = PAGE_ROWS, *, row_id: str = "row_id"
) -> DataFrame:
    """One page of a table with dense row ids, keeping the ids.

    A range filter on the id: Parquet skips the row groups of other pages.
    """
    start = page * rows_per_page
    return df.filter((F.col(row_id) >= start) & (F.col(row_id) < start + rows_per_page))


class Page(NamedTuple):
    rows: DataFrame
    total_rows: int
    columns: list[str]


def read_page(
    df: DataFrame, page: int = 0, rows_per_page: int = PAGE_ROWS, *, row_id: str = "row_id"
) -> Page:
    columns = [c for c in df.columns if c != row_id]
    return Page(page_rows(df, page, rows_per_page, row_id=row_id), df.count(), columns)


def page_by_key(df: DataFrame, key: str, page: int = 0, rows_per_page: int = PAGE_ROWS, *, name: str = "row_id") -> Page:
    """One page of a table without row ids, in the order of a unique key.

    Only the keys are numbered; the page's own are then looked up, so the rest
    of the table is never sorted or copied.
    """
    keys = with_row_id(df.select(key), [key], name=name)
    wanted = page_rows(keys, page, rows_per_page, row_id=name)
    # As many rows as a page has.
    rows = df.join(F.broadcast(wanted), key).select(name, *df.columns)
    return Page(rows, keys.count(), df.columns)


def preview(df: DataFrame, *, row_id: str = "row_id", rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by id; a top-k per task, not a full sort."""
    return df.orderBy(row_id).limit(rows)


def edits_table(edits: DataFrame, columns: Iterable[str], *, row_id: str = "row_id") -> DataFrame:
    """One row per edited row id with, per column, a struct of the last value.

    The struct is NULL where the cell was not edited, so that setting a cell
    to NULL is an edit too. Edits come as (edit_no, row_id, column, value).
    """
    last: list[Column] = []
    for c in columns:
        mine = F.col("column") == c
        boxed = F.when(mine, F.struct(F.col("value").alias("value")))
        last.append(F.max_by(boxed, F.when(mine, F.col("edit_no"))).alias(c))
    return edits.groupBy(row_id).agg(*last)


def apply_edits(
    df: DataFrame,
    edits: DataFrame,
    *,
    row_id: str = "row_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Set cells, add rows for new ids and columns for new names.

    ``columns`` names the edited columns; left out, only columns of the table
    can be edited, and an edit of any other is an error. A value that does not
    fit its column leaves the cell as it was; ``rejected_edits`` lists those.
    The edits are staged, so Spark knows their size: few of them are
    broadcast, and then the table is not shuffled.
    """
    if columns is None:
        columns = [c for c in df.columns if c != row_id]
        strangers = edits.filter(~F.col("column").isin(df.columns)).select("column").limit(1).collect()
        if strangers:
            raise ValueError(f"unknown column {strangers[0][0]!r}; name new columns in columns=")
    columns = [c for c in columns if c != row_id]
    wide = stage(edits_table(edits, columns, row_id=row_id), "edits")
    types = dict(df.dtypes)
    names = df.columns + [c for c in columns if c not in types]

    def given(c: str) -> Column:
        return F.col(f"e.{c}").getField("value")

    def boxed(c: str) -> Column:
        return given(c).try_cast(types.get(c, "string"))

    def fits(c: str) -> Column:
        return F.col(f"e.{c}").isNotNull() & (given(c).isNull() | boxed(c).isNotNull())

    def updated(c: str) -> Column:
        old = F.col(f"d.{c}") if c in types else F.lit(None).cast("string")
        if c not in columns:
            return old.alias(c)
        return F.when(fits(c), boxed(c)).otherwise(old).alias(c)

    same = F.col(f"d.{row_id}") == F.col(f"e.{row_id}")
    changed = df.alias("d").join(wide.alias("e"), same, "left")
    changed = changed.select(*[updated(c) for c in names])

    known = df.select(row_id).join(wide.select(row_id), row_id, "left_semi")
    fresh = wide.join(known, row_id, "left_anti").alias("e")

    def added(c: str) -> Column:
        if c == row_id:
            return F.col(f"e.{c}").cast(types[c]).alias(c)
        if c in columns:
            return boxed(c).alias(c)
        return F.lit(None).cast(types[c]).alias(c)

    return changed.unionByName(fresh.select(*[added(c) for c in names]))


def rejected_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits whose value does not fit the type of their column."""
    bad = F.lit(False)
    for c, kind in df.dtypes:
        bad = bad | ((F.col("column") == c) & F.col("value").isNotNull() & F.col("value").try_cast(kind).isNull())
    return edits.filter(bad)
