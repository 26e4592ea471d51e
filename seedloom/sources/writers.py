"""Writing datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions.text import marked_cell
from seedloom.operators.numbering import with_row_id

EXPORT_FORMATS = ("csv", "jsonl")


def write_parquet(
    df: DataFrame, path: str, schema: T.StructType | None = None, *, mode: str = "error"
) -> None:
    """Write Parquet, cast to a schema's columns and types if one is given."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """CSV with a header; quotes inside values are doubled, blanks are kept."""
    df.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json_lines(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """One JSON record per line, with NULL cells written out."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_json_array(df: DataFrame, path: str, *, order_by: Sequence[str], columns: Sequence[str] | None = None, mode: str = "error") -> None:
    """One JSON array in ordered parts: joined by name, the part files are the array.

    Rows are numbered in order; the first opens the array, the last closes it,
    the others end in a comma, one record to a line. NULL cells are written
    out. No task holds more than its own rows. An empty table is an empty array.
    """
    columns = columns or [c for c in df.columns if c not in order_by]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record")
    numbered = with_row_id(df.select(*order_by, record), order_by, name="__n")
    # One number.
    last = numbered.agg((F.max("__n")).alias("__last"))
    framed = numbered.crossJoin(F.broadcast(last)).select(
        "__n",
        F.concat(
            F.when(F.col("__n") == 0, "[").otherwise(""), "record", F.when(F.col("__n") == F.col("__last"), "]").otherwise(",")
        ).alias("value"),
    )
    nothing = last.filter("__last is null").select(F.lit(0).cast("long").alias("__n"), F.lit("[]").alias("value"))
    ranged = framed.unionByName(nothing).repartitionByRange("__n").sortWithinPartitions("__n")
    ranged.select("value").write.mode(mode).text(path)


def export(
    df: DataFrame, stem: str, formats: Sequence[str] = EXPORT_FORMATS, *, mode: str = "error"
) -> list[str]:
    """Write ``stem.csv`` and/or ``stem.jsonl``; other formats are ignored.

    Give a frame that reads a table: each format scans it once.
    """
    writers = {"csv": write_csv, "jsonl": write_json_lines}
    written = []
    for name in formats:
        if name in writers:
            writers[name](df, f"{stem}.{name}", mode=mode)
            written.append(f"{stem}.{name}")
    return written


def tagged_row(
    columns: Sequence[str], *, escape: bool = False, null_text: str = "None"
) -> Column:
    """A row as marked cells, one per line, in column order."""
    cells = [marked_cell(F.col(c), escape=escape, null_text=null_text) for c in columns]
    return F.concat_ws("\n", *cells)


def write_tagged(
    df: DataFrame,
    path: str,
    *,
    order_by: Sequence[str],
    columns: Sequence[str] | None = None,
    escape: bool = False,
    null_text: str = "None",
    mode: str = "error",
) -> None:
    """Tagged text with a blank line after each row; part files are in order."""
    columns = columns or [c for c in df.columns if c not in order_by]
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    text = tagged_row(columns, escape=escape, null_text=null_text)
    ranged.select(text.alias("value")).write.mode(mode).text(path, lineSep="\n\n")


def write_lines(df: DataFrame, path: str, line: str, order_by: Sequence[str], *, mode: str = "error") -> None:
    """A text file in ordered parts, one row per line."""
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged.select(F.col(line).alias("value")).write.mode(mode).text(path)
