"""From tagged text to template-shaped tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seedloom.functions.expr import let, whole_div
from seedloom.functions.text import (
    CLOSE_MARK,
    OPEN_MARK,
    captured_cells,
    cell_rows,
    py_strip,
    unescape_marks,
)
from seedloom.operators.numbering import number_within
from seedloom.sources.staging import stage
from seedloom.templates import DEFAULT_TEMPLATES, unique_fields


def parse_tagged(
    df: DataFrame,
    content: str,
    fields: Sequence[str],
    *,
    keep: Sequence[str] = (),
    strip: bool = True,
    ragged: str = "pad",
    escaped: bool = False,
    row_no: str = "row_no",
) -> DataFrame:
    """One output row per template row found in a tagged text column.

    Works within each input row, so it needs no shuffle and also runs on a
    streaming frame.
    """
    cells = captured_cells(F.col(content))
    if escaped:
        cells = F.transform(cells, unescape_marks)
    rows = cell_rows(cells, list(fields), strip=strip, ragged=ragged)
    found = df.select(*keep, F.posexplode(rows).alias("__no", "__row"))
    return found.select(
        *keep,
        F.col("__no").cast("long").alias(row_no),
        *[F.col("__row").getField(f).alias(f) for f in fields],
    )


def parse_tagged_files(
    spark: SparkSession,
    path: str | list[str],
    fields: Sequence[str],
    *,
    strip: bool = True,
    ragged: str = "pad",
    escaped: bool = False,
) -> DataFrame:
    """Parse tagged files of any size into (file, row_no, fields...).

    The reader splits a file at its opening marks, so many tasks share one
    file. Cells are numbered per file and dealt to rows by that number.
    """
    if ragged not in ("pad", "drop"):
        raise ValueError(f"ragged must be 'pad' or 'drop', not {ragged!r}")
    width = len(fields)
    pieces = spark.read.option("lineSep", OPEN_MARK).text(path)
    closed = F.col("value").contains(CLOSE_MARK)
    cell = F.substring_index("value", CLOSE_MARK, 1)
    cell = F.regexp_replace(cell, r"\r\n?", "\n")
    cell = unescape_marks(cell) if escaped else cell
    located = pieces.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.when(closed, cell).alias("cell"),
    )
    # A task reads the blocks of a file one by one, so within a block the cells
    # it keeps are numbered without a gap, and the order needs no sorting.
    cells = located.filter(F.col("cell").isNotNull()).withColumn("__seq", F.monotonically_increasing_id())
    cells = stage(cells, "cells")
    blocks = cells.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__low"))
    # What precedes the first opening mark of a file is no cell, even if it is closed.
    first = F.when(F.col("__block") == 0, F.monotonically_increasing_id())
    heads = located.select("file", F.col("cell").isNotNull().alias("__is"), first.alias("__at"))
    heads = heads.groupBy("file").agg(F.min_by(F.col("__is").cast("int"), "__at").alias("__skip"))
    # One row per split of a file.
    earlier = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low")
    starts = blocks.withColumn("__start", start).join(heads, "file")
    starts = starts.select("file", "__block", (F.col("__start") - F.col("__skip")).alias("__start"))
    numbered = cells.join(starts, ["file", "__block"])
    numbered = numbered.withColumn("__i", F.col("__seq") + F.col("__start")).filter("__i >= 0")
    value = py_strip(F.col("cell")) if strip else F.col("cell")
    at = F.col("__i") % width
    columns = [
        F.coalesce(F.max(F.when(at == j, value)), F.lit("")).alias(f)
        for j, f in enumerate(fields)
    ]
    grouped = numbered.groupBy("file", whole_div(F.col("__i"), width).alias("row_no"))
    rows = grouped.agg(F.count(F.lit(1)).alias("__cells"), *columns)
    if ragged == "drop":
        rows = rows.filter(F.col("__cells") == width)
    return rows.drop("__cells")


def round_robin_lines(
    df: DataFrame, content: str, fields: Sequence[str], *, keep: Sequence[str] = ()
) -> DataFrame:
    """Deal the lines of a text to columns: line i to field ``i % len(fields)``.

    Blank lines are left out but counted. Each field is an array, and the
    arrays of a row may differ in length.
    """
    width = len(fields)

    def dealt(lines: Column) -> Column:
        numbered = F.transform(
            lines, lambda line, i: F.struct(i.alias("i"), py_strip(line).alias("line"))
        )

        def of_field(rows: Column, j: int) -> Column:
            mine = F.filter(rows, lambda r: (r["i"] % width == j) & (r["line"] != ""))
            return F.transform(mine, lambda r: r["line"])

        return let(
            numbered,
            lambda rows: F.struct(*[of_field(rows, j).alias(f) for j, f in enumerate(fields)]),
        )

    found = df.select(*keep, let(F.split(F.col(content), "\n"), dealt).alias("__row"))
    return found.select(*keep, *[F.col("__row").getField(f).alias(f) for f in fields])


def pair_agents(
    df: DataFrame,
    content: str,
    *,
    keep: Sequence[str] = (),
    strip: bool = False,
) -> DataFrame:
    """Pair consecutive template rows of a two-agent text; an odd last is dropped.

    The first row of a pair gives ``agent_one`` and the second ``agent_two``.
    """
    fields = unique_fields(DEFAULT_TEMPLATES["duo_swarm"])
    rows = cell_rows(captured_cells(F.col(content)), fields, strip=strip)

    def agent(row: Column, number: str, instruction: str) -> Column:
        return F.struct(
            row[f"agent_instruct_{instruction}"].alias("instruction"),
            row[f"input_{number}"].alias("input"),
            row[f"output_{number}"].alias("output"),
        )

    def pair(rs: Column, p: Column) -> Column:
        first, second = F.get(rs, p * 2), F.get(rs, p * 2 + 1)
        return F.struct(
            agent(first, "1", "one").alias("agent_one"),
            agent(second, "2", "two").alias("agent_two"),
        )

    def pairs(rs: Column) -> Column:
        count = whole_div(F.size(rs), 2).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
        numbers = F.coalesce(numbers, F.array().cast("array<int>"))
        return F.transform(numbers, lambda p: pair(rs, p))

    found = df.select(*keep, F.posexplode(let(rows, pairs)).alias("__no", "__pair"))
    return found.select(
        *keep,
        F.col("__no").cast("long").alias("pair_no"),
        F.col("__pair.agent_one").alias("agent_one"),
        F.col("__pair.agent_two").alias("agent_two"),
    )


def pair_turns(
    df: DataFrame, conversation: str, turn: str, columns: Sequence[str], *, skip: Column | None = None
) -> DataFrame:
    """Pair the turns of each conversation two at a time, in order.

    Column ``c`` of a pair's turns becomes ``c_one`` and ``c_two``; an odd last
    turn is dropped. Turns for which ``skip`` is true belong to no pair.
    """
    if skip is not None:
        df = df.filter(~F.coalesce(skip, F.lit(False)))
    numbered = number_within(
        df.select(conversation, turn, *columns), [conversation], [turn], name="__i"
    )
    side = F.col("__i") % 2
    halves = [
        F.max(F.when(side == s, F.col(c))).alias(f"{c}_{word}")
        for s, word in ((0, "one"), (1, "two"))
        for c in columns
    ]
    pairs = numbered.groupBy(conversation, whole_div(F.col("__i"), 2).alias("pair_no"))
    whole = pairs.agg(F.count(F.lit(1)).alias("__turns"), *halves)
    return whole.filter("__turns = 2").drop("__turns")
