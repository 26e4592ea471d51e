"""Large JSON arrays, read by many tasks.

The file is cut at its quotation marks, which Spark's text reader can do from
any place in it. Whether a piece lies inside a string, how deep it is nested
and which record it belongs to are running sums; each stretch of pieces gives
its totals, and the totals before a stretch are what its own sums start from. The
totals are taken from an outline without text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.sources.staging import stage, stage_counted

# A split's pieces in stretches of at most 16,384: a window holds one at a time.
_STRETCH_BITS = 14
_STRETCH = ["file", "stretch"]
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits
# Text and row heads that a task is to sort at once.
_TASK_BYTES = 16 << 20
_ROW_BYTES = 64
_TOKEN = r"[\[\]{},]|[^\[\]{},]+"
_OTHER = r"[^\[\]{},]*[^\[\]{},\n\r\t\x{feff} ][^\[\]{},]*"


def _from_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Per stretch, the sum of ``value`` over the stretches that come before: a row for each stretch of the files."""
    totals = rows.groupBy(*_STRETCH).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__t"))
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*_STRETCH, F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias(name))


def _splits(found: DataFrame, parts: bool) -> DataFrame:
    """The splits of the files, numbered in order, with their file's number and, in its last split, the last piece."""
    seen = found.groupBy("path", "start").agg(F.max("id").alias("id"))
    numbered = seen.withColumn("split", F.row_number().over(Window.orderBy("path", "start")).cast("long"))
    of_file = Window.partitionBy("path")
    first = F.lit(0).cast("long") if parts else F.min("split").over(of_file)
    last = F.when(F.max("split").over(of_file) == F.col("split"), F.col("id"))
    return numbered.select("path", "start", "split", first.alias("file"), last.alias("last"))


def _pieces(spark: SparkSession, path: str, parts: bool) -> tuple[DataFrame, int]:
    """``file, stretch, seq, piece, real, mark``: text between quotation marks; and the number of tasks for it.

    ``seq`` rises through all splits. ``mark`` is what stands behind the piece,
    nothing at the end of a file; ``real`` is 1 for a mark that opens or closes
    a string: one behind an odd number of backslashes belongs to its string.
    """
    read = spark.read.option("lineSep", '"').text(path)
    piece = F.col("value")
    slashes = F.length(piece) - F.length(F.rtrim(piece, F.lit("\\")))
    found = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        piece.alias("piece"),
        (slashes % 2 == 0).alias("even"),
    )
    # Read back, so that the numbers of the pieces cannot change.
    found, seen = stage_counted(found, "json-pieces", size=F.sum(F.octet_length("piece") + _ROW_BYTES))
    # One row per split: the pieces carry its number, not its path.
    splits = stage(_splits(found, parts), "json-splits")
    seq = F.shiftleft("split", _OFFSET_BITS) + F.col("id").bitwiseAND((1 << _OFFSET_BITS) - 1)
    numbered = found.join(F.broadcast(splits), ["path", "start"]).withColumn("seq", seq)
    none = F.coalesce(F.col("id") == F.col("last"), F.lit(False))
    pieces = numbered.select(
        "file",
        F.shiftright("seq", _STRETCH_BITS).alias("stretch"),
        "seq",
        "piece",
        (F.col("even") & ~none).cast("long").alias("real"),
        F.when(none, "").otherwise('"').alias("mark"),
    )
    return pieces, max(1, -(-seen["size"] // _TASK_BYTES))


def _outline(pieces: DataFrame) -> DataFrame:
    """The pieces with an ``x`` for whatever stands between brackets and commas: as many tokens, but no text."""
    return pieces.withColumn("piece", F.regexp_replace(F.concat("piece", "mark"), _OTHER, "x")).withColumn("mark", F.lit(""))


def _tokens(pieces: DataFrame, marks: DataFrame, tasks: int) -> DataFrame:
    """The pieces, those outside strings cut at brackets and commas, with the step each takes in depth.

    ``marks`` are the marks before each stretch.
    """
    sofar = Window.partitionBy(*_STRETCH).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    quoted = pieces.repartition(tasks, *_STRETCH).join(F.broadcast(marks), _STRETCH)
    inside = (F.col("marks") + F.coalesce(F.sum("real").over(sofar), F.lit(0))) % 2 == 1
    told = quoted.select(*_STRETCH, "seq", inside.alias("inside"), F.concat("piece", "mark").alias("piece"))
    cut = F.when(F.col("inside"), F.array("piece")).otherwise(F.regexp_extract_all("piece", F.lit(_TOKEN), F.lit(0)))
    tokens = told.select(*_STRETCH, "seq", "inside", F.posexplode(cut).alias("at", "token"))
    opens, closes = (~F.col("inside") & F.col("token").isin(*marks) for marks in ("[{", "]}"))
    return tokens.withColumn("step", F.when(opens, 1).when(closes, -1).otherwise(0).cast("long"))


def _order() -> WindowSpec:
    return Window.partitionBy(*_STRETCH).orderBy("seq", "at")


def _nested(tokens: DataFrame, before: DataFrame) -> DataFrame:
    """The tokens with their depth, and 1 for a comma that ends a record; ``before`` is the depth before each stretch."""
    depth = F.col("before") + F.sum("step").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    nested = tokens.join(F.broadcast(before), _STRETCH).withColumn("depth", depth).drop("before")
    ends = ~F.col("inside") & (F.col("token") == ",") & (F.col("depth") == 1)
    return nested.withColumn("ends", ends.cast("long"))


def _check(pieces: DataFrame, tokens: DataFrame, path: str) -> None:
    """Whether strings and brackets end and every file starts with one; counts alone come to the driver."""
    open_strings = pieces.groupBy("file").agg((F.sum("real") % 2).alias("odd")).filter("odd = 1")
    shown = F.col("inside") | (F.trim(F.translate("token", "\n\r\t\ufeff", "    ")) != "")
    nesting = tokens.groupBy("file").agg(F.sum("step").alias("depth"), F.min(F.when(shown, F.col("seq"))).alias("seq"))
    nesting = stage(nesting, "json-files")
    # Only one piece of each file is sorted for its first token.
    opening = tokens.join(F.broadcast(nesting.select("file", "seq")), ["file", "seq"]).filter(shown)
    first = opening.groupBy("file").agg(F.min_by("token", "at").alias("first"))
    nesting = nesting.join(first, "file", "left")
    if not open_strings.isEmpty() or not nesting.filter("depth <> 0 or first is null or first <> '['").isEmpty():
        raise ValueError(f"{path} is not made of whole JSON arrays")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, *, parts: bool = False) -> DataFrame:
    """The records of JSON array files of any size, with the columns of ``schema``.

    Every file is one array of objects; with ``parts``, the files of the folder
    are together, in the order of their names, as ``write_json_array`` leaves
    them. Blanks and line breaks may stand anywhere between values. Fields that
    a record lacks are null, and so are all of a record that is no object or
    does not fit. A string or bracket that does not end is an error. A record
    has to fit into memory, a file does not: its stretches are dealt out to as
    many tasks as its size asks for.
    """
    # The text is dealt out by its stretch once; all totals before a stretch come from its outline.
    pieces, tasks = _pieces(spark, path, parts)
    outline = stage(_outline(pieces), "json-outline")
    marks = stage(_from_before(outline, F.col("real"), "marks"), "json-splits")
    tokens = stage(_tokens(outline, marks, tasks), "json-tokens")
    _check(outline, tokens, path)
    before = stage(_from_before(tokens, F.col("step"), "before"), "json-splits")
    earlier = stage(_from_before(_nested(tokens.repartition(tasks, *_STRETCH), before), F.col("ends"), "earlier"), "json-splits")
    counted = _nested(_tokens(pieces, marks, tasks), before).join(F.broadcast(earlier), _STRETCH)
    sofar = F.sum("ends").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    record = F.col("earlier") + F.coalesce(sofar, F.lit(0))
    # The array's brackets, the commas between records and what is around the array are no part of one.
    opening = (F.col("step") == 1) & (F.col("depth") == 1)
    within = (F.col("depth") >= 1) & (F.col("ends") == 0) & ~opening
    kept = counted.select("file", record.alias("record"), "seq", "at", "token", within.alias("within")).filter("within")
    # Dealt out before they are listed, so that no task holds lists on their way.
    dealt = kept.drop("within").repartition(tasks, "file", "record")
    listed = dealt.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "token"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: t["token"]), "")
    whole = listed.select(text.alias("j")).filter(r"j rlike '\\S'")
    return whole.select(F.from_json("j", schema).alias("r")).select("r.*")
