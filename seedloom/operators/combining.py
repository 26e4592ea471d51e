"""Putting datasets and texts together."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.numbering import with_row_id
from seedloom.sources.readers import dataset_files, unreadable


_WHOLE = ["tinyint", "smallint", "int", "bigint"]
_NUMERIC = [*_WHOLE, "float", "double"]


def _common(kinds: set[str]) -> str:
    """The type that values of several types share."""
    if kinds <= set(_WHOLE):
        return max(kinds, key=_WHOLE.index)
    return "double" if kinds <= set(_NUMERIC) else "string"


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing cells are NULL, duplicates stay.

    Columns of different numeric types take the wider one; a column that is a
    number here and something else there becomes text in all of them.
    """
    if len(frames) < 2:
        raise ValueError("at least two datasets are needed")
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            types.setdefault(name, set()).add(kind)
    wider = {name: _common(kinds) for name, kinds in types.items() if len(kinds) > 1}

    def aligned(frame: DataFrame) -> DataFrame:
        return frame.select(
            *[F.col(c).cast(wider[c]).alias(c) if c in wider else F.col(c) for c in frame.columns]
        )

    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(union, [aligned(f) for f in frames])


class Combined(NamedTuple):
    rows: DataFrame
    skipped: list[tuple[str, str]]


def combine_directory(spark: SparkSession, folder: str) -> Combined:
    """Concatenate all Parquet datasets of a folder, skipping unreadable ones.

    Footers are read a few at a time, and datasets of one schema are one scan,
    so the plan has a branch per schema. What is skipped comes with the reason;
    an error that is not about the form of a dataset is raised. With nothing
    readable the result is an empty frame.
    """
    paths = dataset_files(spark, folder, [".parquet"])

    def opened(path: str) -> DataFrame | str:
        try:
            return spark.read.parquet(path)
        except (PySparkException, Py4JJavaError) as error:
            if not unreadable(error):
                raise
            reason = re.search(r"\[[A-Z_.]+\][^\n]*", str(error))
            return reason[0] if reason else str(error).splitlines()[0]

    with ThreadPoolExecutor(max_workers=16) as pool:
        found = dict(zip(paths, pool.map(opened, paths), strict=True))
    skipped = [(path, frame) for path, frame in found.items() if isinstance(frame, str)]
    schemas: dict[str, list[str]] = {}
    for path, frame in found.items():
        if not isinstance(frame, str):
            schemas.setdefault(frame.schema.json(), []).append(path)
    frames = [spark.read.schema(found[p[0]].schema).parquet(*p) for p in schemas.values()]
    if not frames:
        return Combined(spark.createDataFrame([], "struct<>"), skipped)
    return Combined(frames[0] if len(frames) == 1 else combine(frames), skipped)


def joined_lines(
    df: DataFrame, text: str, order_by: Sequence[str], *, line: str = "line"
) -> DataFrame:
    """The lines of all texts in order, with one blank line between texts.

    This is the concatenated document as rows (text_no, line_no, line): a
    text writer sorted by them gives its file parts. No text is joined to one
    string, so the total has no size limit.
    """
    numbered = with_row_id(df.select(*order_by, text), order_by, name="text_no")
    lines = F.split(F.col(text), "\n")
    gap = F.when(F.col("text_no") > 0, F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    found = numbered.select("text_no", F.posexplode(F.concat(gap, lines)).alias("at", line))
    return found.select("text_no", F.col("at").cast("long").alias("line_no"), line)


_PACKED = (".gz", ".bz2", ".xz", ".zst", ".lz4", ".snappy", ".deflate")


def combine_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Concatenate text files in the given order, one blank line between.

    Each file is read line by line, by many tasks when it is large. Compressed
    files are refused: their size tells nothing about their last line.
    """
    if packed := [p for p in paths if _extension(p) in _PACKED]:
        raise ValueError(f"{packed[0]} is compressed; unpack it first")
    if len(paths) < 2:
        raise ValueError("at least two files are needed")
    if len({_extension(p) for p in paths}) > 1:
        raise ValueError("all files must be of the same type")
    parts = []
    for number, path in enumerate(paths):
        lines = spark.read.option("lineSep", "\n").text(path)
        parts.append(
            lines.select(
                F.lit(number).cast("long").alias("text_no"),
                F.col("_metadata.file_path").alias("__file"),
                F.col("_metadata.file_block_start").alias("__block"),
                F.col("_metadata.file_size").alias("__bytes"),
                F.monotonically_increasing_id().alias("__seq"),
                "value",
            )
        )
    lines = reduce(DataFrame.unionByName, parts)
    # A file that ends in a newline ends in an empty line, which the line
    # reader does not return: there are as many bytes as lines plus newlines.
    files = lines.groupBy("text_no", "__file").agg(
        (F.sum(F.octet_length("value") + 1) == F.max("__bytes")).alias("__ended")
    )
    files = files.groupBy("text_no").agg(F.max("__file").alias("__file"), F.max_by("__ended", "__file").alias("__ended"))
    texts = spark.createDataFrame([(i,) for i in range(len(paths))], "text_no bigint")
    files = texts.join(files, "text_no", "left")
    ended = F.coalesce("__ended", F.lit(True)).cast("int")  # an empty file is one empty line
    blanks = ended + (F.col("text_no") < len(paths) - 1).cast("int")
    gap = F.explode(F.sequence(F.lit(0), blanks)).alias("__gap")
    last = F.lit((1 << 63) - 1)
    gaps = files.select("text_no", F.coalesce("__file", F.lit("")).alias("__file"), last.alias("__block"), last.alias("__seq"), gap)
    gaps = gaps.filter("__gap > 0").withColumn("value", F.lit(""))
    lines = lines.select(
        "text_no", "__file", "__block", "__seq", F.lit(0).alias("__gap"), F.regexp_replace("value", r"\r\z", "").alias("value")
    )
    # Lines lie in their files in order, so their place there is all a sort needs.
    return lines.unionByName(gaps).select(
        "text_no", F.struct("__file", "__block", "__seq", "__gap").alias("place"), F.col("value").alias("line")
    )


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[name.rfind("."):] if "." in name else ""
