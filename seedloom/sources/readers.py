"""Reading datasets and texts."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions.text import py_strip, unix_newlines

# File types that count as datasets.
DATASET_EXTENSIONS = [".json", ".parquet", ".txt", ".tex"]


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, lines: bool = False
) -> DataFrame:
    """Read a JSON array of records, or JSON lines.

    An array file cannot be split, so large data should come as lines. Give
    a schema to keep its column order and spare a pass over the data.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def read_tab_separated(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header line; every line is stripped first.

    Short lines are filled with NULL, and a line wider than the header fails.
    Blank lines are rows whose first cell is empty. Each file has a header,
    and files with different ones are an error.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        # A line's place in its file: the first block starts at 0, and within a
        # block lines are numbered as they are read.
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    first = lines.filter("__block = 0").groupBy("__file").agg(F.min("__seq").alias("__seq"), F.min_by("value", "__seq").alias("head"))
    heads = first.select(py_strip(F.col("head")).alias("head")).distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"{path} has no header line")
    if len(heads) > 1:
        raise ValueError(f"the files of {path} have different headers: {heads[0][0]!r} and {heads[1][0]!r}")
    names = heads[0][0].split("\t")
    # One row per file.
    starts = first.select(F.col("__file").alias("__f"), F.col("__seq").alias("__s"))
    same = (F.col("__file") == F.col("__f")) & (F.col("__seq") == F.col("__s"))
    cells = lines.join(starts, same, "left_anti").select(F.split(py_strip(F.col("value")), "\t").alias("cells"))
    wide = F.size("cells") > len(names)
    fit = F.when(wide, F.raise_error(F.lit("a line has more cells than the header")))
    checked = cells.select(fit.otherwise(F.col("cells")).cast("array<string>").alias("cells"))
    return checked.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


# Conditions and messages of paths that are not there and files of another form.
_UNREADABLE = (
    "PATH_NOT_FOUND",
    "UNABLE_TO_INFER_SCHEMA",
    "CANNOT_READ_FILE_FOOTER",
    "FAILED_READ_FILE",
    "is not a Parquet file",
    "Could not read footer",
    "EMPTY_SCHEMA",
)


def unreadable(error: Exception) -> bool:
    """Whether a path is missing or of another form; other errors are no reason to skip it."""
    return any(reason in str(error) for reason in _UNREADABLE)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet if the path is one and can be read, else the sibling JSON or text."""
    stem, _, extension = path.rpartition(".")
    tries = [
        (f"{stem}.json", lambda p: read_json_records(spark, p)),
        (f"{stem}.txt", lambda p: read_tab_separated(spark, p)),
    ]
    if extension.lower() == "parquet":
        tries.insert(0, (path, lambda p: read_parquet(spark, p)))
    for candidate, read in tries:
        try:
            found = read(candidate)
        except ValueError:
            continue
        except (PySparkException, Py4JJavaError) as error:
            if not unreadable(error):
                raise
            continue
        if found.columns and found.columns != ["_corrupt_record"]:
            return found
    raise ValueError(f"cannot read {path} or its JSON or text sibling")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files as (path, content), with plain newlines."""
    found = spark.read.text(path, wholetext=True)
    return found.select(
        F.col("_metadata.file_path").alias("path"), unix_newlines(F.col("value")).alias("content")
    )


def list_datasets(
    spark: SparkSession, folder: str, extensions: Sequence[str] = DATASET_EXTENSIONS
) -> DataFrame:
    """Datasets directly in a folder: (dataset, files, bytes, modified).

    A dataset is a file, or a folder of part files, whose name has one of the
    extensions. File contents are not read.
    """
    schema = "dataset string, files bigint, bytes bigint, modified timestamp"
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(folder)
            .select("path", "length", "modificationTime")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    below = F.substring_index("path", folder.rstrip("/") + "/", -1)
    name = F.substring_index(below, "/", 1)
    wanted = F.lit(False)
    for extension in extensions:
        wanted = wanted | name.endswith(extension)
    return (
        files.withColumn("dataset", name)
        .filter(wanted)
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("modified"),
        )
    )


def list_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """JSON and Parquet datasets, newest first."""
    found = list_datasets(spark, folder, [".json", ".parquet"])
    return found.orderBy(F.desc("modified"), "dataset")


def dataset_files(spark: SparkSession, folder: str, extensions: Sequence[str]) -> list[str]:
    """Paths of the datasets in a folder, sorted by name."""
    names = list_datasets(spark, folder, extensions).select("dataset").orderBy("dataset")
    return [f"{folder.rstrip('/')}/{row[0]}" for row in names.collect()]
