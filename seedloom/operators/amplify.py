"""Several samples per seed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions.expr import whole_div
from seedloom.operators.numbering import with_row_id

# Samples made from one copy of a seed row; larger quotas are spread first.
BLOCK = 64
# Samples that one task should make when there are more than the settings ask tasks for.
ROWS_PER_TASK = 500_000

_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def task_count(spark: SparkSession, rows: int = 0) -> int:
    """Tasks for an output of so many rows, at least as many as the session sets."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    initial = spark.conf.get(_INITIAL, None)
    return max(int(partitions), int(initial or 0), -(-rows // ROWS_PER_TASK))


def _copies(
    df: DataFrame, quota: Column, largest: int, total: int | None, row_id: str, sample_no: str, tasks: int | None
) -> DataFrame:
    if largest <= BLOCK and tasks is None:
        return df.withColumn(sample_no, F.explode(F.sequence(F.lit(1), quota)))
    # A few seeds times a huge quota would come from a few tasks, so the
    # blocks of each seed are shuffled before they are expanded. The number of
    # partitions is fixed: AQE would merge them by their size before expansion.
    last = whole_div(quota - 1, BLOCK).cast("int")
    blocks = df.withColumn("__block", F.explode(F.sequence(F.lit(0), last)))
    if tasks is None:
        tasks = task_count(df.sparkSession, total if total is not None else df.count() * largest)
    spread = blocks.repartition(tasks, row_id, "__block")
    first = F.col("__block") * BLOCK + 1
    stop = F.least(first + BLOCK - 1, quota)
    return spread.withColumn(sample_no, F.explode(F.sequence(first, stop))).drop("__block")


def amplify(
    seeds: DataFrame, copies: int, *, row_id: str = "row_id", sample_no: str = "sample_no", tasks: int | None = None
) -> DataFrame:
    """``copies`` samples of every seed row, numbered from 1.

    With ``tasks`` the seeds are spread over so many before they are
    multiplied, however few the copies.
    """
    if copies <= 0:
        return seeds.withColumn(sample_no, F.lit(1)).limit(0)
    return _copies(seeds, F.lit(copies), copies, None, row_id, sample_no, tasks)


def amplify_total(
    seeds: DataFrame, total: int, *, row_id: str = "row_id", sample_no: str = "sample_no"
) -> DataFrame:
    """``total`` samples over all seeds; the first seeds by id get one more.

    No seeds give no samples. Ids that count up without a gap are their own
    ranks; others, repeated ones too, are ranked first.
    """
    count, low, high = seeds.agg(F.count(F.lit(1)), F.min(row_id), F.max(row_id)).first()
    if count == 0 or total <= 0:
        return amplify(seeds, 0, row_id=row_id, sample_no=sample_no)
    each, rest = divmod(total, count)
    if rest == 0:
        return amplify(seeds, each, row_id=row_id, sample_no=sample_no)
    dense = isinstance(low, int) and high - low + 1 == count
    if dense and seeds.select(row_id).distinct().count() == count:
        ranked = seeds.withColumn("__rank", F.col(row_id) - low)
    else:
        ranked = with_row_id(seeds, [row_id], name="__rank")
    quota = F.when(F.col("__rank") < rest, each + 1).otherwise(each)
    ranked = ranked.withColumn("__quota", quota).filter("__quota > 0")
    made = _copies(ranked, F.col("__quota"), each + 1, total, row_id, sample_no, None)
    return made.drop("__rank", "__quota")


def missing_rows(spark: SparkSession, present: int, size: int) -> DataFrame:
    """Ids of the rows a dataset lacks to reach ``size``, after the present ones."""
    return spark.range(present, max(size, present)).withColumnRenamed("id", "row_id")
