"""Tagged text in, a table and its JSON lines out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.exchange import KEYS, Exchange, best_responses, response_status, tag_requests
from seedloom.operators.parsing import parse_tagged, parse_tagged_files
from seedloom.prompts import PromptSet
from seedloom.sources.writers import write_json_lines, write_parquet


def convert_tagged_files(
    spark: SparkSession, source: str | list[str], fields: Sequence[str], stem: str, *, mode: str = "error"
) -> DataFrame:
    """Parse tagged files once, write ``stem.parquet`` and, from it, ``stem.json``."""
    rows = parse_tagged_files(spark, source, fields)
    ordered = rows.repartitionByRange("file", "row_no").sortWithinPartitions("file", "row_no")
    write_parquet(ordered.select(*fields), f"{stem}.parquet", mode=mode)
    table = spark.read.parquet(f"{stem}.parquet")
    write_json_lines(table, f"{stem}.json", mode=mode)
    return table


def parse_documents(
    documents: DataFrame,
    content: str,
    fields: Sequence[str],
    *,
    mode: str = "manual",
    responses: DataFrame | None = None,
    prompts: PromptSet | None = None,
) -> Exchange:
    """Rows of tagged documents (``row_id``, content), and what to ask for again.

    In mode ``automatic`` the marks come from responses to ``tag_requests``;
    documents whose response is missing or an error are the rejects. In mode
    ``manual`` there are none.
    """
    if mode == "manual":
        nothing = documents.select("row_id", F.lit("").alias("request_id"), F.lit("").alias("status"))
        return Exchange(parse_tagged(documents, content, fields, keep=["row_id"]), nothing.limit(0))
    if mode != "automatic":
        raise ValueError(f"mode must be 'manual' or 'automatic', not {mode!r}")
    if responses is None:
        raise ValueError("automatic mode needs responses to tag_requests")
    asked = tag_requests(documents, content, fields, prompts).select("request_id", *KEYS, "column")
    answered = asked.join(best_responses(responses), "request_id", "left")
    judged = answered.withColumn("status", response_status(F.col("content")))
    rows = parse_tagged(judged.filter("status = 'ok'"), "content", fields, keep=["row_id"])
    rejects = judged.filter("status <> 'ok'").select(*KEYS, "request_id", "column", "status", "content")
    return Exchange(rows, rejects)
