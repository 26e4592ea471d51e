"""One query per operator, over its whole table, and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import (
    chat,
    contamination,
    kmeans,
    licenses,
    merkle,
    mixing,
    page_labels,
    page_text,
    pii,
    quality,
    repeats,
    simhash,
    toxicity,
    urls,
)
from seedloom.llm.common import read_table
from seedloom.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(read_table(spark, folder, "documents")))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components_of(read_table(spark, folder, "documents"))


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.with_hostile(read_table(spark, folder, "conversations"))
    return chat.read_back(chat.format_turns(turns))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return mixing.mix(documents.select("doc_id", "source"), order_key=("doc_id",))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(read_table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.remove_repeats(read_table(spark, folder, "documents"), texts=True)
    # Removal cuts bytes, so a character at an edge may be left in part.
    return done.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    found = urls.filter_captures(urls.dated(pages), urls.derived_events(pages))
    days = [F.col(c).cast("string").alias(c) for c in ("fetched", "since")]
    return found.select("page_id", "url", "host", "n_active", "entry", "blocked", *days)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = (read_table(spark, folder, t) for t in ("documents", "benchmark"))
    return contamination.contamination(documents, benchmark).drop("text_hash")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(read_table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(*[read_table(spark, folder, t) for t in ("documents", "labels")])


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_proofs(read_table(spark, folder, "documents"))


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans.report(kmeans.cluster(read_table(spark, folder, "embeddings")))


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(read_table(spark, folder, "pages"), page_labels.default_model()).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scans": op8_license_scans,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_html_extraction": op13_html_extraction,
}
