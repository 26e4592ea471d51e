import pytest
from pyspark.sql import functions as F

from seedloom.operators import refine
from seedloom.operators.amplify import amplify

ROWS = [(1, "A  b"), (2, "a b "), (3, None), (4, " \n"), (5, "x {command}"), (6, '")'), (7, "c"), (7, "c"), (8, "A B {text}")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id bigint, text string")


def test_first_of_equal_texts_stays(spark, rows):
    got = refine.exact_dedup(rows.filter("row_id < 5"), ["text"]).select("row_id").collect()
    assert sorted(r[0] for r in got) == [1, 3]
    hot = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("same").alias("text"))
    assert [r[0] for r in refine.exact_dedup(hot, ["text"]).select("row_id").collect()] == [0]


def test_every_row_is_kept_or_rejected_with_a_reason(rows):
    done = refine.refine(rows, ["text"])
    reasons = {r["row_id"]: r["reason"] for r in done.rejects.collect()}
    assert reasons == {2: "duplicate", 3: "empty", 4: "empty", 5: "placeholder", 6: "mark", 8: "placeholder"}
    assert sorted(r["row_id"] for r in done.rows.collect()) == [1, 7, 7]
    assert refine.refine(rows.limit(0), ["text"]).rejects.isEmpty()


def test_flagged_rows_go(spark, rows):
    labels = spark.createDataFrame([(1, 1.0), (2, 0.1), (3, None)], "row_id bigint, toxic double")
    kept = refine.drop_flagged(rows, labels, {"toxic": (">=", 0.5)})
    assert sorted(r["row_id"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 7, 8]


def test_variants_of_a_seed_share_a_split(spark):
    seeds = spark.range(2000).withColumnRenamed("id", "row_id")
    split = refine.split_by_seed(amplify(seeds, 3), {"train": 8, "eval": 1, "test": 1})
    per_seed = split.groupBy("row_id").agg(F.count_distinct("split").alias("n"))
    assert per_seed.filter("n <> 1").isEmpty()
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert set(counts) == {"train", "eval", "test"} and 4500 < counts["train"] < 5100


def test_reference_values_are_looked_for(spark):
    df = spark.createDataFrame([(1, "go /a", "/a"), (2, "go", "/a"), (3, None, "/a"), (4, "x", None)], "row_id bigint, out string, ref string")
    done = refine.reference_use(df, ["out"], ["ref"])
    assert [tuple(r) for r in done.rows.collect()] == [("out", 4, 2, 0.5)]
    assert sorted(r["row_id"] for r in done.rejects.collect()) == [2, 3]
