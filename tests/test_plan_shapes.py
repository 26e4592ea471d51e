"""What the physical plans must, and must not, contain."""

import pytest
from pyspark.sql import functions as F

from seedloom.functions.text import clean_generated, is_question
from seedloom.operators import amplify as A
from seedloom.operators import checks, exchange, parsing, rows, sampling
from seedloom.operators.combining import combine


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "t.parquet")
    spark.range(5000).selectExpr(
        "id AS row_id", "concat('$(\"', id, '\")') AS content", "repeat('x', 50) AS other"
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_wise_operators_do_not_shuffle(stored):
    parsed = parsing.parse_tagged(stored, "content", ["a", "b"], keep=["row_id"])
    ruled = stored.select(clean_generated(F.col("content"), is_question(F.col("content"))))
    asked = exchange.build_requests(
        A.amplify(stored, 3), {"content": "dynamic"}
    )
    for df in (parsed, ruled, asked, combine([stored, stored.drop("other")])):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
    assert "other" not in plan(parsed)


def test_page_filter_reaches_the_files(stored):
    text = plan(rows.page_rows(stored, 3, 25))
    assert "GreaterThanOrEqual(row_id,75)" in text and "LessThan(row_id,100)" in text


def test_dropped_columns_are_not_read(stored):
    text = plan(rows.drop_columns(stored, ["content", "other"]).rows)
    assert "ReadSchema: struct<row_id:bigint>" in text


def test_preview_is_a_top_k(stored):
    assert "TakeOrderedAndProject(limit=100" in plan(rows.preview(stored))


def test_few_edits_do_not_shuffle_the_table(spark, stored):
    edits = spark.createDataFrame([(0, 1, "other", "y")], "edit_no int, row_id bigint, column string, value string")
    changed = plan(rows.apply_edits(stored, edits)).split("LeftAnti")[0]
    assert "BroadcastHashJoin [row_id" in changed
    assert "Exchange" not in changed.replace("BroadcastExchange", "")


def test_sample_is_a_filter(stored):
    assert "Exchange" not in plan(sampling.sample_rows(stored, size=1000))


def test_comparison_aggregates_before_its_shuffle(stored):
    text = plan(checks.compare_with_seeds(stored, A.amplify(stored, 5), ["content"]))
    assert "Join" not in text and "partial_count" in text


def test_large_quotas_are_spread_over_fixed_partitions(spark, stored):
    few = stored.limit(3)
    spread = A.amplify(few, 100 * A.BLOCK)
    assert spread.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread.count() == 300 * A.BLOCK


def test_order_in_files_needs_no_sorting(spark, tmp_path):
    from seedloom.operators.combining import combine_texts

    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text('$("x")\n$("y")\n' * 50)
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt")]
    for df in (combine_texts(spark, paths), parsing.parse_tagged_files(spark, paths, ["a", "b"])):
        assert "rangepartitioning" not in plan(df)
