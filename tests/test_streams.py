"""Row-wise operators and the exchange on streams."""

import json

from pyspark.sql import functions as F

from seedloom.functions import text as X
from seedloom.functions import urls as U
from seedloom.operators import exchange, refine
from seedloom.streaming import arrivals


def arriving(spark, tmp_path, rows, schema):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for n, part in enumerate((rows[::2], rows[1::2])):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in part))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


ANSWERS = [{"request_id": f"{n}", "content": c, "question": n % 2 == 0} for n, c in enumerate(
    ["what is it", "it is so", "Error: no", None, " Error: blank", "fine"])]


def test_exchange_in_one_pass_and_again(spark, tmp_path):
    stream = arriving(spark, tmp_path, ANSWERS, "request_id string, content string, question boolean")
    out = str(tmp_path / "out")
    arrivals.write_exchange(stream, "question", out, str(tmp_path / "check")).awaitTermination()
    done = arrivals.read_exchange(spark, out)
    first = (sorted(done.rows.collect()), sorted(r.request_id for r in done.rejects.collect()))
    assert {r.request_id: r.content for r in done.rows.collect()} == {"0": "What is it?", "1": "It is so.", "5": "Fine."}
    assert first[1] == ["2", "3", "4"] and done.rows.select("batch").distinct().count() == 2
    # The checkpoint is lost and all batches run anew: nothing is added.
    arrivals.write_exchange(stream, "question", out, str(tmp_path / "other")).awaitTermination()
    again = arrivals.read_exchange(spark, out)
    assert (sorted(again.rows.collect()), sorted(r.request_id for r in again.rejects.collect())) == first


def test_row_wise_operators_run_on_streams(spark, tmp_path):
    rows = [
        {"row_id": 1, "text": '{"a": 1}', "url": "https://en.wikipedia.org/wiki/A_b"}, {"row_id": 2, "text": "raw {text}", "url": "github.com/x/y"},
        {"row_id": 3, "text": "", "url": None}, {"row_id": 4, "text": '$("', "url": "https://arxiv.org/abs/1"},
    ]
    schema = "row_id bigint, text string, url string"
    stream, out = arriving(spark, tmp_path, rows, schema), str(tmp_path / "out")
    shown = X.json_or_raw(F.col("text"))

    def judged(df):
        return df.select(
            "row_id", F.to_json(shown["value"]).alias("json"), shown["raw"].alias("raw"), U.url_kind(F.col("url")).alias("kind"),
            U.extracted_name(F.col("url")).alias("name"), refine.row_fault(["text"]).alias("fault"),
        )

    arrivals.append_to(judged(stream), out, str(tmp_path / "check")).awaitTermination()
    fixed = spark.createDataFrame([(r["row_id"], r["text"], r["url"]) for r in rows], schema)
    assert sorted(map(repr, spark.read.parquet(out).collect())) == sorted(map(repr, judged(fixed).collect()))
    assert {r.row_id: r.fault for r in judged(fixed).collect()} == {1: None, 2: "placeholder", 3: "empty", 4: "mark"}


def test_requests_are_built_on_a_stream(spark, tmp_path):
    rows = [{"row_id": n, "task": "t", "input": f"what {n}", "command": "/c"} for n in range(4)]
    schema = "row_id bigint, task string, input string, command string"
    roles = {"task": "static", "input": "dynamic", "command": "reference"}
    stream, out = arriving(spark, tmp_path, rows, schema), str(tmp_path / "out")
    arrivals.append_to(exchange.build_requests(stream, roles, copies=2, tasks=2), out, str(tmp_path / "check")).awaitTermination()
    fixed = exchange.build_requests(spark.createDataFrame([tuple(r.values()) for r in rows], schema), roles, copies=2)
    assert sorted(spark.read.parquet(out).select(*fixed.columns).collect()) == sorted(fixed.collect())
