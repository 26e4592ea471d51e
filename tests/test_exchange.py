import pytest
from pyspark.sql import functions as F

from seedloom.operators import checks, exchange
from seedloom.operators.amplify import amplify
from seedloom.operators.roles import check_roles, default_roles, reference_map, role_columns
from seedloom.plans import generation
from seedloom.plans.text_to_dataset import parse_documents
from seedloom.prompts import PromptSet, fill_prompt, prompt_set_names

ROLES = {"task": "static", "command": "reference", "input": "dynamic", "output": "dynamic"}


@pytest.fixture
def seeds(spark):
    rows = [
        (i, "t", "ignored", f"what is {i}", f"it is {{text}} {i}", f"/c'{i}") for i in range(5)
    ]
    return spark.createDataFrame(
        rows, "row_id bigint, task string, instruction string, input string, output string, command string"
    )


def test_roles(spark, seeds):
    assert default_roles(["task", "instruction", "command", "x"]) == {
        "task": "static", "instruction": "static", "command": "reference", "x": "dynamic",
    }
    assert default_roles(["task", "command_description"], earlier=True) == {
        "task": "dynamic", "command_description": "static",
    }
    with pytest.raises(ValueError):
        check_roles(seeds, {"task": "frozen"})
    with pytest.raises(ValueError):
        check_roles(seeds, {"nope": "static"})
    assert role_columns(seeds, ROLES, ["row_id"]).columns == ["row_id", *ROLES]
    assert seeds.select(reference_map(ROLES)).first()[0] == {"command": "/c'0"}


def test_prompts_fill_once_and_keep_odd_braces(spark):
    df = spark.createDataFrame([("{column} {x}", None)], "t string, n string")
    values = {"text": F.col("t"), "column": F.lit("C"), "n": F.col("n")}

    def filled(template):
        return df.select(fill_prompt(template, values)).first()[0]

    assert filled("{text}|{column}|{n}") == "{column} {x}|C|None"
    assert filled("{{literal}} {column}") == "{literal} C"
    assert filled('{"json": {"a": 1}} {column} {other}') == '{"json": {"a": 1}} C {other}'
    assert filled("") == ""


def test_prompt_sets(spark, tmp_path):
    folder = str(tmp_path / "prompts")
    assert prompt_set_names(spark, folder) == []
    prompts = PromptSet("S", {"input": {"user": "U {text}", "system": "IS"}}, {"verify": {"user": "V"}})
    prompts.save(spark, folder, "b")
    prompts.save(spark, folder, "a")
    assert prompt_set_names(spark, folder) == ["a", "b"]
    assert PromptSet.load(spark, folder, "a") == prompts
    with pytest.raises(KeyError):
        PromptSet.load(spark, folder, "c")
    assert prompts.system_prompt("generate", "input") == "IS"
    assert prompts.system_prompt("generate", "output") == "S"
    assert prompts.user_prompt("generate", "input") == "U {text}"
    assert prompts.user_prompt("verify", "input") == "V"
    assert "{generated}" in PromptSet().user_prompt("verify", "input")


def test_requests(spark, seeds):
    samples = amplify(seeds, 3)
    requests = exchange.build_requests(samples, ROLES)
    assert requests.count() == 5 * 3 * 2
    assert requests.select("request_id").distinct().count() == 30
    one = requests.filter("row_id = 1 and sample_no = 2 and column = 'input'").first()
    assert "Text: what is 1\n" in one["user"] and "Question: True" in one["user"]
    assert "Reference values: {'command': \"/c'1\"}" in one["user"]
    direct = exchange.build_requests(seeds, ROLES, copies=3)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, requests.collect()))
    other = exchange.build_requests(samples, ROLES, PromptSet(columns={"output": {"user": "new"}}))
    same = requests.join(other, "request_id").groupBy(requests["column"]).count().collect()
    assert [tuple(r) for r in same] == [("input", 15)]
    with pytest.raises(ValueError):
        exchange.build_requests(samples, {"task": "static"})


def test_responses_are_cleaned_or_rejected(spark, seeds):
    samples = amplify(seeds, 1)
    asked = {(r["row_id"], r["column"]): r["request_id"] for r in exchange.build_requests(samples, ROLES).collect()}
    answers = []
    for row in range(5):
        answers.append((asked[row, "input"], f'Generated content: "how {row}"'))
    answers.append((asked[0, "input"], "Error: first try"))
    answers += [
        (asked[0, "output"], " fine Note: x"),
        (asked[1, "output"], "Error: down"),
        (asked[2, "output"], '""'),
        (asked[3, "output"], None),
        ("0:1:stale:output", "never used"),
    ]
    responses = spark.createDataFrame(answers, "request_id string, content string")
    done = exchange.apply_responses(samples, responses, ROLES)
    assert [tuple(r) for r in done.rows.collect()] == [(0, 1, "t", "/c'0", "How 0?", "Fine.")]
    assert done.rows.columns == ["row_id", "sample_no", "task", "command", "input", "output"]
    rejects = {r["row_id"]: (r["column"], r["status"], r["content"]) for r in done.rejects.collect()}
    assert rejects == {
        1: ("output", "error", "Error: down"), 2: ("output", "empty", '""'),
        3: ("output", "missing", None), 4: ("output", "missing", None),
    }


def test_paraphrase_then_verify(spark, seeds):
    samples = amplify(seeds, 2)
    asked = exchange.build_requests(samples, ROLES, kind="paraphrase")
    first = exchange.apply_responses(samples, exchange.generate(asked), ROLES, kind="paraphrase").rows
    new = first.selectExpr("row_id", "sample_no", "input as input_new", "output as output_new")
    both = samples.join(new, ["row_id", "sample_no"])
    names = {"input": "input_new", "output": "output_new"}
    asked = exchange.build_requests(both, ROLES, kind="verify", generated=names)
    one = asked.filter("row_id = 1 and sample_no = 2 and column = 'input'").first()
    assert "Variant 2: what is 1" in one["user"]
    answers = asked.select("request_id", F.lit("  yes? ").alias("content"))
    done = exchange.apply_responses(both, answers, ROLES, kind="verify", generated=names).rows
    got = {(r["input"], r["output"]) for r in done.collect()}
    assert got == {("yes?", "yes.")}
    asked = exchange.build_requests(both, ROLES, kind="verify_paraphrase", generated=names)
    answers = asked.select("request_id", F.lit("  yes? ").alias("content"))
    kept = exchange.apply_responses(both, answers, ROLES, kind="verify_paraphrase", generated=names).rows
    assert {(r["input"], r["output"]) for r in kept.collect()} == {("yes?", "yes?")}
    loose = exchange.apply_responses(samples, exchange.generate(exchange.build_requests(samples, ROLES, kind="similar")), ROLES, kind="similar").rows
    assert loose.filter("row_id = 1 and sample_no = 1").first()["input"] == "Variant 1: what is 1"


def test_run_and_checks(spark, seeds):
    settings = generation.Generation(variants=3, roles=ROLES)
    done = generation.run(seeds, settings, exchange.restate, tasks=2)
    assert done.rows.count() == 15 and done.rejects.isEmpty() and done.unchanged == []
    assert checks.invariance_report(seeds, done.rows, ROLES).filter("changed_rows > 0").isEmpty()
    counts = {r["row_id"]: (r["seeds"], r["samples"]) for r in checks.sample_counts(seeds, done.rows).collect()}
    assert counts == {i: (1, 3) for i in range(5)}

    part = generation.run(seeds, generation.Generation(rate=40, use_all=False), exchange.restate).rows
    assert part.count() == 2 and set(part.columns) == {"sample_no", *seeds.columns}

    def silent(requests):
        return ["Error: off"] * len(requests)

    with pytest.raises(ValueError, match="empty"):
        generation.run(seeds, settings, silent)

    echoed = amplify(seeds, 2)
    assert checks.check_generated(seeds, echoed, ROLES) == ["input", "output"]
    broken = echoed.withColumn("task", F.when(F.col("row_id") == 3, F.lit(None)).otherwise(F.col("task")))
    with pytest.raises(ValueError, match="task"):
        checks.check_generated(seeds, broken, ROLES)


def test_hot_seed_is_compared_exactly(spark):
    seeds = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "row_id bigint, x string")
    result = amplify(seeds.filter("row_id = 0"), 9000).unionByName(amplify(seeds.filter("row_id > 0"), 2))
    result = result.withColumn("x", F.when(F.col("sample_no") == 8999, "b").otherwise(F.col("x")))
    got = checks.change_report(seeds, result, {"x": "dynamic"}).first()
    assert (got["rows"], got["same_rows"], got["changed_rows"]) == (9004, 9003, 1)


def test_fill_to_size(spark):
    seeds = spark.createDataFrame([("n", 1)], "name string, qty int")
    fields = {"name": "a name", "qty": "a number"}
    asked = exchange.fill_to_size(spark, seeds, 4, fields)
    assert asked.count() == 6
    answers = asked.select(
        "request_id",
        F.when(F.col("row_id") == 3, "Error: x").when(F.col("column") == "qty", "7").otherwise(" raw {").alias("content"),
    )
    points = exchange.parsed_data_points(asked, answers)
    got = exchange.filled_rows(seeds, points, list(fields))
    assert {(r["row_id"], r["column"], r["status"]) for r in got.rejects.collect()} == {(3, "name", "error"), (3, "qty", "error")}
    assert sorted(map(tuple, got.rows.collect())) == [("n", "1"), ("raw {", "7"), ("raw {", "7")]
    assert exchange.fill_to_size(spark, seeds, 0, fields).isEmpty()


def test_one_sample_and_copies(spark, tmp_path):
    sample = exchange.one_sample(spark, {"text": "hello"})
    asked = generation.paraphrase_requests(sample, "text", 3)
    assert asked.count() == 3
    cells = spark.createDataFrame([(0, "a"), (1, "b")], "row_id bigint, text string")
    asked = generation.paraphrase_requests(cells, "text", 2)
    copies = generation.paraphrased_copies(exchange.generate(asked), asked)
    late = copies.select("failed").distinct().collect()
    assert [r[0] for r in late] == [False]
    none = generation.paraphrased_copies(exchange.generate(asked).limit(0), asked)
    assert {(r["value"], r["failed"]) for r in none.collect()} == {(None, True)}
    assert generation.judged_copies(exchange.generate(asked).limit(0), asked).rejects.count() == 4
    with pytest.raises(ValueError):
        generation.write_copies(none, str(tmp_path / "none"))
    generation.write_copies(copies, str(tmp_path / "c"))
    texts = ["".join(p.read_text() for p in sorted((tmp_path / "c" / f"copy_no={i}").glob("part*"))) for i in (1, 2)]
    assert texts == [f'$("Variant {i}: a")\n\n$("Variant {i}: b")\n\n' for i in (1, 2)]


def test_automatic_parse(spark):
    docs = spark.createDataFrame([(0, "x y"), (1, "z")], "row_id bigint, text string")
    asked = exchange.tag_requests(docs, "text", ["a", "b"])
    answers = asked.filter("row_id = 0").select("request_id", F.lit('$("x")$("y")$("w")').alias("content"))
    got = parse_documents(docs, "text", ["a", "b"], mode="automatic", responses=answers)
    assert [tuple(r) for r in got.rows.orderBy("row_no").collect()] == [(0, 0, "x", "y"), (0, 1, "w", "")]
    assert [(r["row_id"], r["status"]) for r in got.rejects.collect()] == [(1, "missing")]
    padded = asked.select("request_id", F.lit(' Error: call $("x") failed').alias("content"))
    bad = parse_documents(docs, "text", ["a", "b"], mode="automatic", responses=padded)
    assert bad.rows.isEmpty() and {r["status"] for r in bad.rejects.collect()} == {"error"}
    with pytest.raises(ValueError):
        parse_documents(docs, "text", ["a"], mode="other")


def test_padded_errors_and_failing_generators(spark, seeds):
    samples = amplify(seeds, 1)
    asked = exchange.build_requests(samples, ROLES)
    padded = asked.select("request_id", F.lit("\n Error: timed out").alias("content"))
    done = exchange.apply_responses(samples, padded, ROLES)
    assert done.rows.isEmpty() and {r["status"] for r in done.rejects.collect()} == {"error"}

    def breaks(requests):
        raise RuntimeError("no model")

    assert {r["content"] for r in exchange.generate(asked, breaks).collect()} == {"Error: no model"}
    short = exchange.generate(asked.coalesce(1), lambda batch: ["one"], tasks=1)
    assert all(r["content"].startswith("Error: 1 contents") for r in short.collect())


def test_judged_samples_are_joined_without_their_texts(spark, seeds):
    samples = amplify(seeds, 2)
    responses = exchange.generate_to(exchange.build_requests(samples, ROLES))
    judged = exchange.judge_responses(samples, responses, ROLES)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = judged._jdf.queryExecution().explainString(mode).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [lines[n + 1] for n, line in enumerate(lines) if ") Exchange" in line]
    assert any("__cells" in x for x in dealt) and not any("input#" in x for x in dealt)
    assert {r.changed.input for r in judged.collect()} == {True}
    same = exchange.build_requests(samples, ROLES).select("request_id", F.when(F.col("column") == "input", F.col("text")).otherwise("x").alias("content"))
    told = exchange.judge_responses(samples, same, ROLES, kind="similar").collect()
    asked = {(r.row_id, r.sample_no): r.input for r in samples.collect()}
    assert all(r.changed.input == (r.input != asked[r.row_id, r.sample_no]) for r in told)


def test_generators_get_small_batches(spark, seeds):
    asked = exchange.build_requests(seeds, ROLES, copies=300).coalesce(1)
    sizes = exchange.generate(asked, lambda batch: [str(len(batch))] * len(batch), tasks=1).collect()
    assert len(sizes) == 5 * 300 * 2 and max(int(r["content"]) for r in sizes) <= exchange.CALL
    some = exchange.generate(asked, lambda batch: batch["text"].where(batch["column"] == "input"))
    assert {r["content"] is None for r in some.collect()} == {True, False}


def test_no_expanded_request_is_shuffled(spark, seeds):
    many = exchange.build_requests(seeds, ROLES, copies=200, tasks=3)
    made = exchange.generate(many, spread=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "request_id" not in plan.split("Exchange", 1)[1]
    assert made.count() == 5 * 200 * 2 and made.rdd.getNumPartitions() == 3
    samples = amplify(seeds, 2)
    done = exchange.apply_responses(samples, exchange.generate(exchange.build_requests(samples, ROLES)), ROLES).rows
    before = exchange.generate(exchange.build_requests(samples, ROLES))._jdf.queryExecution().executedPlan().toString()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - before.count("Exchange") <= 2


def test_foreign_and_repeated_responses_stay_out_of_rows(spark, seeds):
    """Ids of other jobs, broken and null ids never meet in one row."""
    asked = exchange.build_requests(seeds, ROLES, copies=2)
    good = exchange.generate(asked)
    many = spark.range(20_000)
    foreign = many.selectExpr("concat('job-b-', id) as request_id", "repeat('x', 100) as content")
    foreign = foreign.union(many.selectExpr("cast(null as string)", "'y'")).union(many.selectExpr("''", "'z'"))
    again = good.select("request_id", F.lit("Error: late").alias("content"))
    repeated = good
    for _ in range(5):
        repeated = repeated.union(again)
    judged = exchange.judge_responses(seeds, repeated.union(foreign), ROLES, copies=2)
    done = exchange.split_samples(judged)
    assert done.rows.count() == 10 and done.rejects.isEmpty()
    assert exchange.foreign_responses(repeated.union(foreign)).count() == 60_000


def test_counts_come_with_the_write(spark, seeds):
    settings = generation.Generation(variants=3, roles=ROLES)
    requests = generation.make_requests(seeds, settings)
    answers = exchange.generate(requests).withColumn(
        "content", F.when(F.col("request_id").startswith("0:"), "Error: none").otherwise(F.col("content"))
    )
    done = generation.finish(seeds, answers, settings)
    assert done.counts["rows"] == done.rows.count() == 12
    failed = {r["column"]: r["count"] for r in done.rejects.groupBy("column").count().collect()}
    assert {c: done.counts[f"{c} failed"] for c in ("input", "output")} == failed
    assert done.counts["input changed"] == 12 and done.unchanged == []
