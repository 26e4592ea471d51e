import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seedloom.operators import amplify as A
from seedloom.operators import combining, numbering, parsing, profiling, rendering, rows, sampling
from seedloom.operators.augment import augment
from seedloom.templates import TemplateRegistry, unique_fields


def by(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


# --- numbering -------------------------------------------------------------


def test_row_ids_are_dense_and_ordered(spark):
    rng = random.Random(1)
    keys = [(rng.randint(0, 5), i) for i in range(5000)]
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "k int, u int").repartition(7)
    got = by(numbering.with_row_id(df, ["k", "u"], num_partitions=9).select("row_id", "k", "u"), "row_id")
    assert got == [(i, *key) for i, key in enumerate(sorted(keys))]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_number_within_a_hot_group(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rng = random.Random(2)
    keys = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 40)}", i) for i in range(3000)]
    keys += [(None, 3000 + i) for i in range(20)]
    df = spark.createDataFrame(keys, "g string, u int").repartition(5)
    got = numbering.number_within(df, ["g"], [F.desc("u")], size_name="n", block=64).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = {}
    for g in {k for k, _ in keys}:
        members = sorted((u for k, u in keys if k == g), reverse=True)
        expected |= {(g, u): (i, len(members)) for i, u in enumerate(members)}
    assert {(r["g"], r["u"]): (r["position"], r["n"]) for r in got} == expected
    assert len(got) == len(keys)


# --- sampling --------------------------------------------------------------


def test_sample_is_exact_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_FEW", 5)
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    for size in (1, 7, 999, 2000):
        ids = [r[0] for r in by(sampling.sample_rows(df, size=size), "row_id")]
        assert len(ids) == size
        again = sampling.sample_rows(df.repartition(11), size=size)
        assert [r[0] for r in by(again, "row_id")] == ids
    assert sampling.sample_rows(df, rate=33.37).count() == int(2000 * (33.37 / 100))
    assert sampling.sample_rows(df, rate=150).count() == 2000
    assert sampling.sample_rows(df, rate=0).count() == 0
    assert sampling.sample_rows(df, rate=5, use_all=True).count() == 2000
    other = {r[0] for r in sampling.sample_rows(df, size=999, seed=7).collect()}
    assert other != {r[0] for r in sampling.sample_rows(df, size=999).collect()}


# --- parsing ---------------------------------------------------------------


def tagged(cells):
    return "\n".join(f'$("{c}")' for c in cells)


def test_padded_and_dropped_rows(spark):
    df = spark.createDataFrame([(1, tagged([" a ", "b", "c", "d"])), (2, "none"), (3, "")], "id int, t string")
    pad = parsing.parse_tagged(df, "t", ["x", "y", "z"], keep=["id"])
    assert by(pad, "id", "row_no") == [(1, 0, "a", "b", "c"), (1, 1, "d", "", "")]
    raw = parsing.parse_tagged(df, "t", ["x", "y", "z"], keep=["id"], strip=False)
    assert by(raw, "id", "row_no")[0] == (1, 0, " a ", "b", "c")
    drop = parsing.parse_tagged(df, "t", ["x", "y", "z"], keep=["id"], ragged="drop")
    assert drop.count() == 1
    one = parsing.parse_tagged(df, "t", ["x"], keep=["id"])
    assert [r[2] for r in by(one, "id", "row_no")] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        parsing.parse_tagged(df, "t", ["x"], ragged="odd")


@pytest.mark.parametrize("ragged", ["pad", "drop"])
def test_tagged_files_split_over_tasks(spark, tmp_path, ragged):
    """Small read splits cut the files inside cells and marks."""
    rng = random.Random(3)
    texts = []
    for n in (0, 1, 5, 301):
        cells = ["".join(rng.choices('ab é\n"$(', k=rng.randint(0, 30))).replace('$("', "") for _ in range(n)]
        cells = [c.replace('")', "").removesuffix("$(") for c in cells]
        lead = 'preamble (with ") a closing mark) '
        texts.append(lead + "\r\n between ".join(f'$("{c}")' for c in cells) + ' $("open')
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_text(text, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = parsing.parse_tagged_files(spark, str(tmp_path), ["x", "y", "z"], ragged=ragged)
        got = by(got.withColumn("file", F.regexp_extract("file", r"f(\d)", 1).cast("int")), "file", "row_no")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.createDataFrame(list(enumerate(texts)), "file int, t string")
    assert got == by(parsing.parse_tagged(whole, "t", ["x", "y", "z"], keep=["file"], ragged=ragged), "file", "row_no")
    assert len(got) > 90


def test_round_robin_counts_blank_lines(spark):
    df = spark.createDataFrame([(1, "a\n\n b \nc\nd")], "id int, t string")
    got = parsing.round_robin_lines(df, "t", ["x", "y"], keep=["id"]).first()
    assert got == Row(id=1, x=["a", "b", "d"], y=["c"])


def test_agent_pairs(spark):
    cells = [f"{g}{k}" for g in "pqr" for k in range(6)]
    df = spark.createDataFrame([(1, tagged(cells))], "id int, t string")
    got = parsing.pair_agents(df, "t", keep=["id"]).collect()
    assert len(got) == 1
    assert tuple(got[0]["agent_one"]) == ("p0", "p1", "p2")
    assert tuple(got[0]["agent_two"]) == ("q3", "q4", "q5")


def test_turn_pairs(spark):
    turns = [(c, t, f"{c}.{t}") for c in range(4) for t in range(10, 13 + c)]
    df = spark.createDataFrame(turns, "c int, t int, x string")
    got = by(parsing.pair_turns(df, "c", "t", ["x"]), "c", "pair_no")
    assert got[0] == (0, 0, "0.10", "0.11")
    assert len(got) == 1 + 2 + 2 + 3


# --- rows --------------------------------------------------------------------


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    sliced = rows.drop_columns(df, ["b", "zzz"])
    assert (sliced.rows.columns, sliced.removed) == (["a"], ["b"])
    with pytest.raises(ValueError):
        rows.drop_columns(df, [])


def test_pages_cover_the_table(spark):
    df = spark.range(23).withColumnRenamed("id", "row_id")
    pages = [by(rows.read_page(df, p).rows, "row_id") for p in range(4)]
    assert [len(p) for p in pages] == [10, 10, 3, 0]
    assert [r for p in pages for (r,) in p] == list(range(23))
    assert rows.read_page(df, 1).total_rows == 23
    assert rows.preview(df).count() == 23


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_edits(spark, threshold):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3)], "row_id bigint, s string, n int")
    edits = spark.createDataFrame(
        [
            (0, 0, "s", "first"), (1, 0, "s", "last"), (2, 1, "n", "9"), (3, 2, "s", None),
            (4, 7, "n", "5"), (5, 1, "new", "x"),
        ],
        "edit_no int, row_id bigint, column string, value string",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = rows.apply_edits(df, edits, columns=["s", "n", "new"])
        assert got.columns == ["row_id", "s", "n", "new"]
        assert by(got, "row_id") == [
            (0, "last", 1, None), (1, "b", 9, "x"), (2, None, 3, None), (7, None, 5, None),
        ]
        with pytest.raises(ValueError, match="new"):
            rows.apply_edits(df, edits)
        odd = edits.limit(0).union(spark.createDataFrame([(0, 0, "n", "many"), (1, 1, "n", "4")], edits.schema))
        assert by(rows.apply_edits(df, odd), "row_id") == [(0, "a", 1), (1, "b", 4), (2, "c", 3)]
        assert [r["value"] for r in rows.rejected_edits(df, odd).collect()] == ["many"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- combining ---------------------------------------------------------------


def test_combine_aligns_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("7", 1.5)], "n string, d double")
    got = combining.combine([a, b, a])
    assert got.columns == ["n", "s", "d"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "x", None), ("1", "x", None), ("7", None, 1.5)]
    with pytest.raises(ValueError):
        combining.combine([a])


def test_combine_directory_skips_broken_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(2).withColumn("x", F.lit("y")).write.parquet(str(tmp_path / "b.parquet"))
    (tmp_path / "c.parquet").write_text("not parquet")
    got = combining.combine_directory(spark, str(tmp_path))
    assert got.rows.count() == 5 and got.rows.columns == ["id", "x"]
    assert [p.rsplit("/", 1)[-1] for p, _ in got.skipped] == ["c.parquet"] and "FOOTER" in got.skipped[0][1]
    assert combining.combine_directory(spark, str(tmp_path / "none")).rows.isEmpty()


def test_combine_texts_and_lines(spark, tmp_path):
    texts = ["a\nb", "c\n\n", "", "d\r\ne\n"]
    paths = []
    for i, text in enumerate(texts):
        path = tmp_path / f"t{i}.txt"
        path.write_text(text, newline="")
        paths.append(str(path))
    expected = "\n\n".join(t.replace("\r\n", "\n") for t in texts)
    got = combining.combine_texts(spark, paths).orderBy("text_no", "place").collect()
    assert "\n".join(r["line"] for r in got) == expected
    df = spark.createDataFrame([(i, t.replace("\r\n", "\n")) for i, t in enumerate(texts)], "i int, t string")
    got = combining.joined_lines(df, "t", ["i"]).orderBy("text_no", "line_no").collect()
    assert "\n".join(r["line"] for r in got) == expected
    with pytest.raises(ValueError):
        combining.combine_texts(spark, [paths[0], "x.json"])


# --- amplify -----------------------------------------------------------------


@pytest.mark.parametrize("step", [10, 1])
def test_amplify_quotas(spark, monkeypatch, step):
    monkeypatch.setattr(A, "BLOCK", 4)
    seeds = spark.createDataFrame([(step * i, f"s{i}") for i in range(7)], "row_id bigint, s string")
    for total in (0, 3, 7, 17, 70, 71):
        got = A.amplify_total(seeds, total)
        counts = {r["row_id"]: r["count"] for r in got.groupBy("row_id").count().collect()}
        each, rest = divmod(total, 7)
        expected = {step * i: each + (i < rest) for i in range(7)}
        assert counts == {k: v for k, v in expected.items() if v}
        assert got.select("row_id", "sample_no").distinct().count() == total
    assert by(A.amplify(seeds, 2), "row_id", "sample_no")[:3] == [(0, "s0", 1), (0, "s0", 2), (step, "s1", 1)]
    assert A.amplify_total(seeds.limit(0), 5).count() == 0


# --- augment, profile, rendering ----------------------------------------------


def test_augment_by_type(spark):
    df = spark.createDataFrame(
        [(1, "a", 100, 2.0, True), (2, None, None, None, None), (3, "c", 100, 2.0, False)],
        "row_id bigint, s string, q bigint, p double, f boolean",
    )
    got = by(augment(df), "row_id")
    assert got[0][1] == "a (augmented)" and got[0][4] is True
    assert got[1] == (2, None, None, None, None)
    assert 90 <= got[0][2] <= 110 and 1.8 <= got[0][3] <= 2.2 and got[0][2] != got[2][2]
    assert by(augment(df.repartition(3)), "row_id") == got


def test_profile(spark):
    df = spark.createDataFrame([("m", "t", None), ("m", "t", "x")], "generationModel string, task string, o string")
    assert profiling.shape(df) == (2, ["generationModel", "task", "o"])
    assert by(profiling.column_stats(df), "column") == [("generationModel", 2, 2), ("o", 2, 1), ("task", 2, 2)]
    assert by(profiling.provenance(df), "task") == [("m", "t", 2)]


def test_rendered_conversation(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "Q"), (1, 2, "assistant", "A"), (2, 5, "user", "Q2")]
    df = spark.createDataFrame(turns, "c int, t int, r string, x string")
    style = rendering.ChatStyle(header="<{role}>", end="#")
    got = by(rendering.render_turns(df, "c", "t", "r", "x", style), "c", "turn_no")
    assert got == [(1, 0, "<system>S#"), (1, 1, "<user>Q#"), (1, 2, "<assistant>A"), (2, 0, "<user>Q2#<assistant>")]
    long = [(3, i, "user" if i % 2 else "assistant", str(i)) for i in range(1100)]
    pieces = by(rendering.render_turns(spark.createDataFrame(long, df.schema), "c", "t", "r", "x", style), "turn_no")
    listed = spark.createDataFrame([(3, [(r, x) for _, _, r, x in long])], "c int, a array<struct<role:string,text:string>>")
    whole = listed.select(rendering.render_array(F.col("a"), style)).first()[0]
    assert "".join(p for _, _, p in pieces) == whole and whole.endswith("<user>1099#<assistant>")


def test_totals_hold_for_any_ids(spark):
    for ids in ([0, 0, 2], [5, 6, 7], [1, 1, 1], [3, 9]):
        seeds = spark.createDataFrame([(i,) for i in ids], "row_id bigint")
        for total in (1, 4, 7):
            assert A.amplify_total(seeds, total).count() == total


def test_split_records_are_indented_json(spark, tmp_path):
    import json

    df = spark.createDataFrame(
        [("c", "train", 1, 'q"\n', [1, 2], None), ("c", "train", 2, None, [], Row(k="v"))],
        "config string, split string, n int, s string, a array<int>, o struct<k:string>",
    )
    got = rendering.split_records(df, ["config", "split"], keep=["n"])
    rows_ = by(got, "n")
    items = [{"n": 1, "s": 'q"\n', "a": [1, 2], "o": None}, {"n": 2, "s": None, "a": [], "o": {"k": "v"}}]
    assert [r[2] for r in rows_] == [json.dumps(i, ensure_ascii=False, indent=2) for i in items]
    assert rows_[0][0] == "c_train"
    rendering.write_splits(got, str(tmp_path / "o"), ["n"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o" / "config_split=c_train").glob("part*")))
    assert text == "".join(r[2] + "\n\n" for r in rows_)


# --- templates -----------------------------------------------------------------


def test_templates(spark, tmp_path):
    reg = TemplateRegistry()
    assert len(reg.names()) == 23
    assert reg.fields("duo_swarm") == [
        "agent_instruct_one", "input_1", "output_1", "agent_instruct_two", "input_2", "output_2",
    ]
    assert unique_fields(["a", "b"]) == ["a", "b"]
    reg.add("mine", ["a", "b"])
    with pytest.raises(ValueError):
        reg.add("mine", ["c"])
    assert reg.get("nope") is None
    with pytest.raises(ValueError):
        reg.fields("nope")
    reg.save(spark, str(tmp_path / "t.json"))
    again = TemplateRegistry.load(spark, str(tmp_path / "t.json"))
    assert again.names() == reg.names() and again.schema("mine").names == ["a", "b"]
    assert TemplateRegistry.load(spark, str(tmp_path / "none.json")).names()[0] == "chat"
    assert TemplateRegistry({"x": "solo"}).fields("x") == ["solo"]
    assert again.to_df(spark).count() == 24


def test_rendered_parts_are_bounded_and_make_the_whole(spark):
    from seedloom.operators import rendering

    turns = spark.range(1000).selectExpr("1 as c", "id as t", "if(id % 2 = 0, 'user', 'assistant') as r", "concat('text ', id) as x")
    parts = sorted(rendering.render_parts(turns, "c", "t", "r", "x", per_part=64).collect())
    pieces = sorted(rendering.render_turns(turns, "c", "t", "r", "x").collect())
    assert len(parts) == 16 and "".join(p.rendered for p in parts) == "".join(p.piece for p in pieces)


def test_split_names_do_not_collide(spark):
    from seedloom.operators import rendering

    rows = [("a_b", "c"), ("a", "b_c"), (None, "c"), ("a", None), ("", "c"), ("%5F", "c"), ("_", "c"), ("%00", "c"), ("a%5Fb", "c")]
    names = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(rendering.split_name(["x", "y"])).collect()]
    assert len(set(names)) == len(rows) and names[1] == "a_b_c"


def test_whole_conversations_are_one_row(spark, tmp_path):
    from seedloom.operators import rendering
    from seedloom.showcase import render_chat_rows

    turns = spark.range(1000).selectExpr(
        "id % 2 as conv_id", "cast(id as int) as turn", "if(id % 4 < 2, 'user', 'assistant') as role", "concat('text ', id) as text"
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    pieces = sorted(rendering.render_turns(turns, "conv_id", "turn", "role", "text").collect())
    whole = {c: "".join(p.piece for p in pieces if p.conv_id == c) for c in (0, 1)}
    found = render_chat_rows(spark, str(tmp_path))
    assert found.columns == ["conv_id", "rendered"]
    assert sorted(found.collect()) == sorted(whole.items())
    parted = rendering.render_conversations(turns, "conv_id", "turn", "role", "text", per_part=7)
    assert sorted(parted.collect()) == sorted(whole.items())
