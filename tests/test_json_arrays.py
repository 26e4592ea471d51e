"""Array files cut into many splits, against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seedloom.sources import json_arrays, writers
from seedloom.sources.json_arrays import read_json_array

SCHEMA = "id bigint, text string, tags array<string>, inner struct<a: string, n: array<int>>"
NASTY = ["", '"', "\\", '\\"', '\\\\"', "[", "]}", "{,", ',"', "a,b", "é😀\n\t", '"],[{"', "\\\\", " ", "x" * 3000, '{"id": 1}']


def records(count, seed=1):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))

    made = []
    for n in range(count):
        r = {"id": n, "text": rng.choice([None, text()]), "tags": [text() for _ in range(rng.randint(0, 3))]}
        if rng.random() < 0.7:
            r["inner"] = {"a": text(), "n": [rng.randint(0, 9) for _ in range(rng.randint(0, 5))]}
        if rng.random() < 0.1:
            r = {}
        made.append(r)
    return made


def plain(rows):
    return sorted(json.dumps([r.get("id"), r.get("text"), r.get("tags"), r.get("inner")], sort_keys=True) for r in rows)


@pytest.fixture
def small_splits(spark):
    wanted = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_many_splits_of_one_array(spark, tmp_path, small_splits, indent):
    for n, count in enumerate((120, 0, 1)):
        text = json.dumps(records(count, n), indent=indent, ensure_ascii=n == 1)
        (tmp_path / f"{n}.json").write_text(" \n" * n + text + "\n" * n, encoding="utf-8")
    read = spark.read.option("lineSep", '"').text(str(tmp_path))
    assert read.select(F.col("_metadata.file_block_start")).distinct().count() > 20
    got = [r.asDict(True) for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()]
    want = [r for n, count in enumerate((120, 0, 1)) for r in records(count, n)]
    assert plain(got) == plain(want)


def test_written_parts_are_one_array(spark, tmp_path, small_splits):
    rows = records(200, 5)
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    df = df.withColumn("place", F.coalesce("id", F.lit(-1)))
    target = str(tmp_path / "out.json")
    writers.write_json_array(df.repartition(7), target, order_by=["place"])
    parts = sorted((tmp_path / "out.json").glob("part-*"))
    parsed = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert len(parts) > 1 and [r["id"] for r in parsed if r["id"] is not None] == sorted(r["id"] for r in rows if r)
    assert plain(parsed) == plain(rows)
    got = [r.asDict(True) for r in read_json_array(spark, target, SCHEMA, parts=True).collect()]
    assert plain(got) == plain(rows)
    writers.write_json_array(df.limit(0), str(tmp_path / "none.json"), order_by=["place"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none.json").glob("part-*"))) == []


def test_text_is_written_once(spark, tmp_path, small_splits):
    from pathlib import Path

    from seedloom.sources.staging import staging_folder

    before = set(Path(staging_folder(spark)).glob("json-*"))
    rows = [{"id": n, "text": f"marker, {n} [", "tags": []} for n in range(200)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    assert read_json_array(spark, str(tmp_path), SCHEMA).filter("text rlike '^marker'").count() == 200
    holding = []
    for path in set(Path(staging_folder(spark)).glob("json-*")) - before:
        staged = spark.read.parquet(str(path))
        texts = [c for c, kind in staged.dtypes if kind == "string" and c != "file"]
        if texts and not staged.filter(F.concat_ws("", *texts).contains("marker")).isEmpty():
            holding.append(path.name)
    assert len(holding) == 1


@pytest.mark.parametrize("parts", [False, True])
def test_short_stretches_and_many_tasks(spark, tmp_path, small_splits, monkeypatch, parts):
    """Stretches of two pieces, in splits of many; repeated and empty records, nulls, blank ends of files."""
    monkeypatch.setattr(json_arrays, "_STRETCH_BITS", 1)
    monkeypatch.setattr(json_arrays, "_TASK_BYTES", 8000)
    rows = [*records(20, 3), *records(10, 3), {}, {"id": None, "text": None}]
    if parts:
        lines = [f"{json.dumps(r, ensure_ascii=False)},\n" for r in rows]
        lines = ["[" + lines[0], *lines[1:-1], lines[-1].replace(",\n", "]\n")]
        for n in range(4):
            (tmp_path / f"part-{n:05}").write_text("".join(lines[n * len(rows) // 4 : (n + 1) * len(rows) // 4]), encoding="utf-8")
    else:
        for n in range(3):
            (tmp_path / f"{n}.json").write_text(json.dumps(rows[n::3], indent=n) + " \n" * n, encoding="utf-8")
        (tmp_path / "none.json").write_text(" [\n] ")
    got = [r.asDict(True) for r in read_json_array(spark, str(tmp_path), SCHEMA, parts=parts).collect()]
    assert plain(got) == plain(rows)


def test_tasks_hold_stretches_without_paths(spark, tmp_path, monkeypatch, capsys):
    rows = [{"id": n, "text": f"{n:2000}", "tags": []} for n in range(100)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    pieces, tasks = json_arrays._pieces(spark, str(tmp_path), False)
    # Neither the path of a file nor that of its split is repeated with each piece.
    assert [c for c, kind in pieces.dtypes if kind not in ("bigint", "int")] == ["piece", "mark"]
    assert tasks == 1
    monkeypatch.setattr(json_arrays, "_TASK_BYTES", 50_000)
    assert json_arrays._pieces(spark, str(tmp_path), False)[1] > 4
    read_json_array(spark, str(tmp_path), SCHEMA).explain()
    plan = capsys.readouterr().out
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("[file#" in line and "stretch#" in line for line in windows)
    # The tasks for text are as many as its size asks for, and lists are made where a record is whole.
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("collect_list") == plan.count("ObjectHashAggregate") == 2


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": "x}]', '{"id": 1}', "", '[{"id": 1}]]', '"a"'])
def test_broken_arrays_are_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text or " ")
    with pytest.raises(ValueError, match="whole JSON"):
        read_json_array(spark, str(tmp_path), SCHEMA)
