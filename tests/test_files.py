import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seedloom.plans import reshape
from seedloom.plans.text_to_dataset import convert_tagged_files
from seedloom.sources import readers, writers, zones
from seedloom.sources.staging import staging_folder
from seedloom.streaming import arrivals

MESSY = [(0, 'q"uo,te', "two\nlines"), (1, "", None), (2, "back\\slash", " pad ")]


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(MESSY, "n int, a string, b string")


def test_csv_and_json_lines(spark, messy, tmp_path):
    import csv

    written = writers.export(messy.coalesce(1), str(tmp_path / "out"), ["csv", "jsonl", "xml"])
    assert [p.rsplit(".", 1)[1] for p in written] == ["csv", "jsonl"]
    with open(next((tmp_path / "out.csv").glob("part*")), newline="") as f:
        assert list(csv.reader(f)) == [["n", "a", "b"], *[[str(n), a, b or ""] for n, a, b in MESSY]]
    lines = next((tmp_path / "out.jsonl").glob("part*")).read_text().splitlines()
    assert [json.loads(line) for line in lines] == [{"n": n, "a": a, "b": b} for n, a, b in MESSY]


def test_json_array_keeps_schema_order(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"z": "1", "a": "2"}, {"z": "3", "a": None}], indent=2))
    got = readers.read_json_records(spark, str(path), "z string, a string")
    assert [tuple(r) for r in got.collect()] == [("1", "2"), ("3", None)]


def test_tab_separated(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text(' a\tb\tc \n1\t"q\t3\n x\t\ty\nshort\n')
    got = readers.read_tab_separated(spark, str(path))
    assert [tuple(r) for r in got.collect()] == [("1", '"q', "3"), ("x", "", "y"), ("short", None, None)]
    path.write_text("a\n1\t2\n")
    with pytest.raises(Exception, match="more cells"):
        readers.read_tab_separated(spark, str(path)).collect()


def test_read_any_falls_back(spark, tmp_path):
    base = tmp_path / "d"
    (tmp_path / "d.txt").write_text("a\tb\n1\t2\n")
    assert readers.read_any(spark, f"{base}.parquet").columns == ["a", "b"]
    (tmp_path / "d.json").write_text('[{"j": 1}]')
    assert readers.read_any(spark, f"{base}.parquet").columns == ["j"]
    (tmp_path / "d.parquet").write_text("broken")
    assert readers.read_any(spark, f"{base}.parquet").columns == ["j"]
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "none.parquet"))


def test_documents_have_plain_newlines(spark, tmp_path):
    (tmp_path / "x.tex").write_bytes(b"a\r\nb\rc\n")
    assert readers.read_documents(spark, str(tmp_path / "x.tex")).first()["content"] == "a\nb\nc\n"


def test_zones(spark, tmp_path):
    z = zones.Zones(str(tmp_path))
    with pytest.raises(ValueError):
        z.path("elsewhere")
    spark.range(2).write.parquet(z.path("ingredients", "old.parquet"))
    time.sleep(1.1)
    spark.range(3).write.parquet(z.path("dishes", "new.parquet"))
    time.sleep(1.1)
    (tmp_path / "ingredients" / "note.json").write_text("[]")
    (tmp_path / "ingredients" / "skip.bin").write_text("x")
    listed = {(r["zone"], r["dataset"]) for r in z.datasets(spark).collect()}
    assert listed == {("ingredients", "old.parquet"), ("dishes", "new.parquet"), ("ingredients", "note.json")}
    seeds = [r["dataset"] for r in readers.list_seeds(spark, z.path("ingredients")).collect()]
    assert seeds == ["note.json", "old.parquet"]
    assert z.locate(spark, "new.parquet") == z.path("dishes", "new.parquet")
    with pytest.raises(FileNotFoundError):
        z.locate(spark, "edits/new.parquet")


def test_names():
    assert zones.synthetic_name("a.parquet", 7) == "a_synthetic_7.parquet"
    assert zones.sliced_name("x/a.parquet") == "a_sliced.parquet"
    assert zones.edited_name("a.b.parquet") == "a.b_edited.parquet"
    assert zones.paraphrased_name("a.txt", 1) == "a_paraphrased_1.txt"
    assert zones.combined_name(["a.txt", "b.txt"]) == "a_b.txt"
    with pytest.raises(ValueError):
        zones.combined_name(["a.txt", "b.json"])


def test_reshape_plans(spark, tmp_path):
    z = zones.Zones(str(tmp_path))
    for name, k in (("a", 1), ("b", 2)):
        spark.createDataFrame([(0, k, "v")], "row_id bigint, k int, out string").write.parquet(
            z.path("ingredients", f"{name}.parquet")
        )
    assert reshape.slice_dataset(spark, z, "a.parquet", ["out", "x"]) == ["out"]
    assert spark.read.parquet(z.path("edits", "a_sliced.parquet")).columns == ["row_id", "k"]
    edits = spark.createDataFrame([(0, 0, "out", "new")], "edit_no int, row_id bigint, column string, value string")
    saved = reshape.save_edits(spark, z, "a.parquet", edits)
    assert spark.read.parquet(saved).first() == Row(row_id=0, k=1, out="new")
    both = reshape.combine_datasets(spark, z, ["a.parquet", "b.parquet"])
    assert both == z.path("salad", "a_b.parquet") and spark.read.parquet(both).count() == 2
    for name in ("s", "t"):
        (tmp_path / "ingredients" / f"{name}.txt").write_text(f"{name}1\n{name}2")
        (tmp_path / "ingredients" / f"{name}.json").write_text(json.dumps([{name: 1}]))
    text = reshape.combine_datasets(spark, z, ["s.txt", "t.txt"])
    lines = "".join(p.read_text() for p in sorted(tmp_path.glob("salad/s_t.txt/part*")))
    assert text.endswith("s_t.txt") and lines == "s1\ns2\n\nt1\nt2\n"
    records = reshape.combine_datasets(spark, z, ["s.json", "t.json"])
    assert spark.read.json(records).count() == 2
    assert spark.read.parquet(reshape.json_to_parquet(spark, z, "s.json")).columns == ["s"]


def test_tagged_round_trip_and_conversion(spark, messy, tmp_path):
    path = str(tmp_path / "in.txt")
    writers.write_tagged(messy, path, order_by=["n"], escape=True, null_text="")
    table = convert_tagged_files(spark, path, ["a", "b"], str(tmp_path / "set"))
    assert table.columns == ["a", "b"] and table.count() == 3
    parsed = spark.read.json(str(tmp_path / "set.json"))
    assert parsed.count() == 3
    from seedloom.operators.parsing import parse_tagged_files

    back = parse_tagged_files(spark, path, ["a", "b"], strip=False, escaped=True)
    assert sorted(map(tuple, back.select("a", "b").collect())) == sorted((a, b or "") for _, a, b in MESSY)


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text('$("a")\r\n$("b")$("c")')
    rows = arrivals.arriving_rows(spark, str(folder), ["x", "y"])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    arrivals.append_to(rows, out, mark).awaitTermination()
    (folder / "2.txt").write_text('$("d")$("e")')
    arrivals.append_to(rows, out, mark).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("x", "y").collect())
    assert got == [("a", "b"), ("c", ""), ("d", "e")]


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_folder(Session(spark_master="yarn"))
    assert staging_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


def test_parquet_cast(spark, messy, tmp_path):
    schema = messy.select(F.col("n").cast("string").alias("n"), "b").schema
    writers.write_parquet(messy, str(tmp_path / "p"), schema)
    assert spark.read.parquet(str(tmp_path / "p")).dtypes == [("n", "string"), ("b", "string")]


def test_tab_separated_keeps_everything(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("x\ty\none\x01two\tb\n\n  c\td  \n")
    (tmp_path / "t" / "b.tsv").write_text("x\ty\n1\t2\n")
    got = sorted(map(tuple, readers.read_tab_separated(spark, str(tmp_path / "t")).collect()))
    assert got == [("", None), ("1", "2"), ("c", "d"), ("one\x01two", "b")]
    (tmp_path / "t" / "c.tsv").write_text("y\tx\n1\t2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_tab_separated(spark, str(tmp_path / "t"))


def test_arriving_responses_lose_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "request_id string, content string, question boolean"
    rows = [("a", " Error: off", False), ("b", "fine", False), ("c", None, False)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"), mode="overwrite")
    both = arrivals.cleaned_responses(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "question")
    for name, frame in both._asdict().items():
        arrivals.append_to(frame, str(tmp_path / name), str(tmp_path / f"mark-{name}")).awaitTermination()
    got = {n: sorted(r.request_id for r in spark.read.parquet(str(tmp_path / n)).collect()) for n in both._fields}
    assert got == {"rows": ["b"], "rejects": ["a", "c"]}


def test_whole_files_of_documents_stay_small(spark, tmp_path):
    """A file is read as one row, however many documents a task writes."""
    from pathlib import Path

    from seedloom.showcase import text_documents

    text = F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.lit("a\r\nb "), F.col("id")))
    spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(staging_folder(spark)).glob("documents-*"))
    rows = {r.doc_id: r.content for r in text_documents(spark, str(tmp_path)).collect()}
    assert rows == {i: "" if i % 9 == 0 else f"a\nb {i}" for i in range(3000)}
    (written,) = set(Path(staging_folder(spark)).glob("documents-*")) - before
    assert max(p.read_bytes().count(b"\x1e") for p in written.glob("part-*")) <= 250
