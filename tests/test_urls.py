from pyspark.sql import functions as F

from seedloom.functions import urls as U

CASES = [
    # source, kind, output name
    ("https://en.wikipedia.org/wiki/Caf%C3%A9_au_lait", "wikipedia", "Café au lait_extracted.txt"),
    ("en.wikipedia.org/wiki/A+B_100%", "wikipedia", "A+B 100%_extracted.txt"),
    ("https://arxiv.org/abs/1234.5678v2/", "arxiv", "arxiv_1234.5678v2_extracted.txt"),
    ("https://huggingface.co/datasets/own/set/", "hub_dataset", "own_set_extracted.txt"),
    ("https://huggingface.co/own/model", "hub_repo", "model_extracted.txt"),
    ("https://github.com/Own/Repo/tree/Dev/src", "github", "own_repo_dev_extracted.txt"),
    ("https://github.com/own/repo", "github", "own_repo_main_extracted.txt"),
    ("https://site.example/a/b.html?q=1#x", "web", "b.html_extracted.txt"),
    ("https://site.example/", "web", "webpage_extracted.txt"),
    ("site.example/p;v=1", "web", "p_extracted.txt"),
    ("notes.v2.txt", "file", "notes.v2_extracted.txt"),
    ("", "file", "_extracted.txt"),
    (None, None, None),
]


def test_kind_and_name(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, u string")
    rows = df.select(
        "i", U.url_kind(F.col("u")).alias("kind"), U.extracted_name(F.col("u")).alias("name")
    ).orderBy("i").collect()
    assert [(r["kind"], r["name"]) for r in rows] == [(c[1], c[2]) for c in CASES]


def test_parts(spark):
    url = F.col("u")

    def one(value, expression):
        return spark.createDataFrame([(value,)], "u string").select(expression).first()[0]

    assert one("https://github.com/Own/Repo/tree/Dev/x", U.github_repo(url)) == "own/repo"
    assert one("https://github.com/Own/Repo/tree/Dev/x", U.github_branch(url)) == "dev"
    assert one("https://github.com/own", U.github_repo(url)) is None
    assert one("https://huggingface.co/a/b/", U.hub_repo(url)) == "a/b"
    assert one("https://x.example/", U.hub_repo(url)) == ""
    assert one("https://huggingface.co/datasets/A/b/", U.hub_dataset(url)) == "A/b"
