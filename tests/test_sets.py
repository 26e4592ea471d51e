"""Near copies, overlap, phrases, catalogs and pages against plain Python."""

import html as python_html
import random

import pytest
from pyspark.sql import functions as F

from seedloom.operators import catalog, pages, patterns, shingles

VOCABULARY = [f"w{n}" for n in range(400)]


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_texts(seed=3, families=25):
    """Families of texts with words changed a few at a time, copies, and strangers."""
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                rows.append("  ".join(words).upper())
    rows += ["", None, " \n", "one two", "One  two", "one two three four five six"]
    return list(enumerate(rows))


def plain_groups(rows, similarity=0.8):
    sets = {i: grams(t) for i, t in rows}
    links, parent = set(), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity)):
                links.add((a, b))
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}, links


def test_near_groups(spark):
    rows = near_texts()
    df = spark.createDataFrame(rows, "row_id bigint, text string").repartition(5)
    got = {r.row_id: r.group_id for r in shingles.near_groups(df, "text").collect()}
    want, links = plain_groups(rows)
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.9 * len(links) and set(got) == set(want)
    # Nothing is joined that is not near over a chain.
    assert all(want[a] == want[b] for a in got for b in [got[a]])
    assert got == want


def test_a_large_group_of_near_copies(spark):
    """Links are few, though all texts of the group meet in the same buckets."""
    base = [f"b{n}" for n in range(200)]
    rows = [(n, " ".join([*base[: n % 190], f"x{n}", *base[n % 190 + 1 :]])) for n in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, text string").repartition(4)
    texts = shingles.texts_once(df, "text")
    links = shingles.near_links(texts)
    assert links.count() < 600 * shingles.BANDS.bands
    assert {r.group_id for r in shingles.near_groups(df, "text").collect()} == {0}


@pytest.mark.parametrize("shape", [shingles.BANDS, shingles.Bands(bands=1, rows=64)])
def test_near_groups_that_bands_do_not_show(spark, monkeypatch, shape):
    """Whatever the signatures miss is found by rare shingles, also across blocks of a bucket."""
    monkeypatch.setattr(shingles, "_BLOCK", 2)
    rng = random.Random(5)
    rows = []
    for _ in range(30):
        base = [rng.choice(VOCABULARY) for _ in range(60)]
        for changes in (0, 2, 3, 4, 5):
            words = list(base)
            for at in rng.sample(range(60), changes):
                words[at] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "row_id bigint, text string").repartition(3)
    want, links = plain_groups(rows, 0.5)
    got = {r.row_id: r.group_id for r in shingles.near_groups(df, "text", similarity=0.5, shape=shape).collect()}
    assert got == want and links


def test_splits_keep_groups_whole(spark):
    rows = near_texts(9)
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    got = shingles.split_by_group(df, "text", {"train": 1, "eval": 1}).collect()
    parts = {r.row_id: r.split for r in got}
    _, links = plain_groups(rows)
    assert all(parts[a] == parts[b] for a, b in links) and set(parts.values()) == {"train", "eval"}
    assert shingles.near_groups(df.limit(0), "text").count() == 0


def test_groups_along_a_chain(spark):
    links = spark.range(40).select(F.format_string("%03d", "id").alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b"))
    found = shingles.groups(links).collect()
    assert len(found) == 41 and {r.root for r in found} == {"000"}


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_overlap_is_exact(spark, least):
    rng = random.Random(11)
    train = [t for _, t in near_texts(21, 15)] + ["common words stand here again"] * 50
    held = []
    for _ in range(60):
        source = (rng.choice(train) or "").split()
        cut = source[rng.randint(0, 5) : rng.randint(5, max(6, len(source)))]
        held.append(" ".join([*cut, *[rng.choice(VOCABULARY) for _ in range(rng.randint(0, 12))]]))
    held += [None, "", "common words stand here again", "never seen before"]
    a = spark.createDataFrame(list(enumerate(held)), "row_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(train, 1000)), "row_id bigint, text string")
    got = {r.row_id: (r.n_shingles, r.overlap, r.n_matches, r.match_id) for r in shingles.overlap(a, b, "text", least=least).collect()}
    for i, t in enumerate(held):
        mine = grams(t)
        parts = [(-len(mine & grams(x)) / len(mine), n) for n, x in enumerate(train, 1000)] if mine else []
        reach = [p for p in parts if -p[0] >= least - 1e-9]
        best = min(reach, default=(None, None))
        assert got[i] == (len(mine), -best[0] if reach else None, len(reach), best[1]), (i, t)


def test_shingles_are_made_once_a_row(spark, tmp_path):
    spark.createDataFrame(near_texts(), "row_id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for made in (shingles.texts_once(df, "text"), shingles.with_text_id(df, "text", ["row_id"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(lower(") == 1


@pytest.mark.parametrize("words", [1, 2, 3, 5, 8])
def test_shingles_differ_where_the_words_do(spark, words):
    rows = near_texts(seed=words)
    df = spark.createDataFrame(rows, "row_id long, text string").select("row_id", shingles.shingle_hashes(F.col("text"), words).alias("s"))
    hashes = {r.row_id: r.s for r in df.collect()}
    assert {i: len(s) for i, s in hashes.items()} == {i: len(grams(t, words)) for i, t in rows}
    assert len(set().union(*hashes.values())) == len(set().union(*(grams(t, words) for _, t in rows)))
    assert all(s == sorted(s) for s in hashes.values())


def test_overlap_keeps_only_shingles_asked_for(spark):
    from pathlib import Path

    from seedloom.sources.staging import staging_folder

    before = set(Path(staging_folder(spark)).glob("known-*"))
    df = spark.createDataFrame([(0, "a b c d e f g h i j")], "row_id long, text string")
    other = spark.range(50).selectExpr("id as row_id", "if(id = 7, 'a b c d e f g h i j k', concat_ws(' ', transform(sequence(0, 30), x -> concat(id, '-', x)))) as text")
    assert [r.match_id for r in shingles.overlap(df, other, "text").collect()] == [7]
    (staged,) = set(Path(staging_folder(spark)).glob("known-*")) - before
    assert spark.read.parquet(str(staged)).count() == 6


def test_overlap_shuffles_only_what_may_be_asked_for(spark, tmp_path):
    """Shingles that are not asked for and further copies of a text stay in their tasks, but for a few."""
    rows = [(n, " ".join(f"{n % 400}-{k}" for k in range(30))) for n in range(500)]
    df = spark.createDataFrame([*rows, (500, None), (501, " ")], "row_id long, text string").repartition(5)
    shingles._told(df, "row_id", "text", 5).write.parquet(f"{tmp_path}/told")
    texts, copies = shingles._told_once(spark.read.parquet(f"{tmp_path}/told"))
    assert {r.first: (r.copies, r.n) for r in copies.collect()} == {n: (1 + (n < 100), 26) for n in range(400)}
    assert {r.num for r in copies.collect()} <= {r.num for r in texts.collect()} and texts.count() < 450
    asked = df.filter("row_id in (3, 7)").select(F.explode(shingles.shingle_hashes(F.col("text"))).alias("h"))
    found = shingles._postings(texts.select(F.col("num").alias("t"), F.col("shingles").alias("st")), shingles.sieve(asked, 52))
    hashes = [r.h for r in found.collect()]
    assert {r.h for r in asked.collect()} <= set(hashes) and len(hashes) < 26 * 40


def test_phrases(spark):
    rows = [(1, "You are a Bad, bad person."), (2, "a badly made thing"), (3, None), (4, ""), (5, "BAD person of the year"), (6, "person bad"), (7, "x " * 5000 + "so it ends")]
    phrases = [("bad person", "insult"), ("Bad  Person!", "insult"), ("person", "word"), ("so it ends", "end"), ("", "none"), (None, "none"), ("unknown bad", "none")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("*", "'x' as phrase", "'y' as reason", "1 as w")
    table = spark.createDataFrame(phrases, "phrase string, reason string")
    got = {r.row_id: (r.n_phrases, r.reasons) for r in patterns.match_phrases(df, "text", table).collect()}
    assert got == {1: (2, ["insult", "word"]), 5: (2, ["insult", "word"]), 6: (1, ["word"]), 7: (1, ["end"])}
    assert patterns.match_phrases(df, "text", table.limit(0)).count() == 0 and patterns.match_phrases(df.limit(0), "text", table).count() == 0


def test_phrases_of_common_words_meet_only_their_rows(spark):
    from pathlib import Path

    from seedloom.sources.staging import staging_folder

    n = 40
    rows = [(i, " ".join([*(f"x{j} y" for j in range(n)), f"z x{i} x{i} x{i}"])) for i in range(n)]
    phrases = [(f"x{i} x{i}", "two") for i in range(n)] + [(f"Z x{i} x{i}", "three") for i in range(n)] + [(f"y x{i} x0", "none") for i in range(n)]
    before = set(Path(staging_folder(spark)).glob("phrase-candidates-*"))
    df, table = spark.createDataFrame(rows, "row_id bigint, text string"), spark.createDataFrame(phrases, "phrase string, reason string")
    got = {r.row_id: (r.n_phrases, r.reasons) for r in patterns.match_phrases(df, "text", table).collect()}
    assert got == {i: (2, ["three", "two"]) for i in range(n)}
    (staged,) = set(Path(staging_folder(spark)).glob("phrase-candidates-*")) - before
    assert spark.read.parquet(str(staged)).agg(F.sum(F.size("__p"))).first()[0] <= 3 * n


def test_telling_phrases(spark):
    rows = [("you fool you", True), ("you fool", True), ("fool you are", False), ("you fool", None), (None, True)]
    df = spark.createDataFrame(rows, "text string, bad boolean")
    assert [r.phrase for r in patterns.telling_phrases(df, "text", F.col("bad")).collect()] == ["you fool"]


@pytest.fixture
def commands(spark):
    listed = spark.createDataFrame([("voice.swap", "Swaps {command} the voice."), ("list.all", None)], "command string, description string")
    parameters = spark.createDataFrame([("voice.swap", "voice", "choice"), ("voice.swap", "speed", "integer"), ("list.all", "note", "text")], "command string, parameter string, kind string")
    choices = spark.createDataFrame([("voice.swap", "voice", "C3PO"), ("voice.swap", "voice", "K9")], "command string, parameter string, value string")
    return listed, parameters, choices


def test_catalog_rows(commands):
    listed, _, choices = commands
    rows = catalog.describe(listed, [catalog.Phrasing("What is {command} {x}?", "{description}|{command}")]).collect()
    assert {(r.input, r.output) for r in rows} == {
        ("What is voice.swap {x}?", "Swaps {command} the voice.|voice.swap"), ("What is list.all {x}?", "|list.all"),
    }
    made = catalog.intents(choices, ["talk like {value}", "{value}!"])
    assert made.count() == 4
    back = catalog.command_blocks(made.withColumn("row_id", F.monotonically_increasing_id()), "output", *commands)
    assert back.rejects.isEmpty() and sorted(r.arguments["voice"] for r in back.rows.collect()) == ["C3PO", "C3PO", "K9", "K9"]


def test_listing_and_validity(spark, commands):
    many = spark.range(25).select(F.format_string("c%02d", "id").alias("command"))
    parts = sorted(catalog.listing(many.union(many), per_part=10).collect())
    assert [len(p.text.split("\n")) for p in parts] == [10, 10, 5] and "\n".join(p.text for p in parts) == "\n".join(f"c{n:02d}" for n in range(25))
    asked = spark.createDataFrame([(" /Voice.Swap ",), ("chat.off",), (None,), ("list.all",)], "command string")
    got = {r.command: (r.valid, r.answer) for r in catalog.validity(asked, commands[0], "Yes, {command}.", "No {command}").collect()}
    assert got == {" /Voice.Swap ": (True, "Yes,  /Voice.Swap ."), "chat.off": (False, "No chat.off"), None: (False, "No "), "list.all": (True, "Yes, list.all.")}


def test_command_blocks(spark, commands):
    def block(inside):
        return f"ok <runCommand>\n{inside}\n</runCommand> done"

    rows = [
        block('{"command": "voice.swap", "arguments": {"voice": "K9", "speed": 3}}'),
        block('{"command": "voice.swap", "arguments": {"voice": "R2", "speed": "fast", "pitch": 1}}'),
        block('{"command": "list.all"}') + block('{"command": "nope", "arguments": {}}'),
        block('{"arguments": {}}') + block("{command}") + block("[1]"),
        block('{"command": "list.all", "arguments": [1]}'),
        block('{"command": "list.all", "arguments": {"note": {"a": [1, "x"]}}}'),
        "<runCommand>{", None, "",
        block('{"command": "voice.swap", "arguments": {"speed": null}}'),
        block('{"command": "list.all", "arguments": null}'),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id bigint, text string")
    done = catalog.command_blocks(df, "text", *commands)
    good = {(r.row_id, r.block): (r.command, r.arguments) for r in done.rows.collect()}
    assert good == {
        (0, 0): ("voice.swap", {"voice": "K9", "speed": "3"}), (2, 0): ("list.all", {}), (5, 0): ("list.all", {"note": '{"a":[1,"x"]}'}),
        (10, 0): ("list.all", {}),
    }
    bad = sorted((r.row_id, r.block, r.parameter, r.reason) for r in done.rejects.collect() if r.block is not None and r.parameter)
    assert bad == [(1, 0, "pitch", "unknown parameter"), (1, 0, "speed", "not an integer"), (1, 0, "voice", "not a choice"), (9, 0, "speed", "not an integer")]
    whole = sorted((r.row_id, r.block, r.reason) for r in done.rejects.collect() if r.block is not None and not r.parameter)
    assert whole == [(2, 1, "unknown command"), (3, 0, "no command"), (3, 1, "not json"), (3, 2, "no command"), (4, 0, "arguments")]
    assert [r.row_id for r in done.rejects.filter("reason = 'unclosed'").collect()] == [6]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (None, []), ("", []), ("a<p>b<p>c", ["a", "b", "c"]), ("<script>x</script>y<style>z", ["y"]), ("<!-- a --> b <!-- c", ["b"]),
        ("<ul><li><a href=x>link</a><li>text <a>l</a></ul>", ["text l"]), ("&lt;p&gt; &amp;amp; &#65;&#x42; &nope; &#xD800; &", ["<p> &amp; AB &nope; � &"]),
        ("1 < 2<br>3 > 2", ["1 < 2", "3 > 2"]), ("<HEAD><title>t</title></HEAD><body>x&nbsp; y</body>", ["x y"]), ("<pre>a\n b</pre>", ["a b"]),
        ("a<b>b</b>c<paragraph>d", ["abcd"]), ("<p>a</p", ["a</p"]),
    ],
)
def test_page_lines(spark, page, lines):
    got = spark.createDataFrame([(page,)], "html string").select(pages.page_lines(F.col("html"))).first()[0]
    assert got == lines


def test_references_and_long_pages(spark):
    text = "&eacute;&copy;&sum;&#128512;&quot; and & more; &#0; &amp;lt;"
    got = spark.createDataFrame([(text,)], "t string").select(pages.decoded(F.col("t"))).first()[0]
    assert got == python_html.unescape(text)
    long = "<p>words of a line</p>" * 50_000 + "<p>" + "<b>" * 50_000 + "end"
    rows = pages.page_text(spark.createDataFrame([(1, long)], "id bigint, html string")).first()
    assert rows.content.count("\n") == 50_000 and rows.content.endswith("end")
