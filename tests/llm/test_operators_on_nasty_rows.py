"""Every operator over nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import fixtures  # noqa: E402
import specs  # noqa: E402

import corpus_pipeline  # noqa: E402
from seedloom.llm import (  # noqa: E402
    chat,
    contamination,
    licenses,
    mixing,
    pii,
    quality,
    repeats,
    simhash,
    toxicity,
    urls,
)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ids_and_texts():
    return [r[:2] for r in fixtures.nasty_rows()]


def sort(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("extra", [False, True])
def test_simhash(spark, extra):
    rows = ids_and_texts()
    got = rows_of(simhash.components_of(fixtures.nasty(spark, extra)))
    prints = [specs.simhash(t) for _, t in rows]
    roots = specs.components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    first = {}
    for n, (i, _) in enumerate(rows):
        known = first.get(roots[n])
        first[roots[n]] = i if known is None else known if i is None else min(known, i)
    want = [(i, f"{prints[n]:016x}", first[roots[n]]) for n, (i, _) in enumerate(rows)]
    assert sort(got) == sort(want)
    kept = simhash.drop_near_duplicates(fixtures.nasty(spark, extra))
    assert kept.columns == fixtures.nasty(spark, extra).columns
    assert sort(r.doc_id for r in kept.collect()) == sort(first.values())


@pytest.mark.parametrize("length,together", [(64, 20_000), (64, 1), (400, 20_000)])
def test_repeats(spark, length, together):
    got = rows_of(repeats.remove_repeats(fixtures.nasty(spark, True), length, together=together))
    assert sort(got) == sort(specs.removed(ids_and_texts(), length))


@pytest.mark.parametrize("extra", [False, True])
def test_pii(spark, extra):
    got = {}
    for r in pii.pii_report(fixtures.nasty(spark, extra)).collect():
        got.setdefault(r.doc_id, []).append(r)
    import hashlib

    for i, text in ids_and_texts():
        want = specs.base_spans(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        same = [r for r in got[i] if r.base_sha256 == digest]
        assert same, (i, want, got[i])
        counts = Counter(k for k, _, _ in want)
        assert (same[0].n_email, same[0].n_ip, same[0].n_card, same[0].n_phone) == tuple(counts[k] for k in specs.PII)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(same[0].spans.split(",")) or not want
    done = pii.redact(fixtures.nasty(spark, extra))
    assert done.columns == fixtures.nasty(spark, extra).columns and done.count() == len(ids_and_texts())
    text = done.filter("doc_id = 17").first().text
    assert text == "call [PHONE] or mail [EMAIL], card [CARD], host [IP]"


def test_contamination_by_shuffled_hashes(spark):
    """More windows than are broadcast, and a text of 100,000 words."""
    passage = fixtures.prose(2, 80)
    rows = [*ids_and_texts(), (500, f"{fixtures.prose(77, 60_000)} {passage} {fixtures.prose(78, 40_000)}"), (501, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [tuple(r) for r in fixtures.benchmark(spark).collect()]
    got = contamination.contamination(docs, fixtures.benchmark(spark), few=0).drop("text_hash")
    assert sort(rows_of(got)) == sort(specs.contamination(rows, items))


@pytest.mark.parametrize("window", [1, 2, 3, 8, 16])
def test_windows_of_any_length(spark, window):
    items = [tuple(r) for r in fixtures.benchmark(spark).collect()]
    got = contamination.hits(fixtures.nasty(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]), ["doc_id"], fixtures.benchmark(spark), window)
    grams = {}
    for _, t in items:
        w = specs.item_words(t)
        n = min(window, len(w))
        grams.update({tuple(w[k : k + n]): n for k in range(len(w) - n + 1 if w else 0)})
    texts = {i: t for i, t in ids_and_texts() if i is not None}
    want = {
        (i, k, n) for i, t in texts.items() for n in set(grams.values()) for w in [specs.item_words(t)]
        for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams
    }
    assert {(r.doc_id, r["__i"], r["__n"]) for r in got.collect()} == want


def test_words_of_any_character(spark):
    texts = ["".join(f"{chr(c)}a{chr(c)}{chr(c)}B" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in [*range(0, 0x3100, 64), 0xD7C0, 0xFFC0, 0x1F600]]
    texts += ["", None, " ", "a", "-a-", "\x00a\x7fb"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {r.n: r.w for r in df.select("n", contamination._words(contamination.ascii_lower(F.col("text"))).alias("w")).collect()}
    assert got == {n: specs.item_words(t) for n, t in enumerate(texts)}
    # Ranges in the class are tried one by one at every character.
    assert "-" not in contamination._WORD


@pytest.mark.parametrize("few", [0, contamination.FEW_WINDOWS])
def test_windows_of_items_and_texts_of_few_words(spark, few):
    """Null and repeated ids, texts of fewer words than some items or none, items of one to thirteen words."""
    words = fixtures.prose(5, 30).split()
    items = [(n, " ".join(words[:n])) for n in (1, 2, 5, 12, 13, 20)] + [(None, " ".join(words[3:9])), (7, None), (8, " -- ")]
    texts = [" ".join(words), " ".join(words[:4]), words[0], "", None, "-", "x " * 40, " ".join(words[2:]).upper()]
    rows = [(i, t) for i in (1, 1, None) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contamination(docs, benchmark, few=few).drop("text_hash")
    assert sort(rows_of(got)) == sort(specs.contamination(rows, [("" if i is None else i, t) for i, t in items]))


def test_windows_are_rows_of_one_list_of_hashes(spark, capsys):
    docs = fixtures.nasty(spark).select("doc_id", "text")
    contamination._windows(docs, ["doc_id"], [2, 13]).explain()
    plan = capsys.readouterr().out
    # A text is cut and its words are hashed once, whatever the number of lengths.
    assert plan.count("regexp_extract_all(") == 1 and plan.count("transform(") == 1 and plan.count("Generate explode") == 2


@pytest.mark.parametrize("extra", [False, True])
def test_contamination(spark, extra):
    items = [tuple(r) for r in fixtures.benchmark(spark).collect()]
    want = specs.contamination(ids_and_texts(), items)
    docs = fixtures.nasty(spark, extra)
    assert sort(rows_of(contamination.contamination(docs, fixtures.benchmark(spark)).drop("text_hash"))) == sort(want)
    kept = contamination.remove_contaminated(docs, fixtures.benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    none = contamination.contamination(docs, fixtures.benchmark(spark).limit(0)).collect()
    assert len(none) == len(want) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("least", [1, 5])
def test_quality(spark, extra, least):
    rules = quality.RULES._replace(least_rows=least)
    data = fixtures.nasty_rows()
    kept = specs.quality_kept([(t, lang, src) for _, t, lang, src, _ in data], rules)
    want = [(r[0], *specs.quality_counts(r[1]), k) for r, k in zip(data, kept, strict=True)]
    docs = fixtures.nasty(spark, extra)
    assert sort(rows_of(quality.quality_report(docs, rules))) == sort(want)
    good = quality.keep_good(docs, rules)
    assert good.columns == docs.columns and good.count() == sum(kept)


@pytest.mark.parametrize("extra", [False, True])
def test_mixing_keeps_everything(spark, extra):
    docs = fixtures.nasty(spark, extra)
    got = mixing.mix(docs, settings=mixing.SETTINGS._replace(block=3, bucket_rows=2))
    rows = got.collect()
    assert sort((r.doc_id, r.text) for r in rows) == sort(ids_and_texts())
    assert len({(r.slot, r.place) for r in rows}) == len(rows)


def test_toxicity(spark):
    labels = spark.createDataFrame(
        [(n, n % 3, int(n in (21, 103))) for n in [*range(22), *range(100, 112)]] + [(None, 1, 1), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
    for docs in (fixtures.nasty(spark), fixtures.nasty(spark, True)):
        rows = toxicity.score(docs, labels).collect()
        assert sort(r.doc_id for r in rows) == sort(i for i, _ in ids_and_texts())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    unlabelled = toxicity.score(fixtures.nasty(spark), labels.limit(0)).collect()
    best = max(unlabelled, key=lambda r: r.score)
    assert best.doc_id == 21


def test_licenses(spark):
    docs = spark.createDataFrame(
        [
            (1, "a/LICENSE", "Released under the MIT License."),
            (2, "a/b/c/x.txt", "nothing"),
            (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0. And more words follow here."),
            (4, "a/y.txt", "Some words.\nLicensed under the Apache License, Version 2.0."),
            (5, "z/y.txt", None),
            (6, None, "Released under the MIT License."),
            (7, "a/b/c/x.txt", "nothing"),
            (7, "a/b/c/x.txt", "nothing"),
            (None, "", "no license here at all"),
        ],
        "doc_id long, path string, text string",
    )
    got = {(r.doc_id, r.path): (r.own_license, r.license, r.inherited_from) for r in licenses.scan(docs).collect()}
    assert got[(1, "a/LICENSE")] == ("MIT", "MIT", None)
    assert got[(2, "a/b/c/x.txt")] == (None, "CC-BY-NC-4.0", "a/b")
    assert got[(4, "a/y.txt")] == ("Apache-2.0", "Apache-2.0", None)
    assert got[(5, "z/y.txt")] == (None, None, None) and got[(6, None)][0] == "MIT"
    assert got[(None, "")] == (None, None, None)
    assert licenses.scan(docs).count() == 9 and licenses.scan(docs.limit(0)).count() == 0


def test_urls(spark):
    day = "date'2024-03-01'"
    pages = spark.createDataFrame(
        [(1, "http://a.b.com/x/y?q"), (2, "https://u@B.com:80/"), (3, None), (4, ""), (5, "nonsense"), (1, "http://a.b.com/x/y?q")],
        "page_id long, url string",
    ).selectExpr("*", f"{day} as fetched", "'mine' as entry_note")
    events = spark.createDataFrame(
        [("b.com", "block", "2024-01-01"), ("a.b.com/x", "allow", "2024-02-01"), ("b.com", "block", "2024-01-01"),
         ("b.com", "remove", "2024-02-15"), ("b.com", "block", "2024-03-01"), (None, "block", "2024-01-01"), ("a.b.com", "block", "2024-03-02")],
        "pattern string, action string, day string",
    ).selectExpr("pattern", "action", "cast(day as date) as day")
    got = sort((r.page_id, r.entry, r.blocked, r.n_active) for r in urls.filter_captures(pages, events).collect())
    want = [(1, "a.b.com/x", False, 2)] * 2 + [(2, "b.com", True, 1)] + [(n, None, False, 0) for n in (3, 4, 5)]
    assert got == sort(want)
    assert urls.filter_captures(pages, events.limit(0)).filter("blocked").count() == 0
    clashing = pages.selectExpr("*", *[f"'old' as {c}" for c in ("host", "n_active", "Entry", "since", "blocked", "top", "u", "f", "capture", "decided", "pattern", "until")])
    again = urls.filter_captures(clashing, events)
    assert again.columns == ["page_id", "url", "fetched", "entry_note", "top", "u", "f", "capture", "decided", "pattern", "until", *urls._ADDED]
    assert sort((r.page_id, r.entry, r.blocked, r.n_active) for r in again.collect()) == sort(want) and again.first().top == "old"
    assert urls.filter_captures(clashing.limit(0), events).count() == 0
    long = pages.limit(1).selectExpr("page_id", "concat('http://b.com/', repeat('x/', 100000), repeat('y', 100000)) as url", "fetched")
    assert [(r.entry, r.blocked) for r in urls.filter_captures(long, events).collect()] == [("b.com", True)]


def test_chat_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", None, ""), (1, 1, "assistant", "a", ""), (1, 1, "assistant", "a", ""),
            (None, None, None, None, ""), (2, 5, "tool: x\n", "### User: </turn>\\", "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[None].n_turns == 1 and got[2].n_turns == 1
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_empty_tables(spark):
    none, items = fixtures.empty(spark), fixtures.benchmark(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.components_of(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert pii.pii_report(none).count() == 0
    assert contamination.contamination(none, items).count() == 0
    assert quality.quality_report(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert toxicity.score(none, labels).count() == 0
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        if name == "decontamination":
            docs = contamination.remove_contaminated(docs, items)
        else:
            docs = stage(spark, docs, "")
        assert docs.count() == 0
