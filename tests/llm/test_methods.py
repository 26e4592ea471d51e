"""What makes each method right, beside its results on small tables."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import fixtures  # noqa: E402
import specs  # noqa: E402

import corpus_pipeline  # noqa: E402
from seedloom.llm import anchors, chat, mixing, pii, quality, repeats, simhash, toxicity  # noqa: E402

TABLES = Path("/root/testdata/sf0.01")

# --- chat ------------------------------------------------------------------------

PIECES = st.sampled_from(["### ", "Assistant", ": ", "</turn>", "\\", "\n", "#", "é", "a", " ", "=%41", "</turn"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), TEXTS), TEXTS), max_size=5))
def test_chat_reads_back(turns):
    pieces = [chat.render(r, t) for r, t in turns]
    assert chat.parse("".join(p.text for p in pieces)) == turns
    for p, (_, text) in zip(pieces, turns, strict=True):
        assert chat.unescaped(p.text[p.start : p.end]) == text


def test_chat_escapes_only_where_needed():
    assert chat.render("user", "plain \\ text # 1").level == 0
    piece = chat.render("assistant", chat.HOSTILE_TEXT)
    assert piece.level == 1 and piece.text == "### Assistant: \\\\### Assistant: \\</turn> ok\n</turn>\n"
    with pytest.raises(ValueError):
        chat.parse("### User: a\n</turn>\n### User: b")


def test_chat_long_text():
    text = "\\" * 300_000 + "### " * 100_000
    assert chat.parse(chat.render("user", text).text) == [("user", text)]


# --- mixing ------------------------------------------------------------------------


def slots_of(blocks, weights):
    slots = [[] for _ in blocks]
    for slot, (i, k, release, deadline) in enumerate(mixing.earliest_deadlines(blocks, weights)):
        assert k == len(slots[i]) and release <= slot < deadline
        slots[i].append(slot)
    return slots


def plain_edf(shares):
    """Slot by slot: of the blocks released, the one due first; of equal ones that of the first source."""
    period, taken, order = sum(shares), [0] * len(shares), []
    for slot in range(period):
        due = [(-(-(k + 1) * period // w), i) for i, (k, w) in enumerate(zip(taken, shares, strict=True)) if k < w and k * period // w <= slot]
        i = min(due)[1]
        taken[i] += 1
        order.append(i)
    return order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_no_source_is_a_block_off(shares):
    period = sum(shares)
    slots = slots_of(shares, shares)
    assert sorted(x for s in slots for x in s) == list(range(period))
    assert [i for x in range(period) for i, s in enumerate(slots) if x in s] == plain_edf(shares)
    for share, mine in zip(shares, slots, strict=True):
        assert len(mine) == share
        for k, slot in enumerate(mine):
            assert k * period // share <= slot < -(-(k + 1) * period // share)
        done = np.cumsum(np.isin(np.arange(period), mine))
        assert np.all(np.abs(done - np.arange(1, period + 1) * share / period) < 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9)), max_size=5))
def test_schedule_uses_every_block_once(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    slots = slots_of(blocks, weights)
    assert [len(s) for s in slots] == blocks
    assert sorted(x for s in slots for x in s) == list(range(sum(blocks)))


def test_mix_follows_given_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 3 = 0, 'x', 'y') as source")
    rows = mixing.mix(docs, {"x": 3.0, "y": 1.0}, mixing.SETTINGS._replace(block=10)).select("slot", "source").distinct().collect()
    order = [r.source for r in sorted(rows)]
    assert all(abs(order[:n].count("x") - 0.75 * n) < 1 for n in range(1, 170))
    with pytest.raises(ValueError):
        mixing.mix(docs, settings=mixing.SETTINGS._replace(most_sources=1))


def test_mix_keeps_exact_weights_over_a_large_table(spark):
    docs = spark.range(120_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 19)) as source")
    few = mixing.SETTINGS._replace(block=4)
    for weights in (None, {"hot": 1.0, **{f"s{n}": 2.0 / 19 for n in range(19)}}, {"hot": 3.0, "s0": 0.0004}):
        got = mixing.mix(docs, weights, few, order_key=("doc_id",)).select("source", "slot", "release", "deadline").distinct().toPandas()
        got = got.sort_values("slot")
        sizes = docs.groupBy("source").count().toPandas().set_index("source")["count"]
        w = sizes**0.5 if weights is None else sizes.index.to_series().map(lambda s: weights.get(s, 1.0))
        blocks, total = -(-sizes // 4), (-(-sizes // 4)).sum()
        assert got.slot.tolist() == list(range(total))
        assert (got.release <= got.slot).all() and (got.slot < got.deadline).all()
        full = int((blocks / w).min() * w.sum())  # so long no source has run out
        assert full > 15_000
        slot = np.arange(1, full + 1)
        for s in sizes.index:
            done = np.cumsum(got.source.to_numpy()[:full] == s)
            assert np.abs(done - w[s] / w.sum() * slot).max() < 1 + 1e-9, s


def test_mix_takes_any_number_of_sources(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('site', id % 2500) end as source")
    rows = mixing.mix(docs, order_key=("doc_id",)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(12_000))
    assert len({(r.slot, r.place) for r in rows}) == len(rows) and all(r.release <= r.slot < r.deadline for r in rows)
    assert {r.slot for r in rows} == set(range(len({(r.source, r.block) for r in rows})))
    assert len({r.source for r in rows}) > 2400
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": 0.0}, order_key=("doc_id",))


# --- repeats -----------------------------------------------------------------------


def test_names_are_equal_for_equal_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    for length in (8, 21, 32, 100):
        names, seen = anchors.string_names(data, length), {}
        for i, n in enumerate(names.tolist()):
            assert seen.setdefault(data[i : i + length].tobytes(), n) == n
        assert len(set(seen.values())) == len(seen)


def test_long_texts_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(anchors, "_PART", 1000)
    rng = random.Random(5)
    made = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [made.encode(), (made[700:4100] + "x" * 1500).encode(), b"y" * 2500]
    every = [[np.concatenate(x) for x in zip(*anchors.anchor_runs([t], 128), strict=True)] for t in texts]
    for t, (_, low, high, at, _, _) in zip(texts, every, strict=True):
        assert low[0] == 0 and high[-1] == len(t) - 128 and np.all(low[1:] == high[:-1] + 1)
        assert np.all((at >= high) & (at + anchors.GRAM <= low + 128))


def test_repeats_of_many_kinds(spark):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))

    p, q = noise(500), noise(1500)
    texts = [p, noise(100) + p + noise(100), p[:399] + "X", p[:400] + "Y", p[50:450] + "Z", "a" * 2000, "ab" * 700, q,
             q[:700] + "!" + q[700:], q[:300] + noise(10) + q[310:], noise(30) + q[200:900] + p + q[100:600], noise(600) * 2]
    texts += [noise(rng.randint(0, 300)) + q[a : a + rng.randint(350, 800)] + noise(50) for a in rng.choices(range(1000), k=30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for together in (20_000, 3):
        got = sorted(map(tuple, repeats.remove_repeats(df, together=together).collect()))
        assert got == sorted(specs.removed(rows, 400))
    kept = {r.doc_id: r for r in repeats.remove_repeats(df, texts=True).collect()}
    assert len(kept[5].kept) == kept[5].n_bytes - kept[5].n_removed == 0


# --- SimHash -----------------------------------------------------------------------


@pytest.mark.parametrize("hot_from", [0, 3, 256])
def test_links_are_all_pairs_within_three_bits(spark, hot_from):
    rng = random.Random(hot_from)
    base = [rng.getrandbits(64) for _ in range(8)]
    made = set(base)
    for b in base:
        for n in range(30):
            flips = rng.sample(range(64), rng.randint(1, 5)) if n % 2 else rng.sample(range(32, 64), rng.randint(1, 4))
            made.add(b ^ sum(1 << f for f in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in made]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(r) for r in simhash.links(df, hot_from=hot_from).collect()}
    near = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3
    assert got == {(a, b) for a in signed for b in signed if a < b and near(a, b)}


def test_components_of_a_chain(spark):
    from seedloom.llm.components import components

    chain = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(1000, 1010).selectExpr("1000 as a", "id as b"))
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1010), 1000)}


# --- personal data -----------------------------------------------------------------


def test_base_spans_of_odd_and_long_texts(spark):
    texts = ["a@b.c_d@e.f x@y.z.", "é😀 a@b.co.uk.. 1.2.3.4.5.6.7.8", "9" * 30_000, "1 " * 30_000, "a." * 20_000 + "@x.y",
             "a@" + "b." * 20_000, "+1" + "(" * 20_000, "a@b.c" * 3000, "1.1.1.001 " * 3000, "256.1.1.1 0000255.1.1.1", "d@-.-",
             "4111111111111111 4111111111111111", "+1 (415) 555-1234 +12345678 +1234567890123456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in pii.KINDS:
        for r in df.select("doc_id", pii.base_spans(F.col("text"), kind).alias("s")).collect():
            want = [(a, b) for k, a, b in specs.base_spans(texts[r.doc_id]) if k == kind]
            assert [(s["start"], s["end"]) for s in r.s] == want, (kind, r.doc_id)


def test_overlapping_spans_are_redacted_once(spark):
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(e).alias("e")) for k, s, e in [(3, 5, 9), (0, 1, 4), (2, 7, 12), (1, 12, 13)]])
    assert spark.range(1).select(pii.redacted(F.lit("abcdefghijklmno"), spans)).first()[0] == "a[EMAIL]e[PHONE][IP]no"


def test_trees_add_what_looks_like_base_spans(spark):
    rng = random.Random(1)
    card = lambda: next(d for d in ("4" + "".join(rng.choices("0123456789", k=15)) for _ in range(500)) if specs.luhn(d))
    rows = [(n, f"word {fixtures.prose(n, 8)} {card()} then {rng.randint(10**12, 10**13)}") for n in range(300)]
    first, second = card(), card()
    rows.append((999, f"{first} {second}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert spans[999] == "card:0:16,card:17:33"


@pytest.mark.parametrize("copies", [1, 100])
def test_a_rare_kind_gets_its_threshold(spark, copies):
    rng = random.Random(2)
    card = lambda: next(d for d in ("4" + "".join(rng.choices("0123456789", k=15)) for _ in range(500)) if specs.luhn(d))
    rows = [(n, f"{fixtures.prose(n, 6)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}") for n in range(6000 // copies)] * copies
    rows += [(8000 + n, f"{fixtures.prose(n, 8)} {card()} then {rng.randint(10**12, 10**13)}") for n in range(90)]
    rows.append((9999, f"{card()} {card()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_report(df, pii.SETTINGS._replace(sample=60)).collect()}
    assert spans[9999] == "card:0:16,card:17:33"


# --- toxicity ----------------------------------------------------------------------


def test_disguised_words():
    lexicon = {"idiot": 1.0, "loser": 1.0}
    assert toxicity._disguised("an 1d10t and l0ser, i.d.i.o.t i*iot fine 2nd mp3 a-b", lexicon) == 4
    near = toxicity.features("you are an idiot", lexicon)
    far = toxicity.features("you " + "x " * 30 + "idiot", lexicon)
    assert near[5] > 0 and far[5] == 0 and len(near) == toxicity.N_FEATURES


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    ranks, bad = scored.score.rank(), scored.toxic == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.95 and scored[~bad].predicted.mean() < 0.01
    seen = toxicity.training_rows(docs, labels)
    assert seen.filter(toxicity.held_out(F.col("doc_id"))).count() == 0


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_against_plain_python(spark, tmp_path):
    docs = fixtures.nasty_rows()
    fixtures.nasty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    fixtures.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [d for d, k in zip(docs, specs.quality_kept([(t, la, s) for _, t, la, s, _ in docs], quality.RULES), strict=True) if k]
    prints = [specs.simhash(d[1]) for d in left]
    roots = specs.components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    groups = {}
    for n, d in enumerate(left):
        groups.setdefault(roots[n], []).append(d)
    left = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    items = [tuple(r) for r in fixtures.benchmark(spark).collect()]
    bad = specs.contamination([d[:2] for d in left], items)
    left = [d for d, b in zip(left, bad, strict=True) if not b[-1]]
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d[0] for d in left)))
    texts = {r.doc_id: r.text for r in got}
    for i, text, *_ in left:
        for kind, a, b in reversed(sorted(specs.base_spans(text), key=lambda s: s[1])):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        assert texts[i] == text
    assert len({(r.slot, r.place) for r in got}) == len(got)


def test_each_measure_rejects_an_outlier_that_the_base_rule_lets_pass(spark):
    from seedloom.llm import quality

    texts = [fixtures.prose(900 + n, 60 + n % 50) for n in range(400)]
    words = fixtures.prose(5000, 300).split()
    planted = {
        "symbols": " ".join(w + "###" for w in words[:60]),
        "capitals": " ".join(words[:60]).upper(),
        "dup_lines": "\n".join(x for n in range(30) for x in (" ".join(words[4 * n : 4 * n + 4]), "same line")),
        "repeats": " ".join([*words[:100], *words[:8]]),
        "long words": " ".join("".join(words[3 * n : 3 * n + 3]) for n in range(60)),
        "short words": " ".join(w[:1] + w[-1:] for w in words[:80]),
    }
    rows = [(n, t, "en", "a", 1) for n, t in enumerate([*texts, *planted.values()])]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, fixtures.DOCUMENTS)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [k for n, k in enumerate(planted) if got[400 + n].kept] == []
    assert sum(not got[n].kept for n in range(400)) <= 4


def test_addresses_that_the_base_pattern_swallows(spark):
    rng = random.Random(4)
    part = lambda: str(rng.randint(1, 254))
    rows = [(n, f"word {fixtures.prose(n, 6)} host {'.'.join(part() for _ in range(4))} done") for n in range(300)]
    rows += [(1000 + n, "key " + ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))) for n in range(150)]
    rows.append((9999, "host 256.10.20.30.40 done"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert got[9999].n_ip == 0 and got[9999].spans == "ip:9:20"
    assert all(got[1000 + n].spans == "" for n in range(150))


def test_lexicon_and_calibration_take_all_labels(spark):
    import math
    import zlib

    rng = random.Random(6)
    words = [f"word{n}" for n in range(60)]
    rows, marks = [], []
    for n in range(900):
        toxic = n % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(12)) + (f" Vile{n // 6 % 2} thing" if toxic else "")
        rows.append((n, text if n % 50 else rows[-6][1] if n > 6 else text))
        if n % 3 != 1:
            marks.append((n, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    small = toxicity.SETTINGS._replace(sample=40)
    known = toxicity.training_rows(docs, labels)
    got = toxicity.learn_lexicon(docs, known, small)
    texts = dict(rows)
    seen = {}
    for i, mark in marks:
        if zlib.crc32(str(i).encode()) % 5:
            seen[texts[i]] = max(seen.get(texts[i], 0), mark)
    bad, every = specs.Counter(), specs.Counter()
    for text, mark in seen.items():
        for w in set(text.lower().split()):
            bad[w] += mark
            every[w] += 1
    n1, n0 = sum(seen.values()), len(seen) - sum(seen.values())
    want = dict.fromkeys(toxicity.INSULTS, 1.0)
    for w in every:
        odds = math.log((bad[w] + 0.5) / (n1 + 1.0) / ((every[w] - bad[w] + 0.5) / (n0 + 1.0)))
        if bad[w] >= small.least_documents and odds >= small.least_log_odds:
            if 2 * bad[w] * math.log(bad[w] / (every[w] * n1 / (n1 + n0))) >= small.least_evidence:
                want[w] = odds
    assert {"vile0", "vile1"} <= set(want) and got.keys() == want.keys()
    assert all(abs(got[w] - want[w]) < 1e-9 for w in want)
    scored = {r.doc_id: r for r in toxicity.score(docs, labels, small).collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scored[i].held_out == (i in set(held)) for i in texts)
    assert sum(scored[i].predicted == int("Vile" in texts[i]) for i in held) >= 0.98 * len(held)


def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    """Spark sizes them by the file they come from, some 36 times too low, once no half is hot."""
    # Every second fingerprint differs in one bit from the one before.
    fp = F.xxhash64(F.col("id").bitwiseAND(-2)).bitwiseXOR(F.col("id").bitwiseAND(1))
    spark.range(20_000).select(fp.alias("fp")).write.parquet(f"{tmp_path}/prints")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert len(found.collect()) == 10_000
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    joined = [line for line in lines if "Join" in line and "bit_count" in line]
    assert joined and all("SortMergeJoin" in line for line in joined), lines
