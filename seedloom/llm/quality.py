"""Quality rules whose limits adapt to language and source.

Each measure of a document is an integer. Counts of its rounded values are the
quantile sketch of a group: they merge by addition, come out the same in any
order, have at most a few hundred entries, and give a quantile within 1/32.
Limits are fences around the bulk of a group's documents. A source with few
documents takes the fences of its language, a small language those of all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.expr import let, whole_div
from seedloom.llm.common import few_rows, fresh
from seedloom.sources.staging import stage

_WORD = r"[^\x20\x09-\x0D]+"
_NOT_SYMBOL = r"[^#*$%&|<>]+"
_REPEAT_WINDOW = 5


class Rules(NamedTuple):
    """Parameters of the adaptive part.

    A measure passes up to its group's 99th percentile plus a margin, a quarter
    of that percentile and at least the measure's own; where more than a
    hundredth of a group is off, so that this percentile is too, up to the
    upper quartile plus ``reach`` times the quartile distance, which counts as
    at least the measure's spread. Of both limits the lower counts.
    ``least_rows`` is what a group needs for limits of its own.
    """

    reach: int = 3
    least_rows: int = 200
    # Name, spread, margin.
    measures: tuple[tuple[str, int, int], ...] = (
        ("symbols", 20, 40),  # per 1,000 characters of words
        ("capitals", 60, 100),  # per 1,000 characters of words
        ("dup_lines", 170, 300),  # per 1,000 lines: one of a short text's two or three may repeat
        ("repeats", 70, 100),  # per 1,000 words; the base rule alone allows 200
        ("word_length", 20, 20),  # in tenths of a character; also bounds below
    )
    # Up to so many groups the limits are broadcast.
    few_groups: int = 100_000


RULES = Rules()


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""
    size, w = F.size(words), _REPEAT_WINDOW
    at = F.when(size >= w, F.sequence(F.lit(0), size - w)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(w)]))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(pairs: Column) -> Column:
            def twin(p: Column, k: Column) -> Column:
                same = [F.coalesce(F.get(pairs, k + d)["h"] == p["h"], F.lit(False)) for d in (-1, 1)]
                return F.when(same[0] | same[1], F.sequence(p["i"], p["i"] + (w - 1)))

            spans = F.array_compact(F.transform(pairs, twin))
            return F.size(F.array_distinct(F.flatten(spans)))

        # Without an equal pair of windows nothing is sorted.
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0)).otherwise(let(pairs, marked))

    return let(hashes, covered)


def _counts(text: Column) -> Column:
    """A struct of the base counts and what the measures need."""

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        long = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.array_join(words, "")),
            "n_symbols": F.char_length(F.regexp_replace(text, _NOT_SYMBOL, "")),
            "lines": let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))),
            "n_capitals": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*[c.alias(n) for n, c in long.items()])

    return let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), of)


def _ratio(part: Column, whole: Column, by: int) -> Column:
    return F.when(whole > 0, F.call_function("div", part * by, whole)).otherwise(F.lit(0).cast("long"))


def measured(documents: DataFrame, name: str) -> DataFrame:
    """Add a struct of counts, measures and ``base_failed`` under ``name``.

    Null text has no words, so it fails the base rule like any other text of
    fewer than ten words. Narrow: no shuffle.
    """
    counted = documents.withColumn(name, _counts(F.coalesce(F.col("text"), F.lit(""))))
    c = {k: F.col(name)[k].cast("long") for k in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_repeat_words")}
    lines, dup = (F.col(name)["lines"][k].cast("long") for k in ("n", "dup"))
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    measures = {
        "symbols": _ratio(c["n_symbols"], c["word_chars"], 1000),
        "capitals": _ratio(c["n_capitals"], c["word_chars"], 1000),
        "dup_lines": _ratio(dup, lines, 1000),
        "repeats": _ratio(c["n_repeat_words"], c["n_words"], 1000),
        "word_length": _ratio(c["word_chars"], c["n_words"], 10),
    }
    fields = {**c, "n_dup_lines": dup, **measures, "base_failed": failed}
    return counted.withColumn(name, F.struct(*[v.alias(k) for k, v in fields.items()]))


def _group(column: str) -> Column:
    """A key that tells null from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _rounded(value: Column) -> Column:
    """Keep the six leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return value - value % step


def sketches(rows: DataFrame, name: str, rules: Rules = RULES) -> DataFrame:
    """``lang, source, measure, value, n``: how many documents have a rounded value.

    Documents that fail the base rules do not count. Partial counts are made
    before the shuffle, so a source of any size sends a few hundred rows a task.
    """
    measure = [
        F.struct(F.lit(m).alias("measure"), _rounded(F.col(name)[m]).alias("value")) for m, *_ in rules.measures
    ]
    good = rows.filter(~F.col(name)["base_failed"])
    flat = good.select(_group("lang").alias("lang"), _group("source").alias("source"), F.inline(F.array(*measure)))
    return flat.groupBy("lang", "source", "measure", "value").agg(F.count(F.lit(1)).alias("n"))


# Percentiles that limits are made of.
_PERCENTILES = (1, 25, 75, 99)


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Rows and percentiles of each group and measure."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    # At most a few hundred values per group and measure.
    up = Window.partitionBy(*keys, "measure").orderBy("value")
    ranked = merged.withColumn("upto", F.sum("n").over(up))
    ranked = ranked.withColumn("rows", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    found = [
        F.min(F.when(100 * F.col("upto") >= q * F.col("rows"), F.col("value"))).alias(f"p{q}") for q in _PERCENTILES
    ]
    return ranked.groupBy(*keys, "measure").agg(F.first("rows").alias("rows"), *found)


def limits(sketch: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``lang, source`` and a struct of limits per measure."""
    own = _quantiles(sketch, "lang", "source")
    lang = _quantiles(sketch, "lang")
    every = _quantiles(sketch.withColumn("all", F.lit(1)), "all").drop("all")
    values = ["rows", *[f"p{q}" for q in _PERCENTILES]]

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumn(tag, F.struct(*values)).drop(*values)

    joined = named(own, "o").join(named(lang, "l"), ["lang", "measure"]).join(named(every, "e"), "measure")
    pick = (
        F.when(F.col("o.rows") >= rules.least_rows, F.col("o"))
        .when(F.col("l.rows") >= rules.least_rows, F.col("l"))
        .otherwise(F.col("e"))
    )
    joined = joined.withColumn("p", pick)

    def of(n: int) -> Column:
        return F.create_map(*[F.lit(x) for m in rules.measures for x in (m[0], m[n])])[F.col("measure")].cast("long")

    reach = rules.reach * F.greatest(F.col("p.p75") - F.col("p.p25"), of(1))

    def margin(q: str) -> Column:
        return F.greatest(whole_div(F.col(q), 4), of(2))

    high = F.least(F.col("p.p75") + reach, F.col("p.p99") + margin("p.p99"))
    low = F.greatest(F.col("p.p25") - reach, F.col("p.p1") - margin("p.p1"))
    fences = joined.select("lang", "source", "measure", F.struct(low.alias("low"), high.alias("high")).alias("f"))
    columns = [F.max(F.when(F.col("measure") == m, F.col("f"))).alias(m) for m, *_ in rules.measures]
    return fences.groupBy("lang", "source").agg(*columns)


def judged(documents: DataFrame, carry: list[str], rules: Rules = RULES) -> tuple[DataFrame, str, str]:
    """The columns ``carry`` with a struct of counts and a verdict; their names come along.

    Counting is the dear part, so its rows are staged once, with no more than
    the columns asked for; sketch and verdict read them back.
    """
    name, verdict = fresh(documents, "__quality"), fresh(documents, "__kept")
    rows = stage(measured(documents, name).select(*carry, name), "quality")
    fences = limits(sketches(rows, name, rules), rules)
    g, f = fresh(documents, "__g"), fresh(documents, "__f")
    fences = fences.select(F.struct("lang", "source").alias(g), F.struct(*[m for m, *_ in rules.measures]).alias(f))
    fences = stage(fences, "fences")
    if few_rows(fences, rules.few_groups):
        fences = F.broadcast(fences)
    group = F.struct(_group("lang").alias("lang"), _group("source").alias("source"))
    joined = rows.alias("d").join(fences, group == F.col(g), "left")
    inside = F.lit(True)
    for m, *_ in rules.measures:
        value, fence = F.col(f"d.{name}")[m], F.col(f)[m]
        inside = inside & (value <= fence["high"])
        if m == "word_length":
            inside = inside & (value >= fence["low"])
    kept = ~F.col(f"d.{name}")["base_failed"] & F.coalesce(inside, F.lit(True))
    return joined.select(*[F.col(f"d.`{c}`") for c in rows.columns], kept.alias(verdict)), name, verdict


def quality_report(documents: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row per document with its counts and verdict.

    Null text counts as no words. Repeated rows stay. Groups are made of lang
    and source, null being a value of its own.
    """
    rows, name, verdict = judged(documents, ["doc_id", "lang", "source"], rules)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select("doc_id", *[F.col(name)[c].alias(c) for c in shown], F.col(verdict).alias("kept"))


def keep_good(documents: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    rows, _, verdict = judged(documents, documents.columns, rules)
    return rows.filter(F.col(verdict)).select(*documents.columns)
