"""Rows that hold any phrase of a table of phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.expr import let
from seedloom.sources.staging import stage

_APART = r"[^\p{L}\p{N}]+"


def phrase_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _APART), lambda w: w != "")


def _joined(w: Column, words: int) -> Column:
    """All runs of ``words`` words, as texts."""

    def step(r: Column, n: int) -> Column:
        left = F.greatest(F.size(w) - n, F.lit(0))
        return F.zip_with(F.slice(r, F.lit(1), left), F.slice(w, F.lit(n + 1), left), lambda a, b: F.concat_ws(" ", a, b))

    runs = w
    for n in range(1, words):
        runs = step(runs, n)
    return runs


def _run_keys(w: Column, lengths: Sequence[int]) -> Column:
    """Distinct keys of a text's runs of 1, 2, 4 ... words, of the lengths asked for; a key is made of those of both halves."""
    longest = max(lengths)

    def from_length(length: int, keys: Column) -> Column:
        here = [keys] if length in lengths else []
        if length == longest:
            return here[0]
        left = F.greatest(F.size(keys) - length, F.lit(0))
        pairs = F.zip_with(F.slice(keys, F.lit(1), left), F.slice(keys, F.lit(length + 1), left), lambda a, b: F.xxhash64(a, b))
        longer = let(pairs, lambda k: from_length(2 * length, k))
        return F.concat(*here, longer) if here else longer

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda k: F.array_distinct(from_length(1, k)))


def match_phrases(df: DataFrame, text: str, phrases: DataFrame, *, row_id: str = "row_id") -> DataFrame:
    """``row_id, n_phrases, reasons`` of the rows whose words hold a phrase in a row.

    ``phrases`` has ``phrase`` and ``reason``, in any number; phrases without a
    word match nothing. A phrase is looked for by a run of its words, of the
    largest power of two that fits into it, and of several such runs by the one
    that the fewest rows have. Rows are asked for those runs alone, and what
    they find is verified in the row. So neither side is broadcast by this, the
    work per row grows with its words and not with the phrases that share a
    word with it, and only long phrases meet rows that do not hold them.
    ``row_id`` is unique.
    """
    asked = phrases.select(phrase_words(F.col("phrase")).alias("words"), "reason").filter(F.size("words") > 0)
    asked = asked.select("words", F.array_join("words", " ").alias("phrase"), "reason").distinct()
    length = F.pow(F.lit(2), F.floor(F.log2(F.size("words") + 0.5))).cast("int")
    asked = stage(asked.withColumn("length", length), "phrases")
    # As many as the longest phrase has doublings.
    lengths = sorted(r.length for r in asked.select("length").distinct().collect())
    if not lengths:
        nothing = df.limit(0)
        return nothing.select(row_id, F.lit(0).cast("long").alias("n_phrases"), F.array().cast("array<string>").alias("reasons"))
    own = F.coalesce(*[F.when(F.col("length") == n, _run_keys(F.col("words"), [n])) for n in lengths])
    asked = stage(asked.select("phrase", "reason", F.explode(own).alias("w")), "phrase-runs")
    each = df.select(row_id, F.explode(_run_keys(phrase_words(F.col(text)), lengths)).alias("w"))
    # Runs of rows that are in a phrase.
    known = stage(each.join(asked.select("w").distinct(), "w", "left_semi"), "phrase-words")
    counts = known.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # A phrase with a run that no row has is in no row.
    filed = asked.join(counts, "w", "left").groupBy("phrase", "reason").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("f"))
    filed = filed.filter("f.n > 0").select(F.col("f.w").alias("w"), "phrase", "reason")
    found = known.join(filed, "w").groupBy(row_id).agg(F.collect_set(F.struct("phrase", "reason")).alias("__p"))
    found = stage(found, "phrase-candidates")

    def holds(line: Column) -> Column:
        return F.filter("__p", lambda p: line.contains(F.concat(F.lit(" "), p["phrase"], F.lit(" "))))

    line = F.concat(F.lit(" "), F.array_join(phrase_words(F.col(text)), " "), F.lit(" "))
    held = df.join(found, row_id).select(row_id, F.transform(F.array(line), holds)[0].alias("h")).filter(F.size("h") > 0)
    n = F.size(F.array_distinct(F.col("h.phrase"))).cast("long")
    return held.select(row_id, n.alias("n_phrases"), F.array_sort(F.array_distinct(F.col("h.reason"))).alias("reasons"))


def telling_phrases(df: DataFrame, text: str, bad: Column, *, words: int = 2, least: int = 2, reason: str = "toxic") -> DataFrame:
    """``phrase, reason``: runs of words of at least ``least`` bad rows and of no other.

    ``bad`` is true, false or, for rows that say nothing, null.
    """

    def runs(w: Column) -> Column:
        return F.array_distinct(_joined(w, words))

    judged = df.select(bad.alias("bad"), let(phrase_words(F.col(text)), runs).alias("r")).filter("bad is not null")
    counted = judged.select("bad", F.explode("r").alias("phrase")).groupBy("phrase").agg(
        F.count_if(F.col("bad")).alias("n_bad"), F.count_if(~F.col("bad")).alias("n_other")
    )
    return counted.filter((F.col("n_bad") >= least) & (F.col("n_other") == 0)).select("phrase", F.lit(reason).alias("reason"))
