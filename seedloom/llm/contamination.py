"""Benchmark passages in training documents.

The hashes of the benchmark's windows of 13 normalised words are a set that
every task gets while it is small; documents are scanned window by window
against it, and a hit counts only if the words themselves are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import ascii_lower, few_rows, fresh
from seedloom.sources.staging import stage

WINDOW = 13
# Up to so many different windows their bare hashes (16 MB) are broadcast.
FEW_WINDOWS = 1_000_000
# Up to so many documents with a hit, or contaminated ones, their keys (24 MB) are broadcast.
FEW_CONTAMINATED = 1_000_000

# Letters, digits and everything beyond ASCII; capitals too, lowered afterwards.
# What is no part of a word is listed one by one: Java looks such a class up in
# one table, while ranges are tried in turn at each character.
_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(texts: DataFrame, keys: list[str], lengths: Sequence[int]) -> DataFrame:
    """``keys, n, i, hash``: a row for each window of the given lengths.

    A word is hashed once, a window by the hashes of its words. A text of fewer
    words than a window has none.
    """
    hashed = texts.select(*keys, _word_hashes(_words(ascii_lower(F.col("text")))).alias("__w"))
    sized = hashed.select(*keys, "__w", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    starts = F.when(F.size("__w") >= F.col("n"), F.sequence(F.lit(0), F.size("__w") - F.col("n")))
    at = sized.select(*keys, "__w", "n", F.explode(starts).alias("i"))
    return at.select(*keys, "n", "i", F.xxhash64(F.slice("__w", F.col("i") + 1, F.col("n"))).alias("hash"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``n, hash, gram, items``: each different window and whose it is.

    An item of fewer words is one window; one without words has none. A null
    item_id counts as the empty id.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    words = benchmark.select(item, _words(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("i")
    grams = words.select("item", "w", length.alias("n"), at)
    gram = F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("n"))).alias("gram")
    grouped = grams.select("item", "n", gram).groupBy("n", "gram").agg(F.collect_set("item").alias("items"))
    return grouped.withColumn("hash", F.xxhash64(_word_hashes(F.split("gram", " "))))


def hits(documents: DataFrame, keys: list[str], benchmark: DataFrame, window: int = WINDOW, few: int = FEW_WINDOWS) -> DataFrame:
    """``keys``, first word, length and items of every occurrence of a window.

    The scan joins nothing but hashes: to a broadcast set of those of the
    benchmark, or, if they are more than ``few``, by hash, in rows of a key, a
    place and a number. Only documents with a hit are looked at again, and their
    hits count if the words are equal. ``keys`` may not be null.
    """
    grams = stage(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # at most ``window``
    if not lengths:
        none = documents.select(*keys).filter(F.lit(False))
        empty = {"__i": "int", "__n": "int", "items": "array<string>"}
        return none.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    wanted = grams.select("hash").distinct()
    if few_rows(wanted, few):
        wanted = F.broadcast(wanted)
    at = _windows(documents, keys, lengths)
    found = at.join(wanted, "hash").groupBy(*keys).agg(F.collect_set(F.struct("n", "i", "hash")).alias("__found"))
    # A document's hits are no more than its windows.
    found = stage(found, "window-hits")
    hit = found.select(*keys)
    # While they are few, only the texts of documents with a hit are shuffled.
    if few_rows(hit, FEW_CONTAMINATED):
        hit = F.broadcast(hit)
    # Rows that agree in their keys agree in text.
    words = _words(ascii_lower(F.col("text"))).alias("__w")
    again = documents.join(hit, keys, "left_semi").dropDuplicates(keys).join(found, keys).select(*keys, words, "__found")

    def told(x: Column) -> Column:
        gram = F.concat_ws(" ", F.slice("__w", x["i"] + 1, x["n"]))
        return F.struct(x["i"].alias("__i"), x["n"].alias("n"), x["hash"].alias("hash"), gram.alias("gram"))

    told_apart = again.select(*keys, F.inline(F.transform("__found", told)))
    return told_apart.join(grams, ["n", "hash", "gram"]).select(*keys, "__i", F.col("n").alias("__n"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, few: int = FEW_WINDOWS) -> DataFrame:
    """One row per document: words, words hit, items, and whether it is contaminated.

    Null text has no words. Rows that agree in id and text get the same
    result each. An empty benchmark hits nothing. The documents themselves are
    never shuffled, only hits and one narrow row per document.
    """
    # A null id hashes like no id; the text's hash tells the two apart.
    key = [F.xxhash64("doc_id").alias("__k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("__h")]
    found = hits(documents.select(*key, "text"), ["__k", "__h"], benchmark, window, few)
    # A document's hits are no more than its words.
    spans = F.flatten(F.transform("__spans", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1)))
    per = found.groupBy("__k", "__h").agg(
        F.collect_set(F.struct(F.col("__i").alias("i"), F.col("__n").alias("n"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"),
    )
    per = per.select("__k", "__h", F.size(F.array_distinct(spans)).alias("__hit"), "__items")
    counted = documents.select("doc_id", *key, F.xxhash64("text").alias("text_hash"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(per, ["__k", "__h"], "left")
    n_hit = F.coalesce(F.col("__hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("__items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, as they came."""
    bad = contamination(documents, benchmark, window).filter("contaminated")
    i, h = fresh(documents, "__id"), fresh(documents, "__hash")
    bad = stage(bad.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "contaminated")
    # Two numbers each; while they are few, the texts need no shuffle to lose them.
    if few_rows(bad, FEW_CONTAMINATED):
        bad = F.broadcast(bad)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    return documents.join(bad, same, "left_anti")
