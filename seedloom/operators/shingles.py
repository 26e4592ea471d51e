"""Word shingles of texts: near copies within a set, overlap between two sets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.expr import let
from seedloom.functions.text import py_strip
from seedloom.sources.staging import stage

WORDS = 5
SIMILARITY = 0.8


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The distinct hashed ``words``-word shingles of a text, in lower case and sorted.

    A text of fewer words is one shingle; one without words has none.
    """
    split = F.filter(F.split(F.lower(F.coalesce(py_strip(text), F.lit(""))), r"\s+"), lambda w: w != "")

    def keys(of_runs: Column, length: int) -> Column:
        """A run's key is made of those of the two shorter runs that it is made of."""
        if length == words:
            return of_runs
        step = min(length, words - length)
        left = F.greatest(F.size(of_runs) - step, F.lit(0))
        pairs = F.zip_with(F.slice(of_runs, F.lit(1), left), F.slice(of_runs, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))
        return let(pairs, lambda k: keys(k, length + step))

    def of(split: Column) -> Column:
        each = let(F.transform(split, lambda w: F.xxhash64(w)), lambda k: F.sort_array(F.array_distinct(keys(k, 1))))
        few = F.when(F.size(split) > 0, F.array(F.xxhash64(split))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(split) >= words, each).otherwise(few)

    return let(split, of)


def texts_once(df: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """``text_id, shingles``: one row for all texts with the same shingles, ``text_id`` their digest.

    Copies shrink before the shuffle. Texts without words are left out.
    """
    # A filter on the shingles would be pushed below them and make them twice.
    with_words = df.filter(py_strip(F.col(text)) != "")
    found = with_words.select(shingle_hashes(F.col(text), words).alias("shingles"))
    return found.groupBy(text_id(F.col("shingles")).alias("text_id")).agg(F.any_value("shingles").alias("shingles"))


def text_id(shingles: Column) -> Column:
    """128 bits of the shingles."""
    return F.concat_ws("-", F.hex(F.xxhash64(shingles)), F.hex(F.xxhash64(F.lit(1), shingles)))


def with_text_id(df: DataFrame, text: str, keep: list[str], words: int = WORDS) -> DataFrame:
    """The columns ``keep`` with ``text_id``, null for a text without words."""
    shingles = shingle_hashes(F.col(text), words)
    named = let(shingles, lambda s: F.when(F.size(s) > 0, text_id(s)))
    return df.select(*keep, named.alias("text_id"))


# --- near copies -------------------------------------------------------------


class Bands(NamedTuple):
    """Two texts of similarity s share a band with probability 1 - (1 - s^rows)^bands: 0.9998 at 0.8."""

    bands: int = 16
    rows: int = 4
    seed: int = 7


BANDS = Bands()
_PRIME = (1 << 61) - 1
# Orders of texts, from which each band takes one.
_ORDERS = 4


def _with_bands(texts: DataFrame, shape: Bands) -> DataFrame:
    """Add ``num``, and ``bands``, one number per band, from the minima of random hash functions.

    ``num`` is fixed once the table is staged, not before.
    """
    rng = np.random.default_rng(shape.seed)
    odd = rng.integers(0, 1 << 63, shape.bands * shape.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, shape.bands * shape.rows, dtype=np.uint64)

    def signature(shingles: np.ndarray) -> np.ndarray:
        h = np.asarray(shingles, np.int64).view(np.uint64)
        h = h ^ (h >> np.uint64(31))
        low = np.array([(h * a + b).min() for a, b in zip(odd, plus, strict=True)], np.uint64)
        low ^= low >> np.uint64(29)
        mixed = low.reshape(shape.bands, shape.rows)
        found = np.arange(shape.bands, dtype=np.uint64)
        for n in range(shape.rows):
            found = (found ^ mixed[:, n]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(32)
        return found.view(np.int64)

    @F.pandas_udf("array<bigint>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([signature(s) for s in batch], dtype="object")

    return texts.select(F.monotonically_increasing_id().alias("num"), "text_id", "shingles", bands("shingles").alias("bands"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets held as arrays of distinct values."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


# Counts of shingles, by so many bins of their hash; and how many of them are a row.
_BINS = 1 << 22
_BIN_BLOCK = 1 << 12
# Texts of a bucket that are compared as one block.
_BLOCK = 512
# Bits of the sieve, 16 MB at most.
_MOST_BITS = 1 << 27


def rarity(texts: DataFrame) -> np.ndarray:
    """How often the shingles of each bin occur, 65,535 at most: a table of 8 MB, however many texts.

    Shingles that share a bin count as more frequent than they are, which
    only changes the order in which they are asked for.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, np.int64)
        for batch in batches:
            hashes = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(hashes & (_BINS - 1), minlength=_BINS)
        if total.any():
            parts = np.minimum(total, 65_535).astype(np.uint16).reshape(-1, _BIN_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts])], ["block", "counts"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_BIN_BLOCK, np.int64)
        for counts in block["counts"]:
            total += np.frombuffer(counts, np.uint16)
        return pd.DataFrame({"block": block["block"][:1], "counts": [np.minimum(total, 65_535).astype(np.uint16).tobytes()]})

    parts = texts.select("shingles").mapInArrow(count, "block int, counts binary")
    found = np.zeros((_BINS // _BIN_BLOCK, _BIN_BLOCK), np.uint16)
    for row in parts.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        found[row.block] = np.frombuffer(row.counts, np.uint16)
    return found.reshape(-1)


def rarest(texts: DataFrame, seen: np.ndarray, share: float) -> DataFrame:
    """``h, num, n, i``: of each text's n shingles the rarest, of which one is in any ``share`` of them.

    ``i`` counts them from 0. All texts have one order, by ``seen`` and hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(sizes)), sizes)
                flat = flat[np.lexsort((flat, seen[flat & (_BINS - 1)], owner))]
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                wanted = sizes - np.ceil(sizes * share - 1e-9).astype(np.int64) + 1
                keep = place < wanted[owner]
                nums = part.column(0).to_numpy(zero_copy_only=False)
                columns = [flat[keep], nums[owner[keep]], sizes[owner[keep]].astype(np.int32), place[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "num", "n", "i"])

    return texts.select("num", "shingles").mapInArrow(run, "h bigint, num bigint, n int, i int")


def sieve(hashes: DataFrame, about: int) -> np.ndarray:
    """A bitmap of the one column of ``hashes``, ``about`` so many numbers, of 16 MB at most; see ``in_sieve``."""
    bits = min(_MOST_BITS, 1 << max(15, (16 * about).bit_length()))
    # Bit positions count from 1.
    at = hashes.select((F.col(hashes.columns[0]).bitwiseAND(bits - 1) + 1).alias("place"))
    rows = at.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    found = np.zeros((bits >> 15, 4096), np.uint8)
    for row in rows.collect():
        found[row.bucket - 1] = np.frombuffer(row.map, np.uint8)
    return found.reshape(-1)


def _passes(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    place = hashes & (len(held) * 8 - 1)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def in_sieve(hashes: Column, held: np.ndarray) -> Column:
    """True for every hash that the sieve was made of, and for some others."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_passes(batch.to_numpy(np.int64), held))

    return test(hashes)


def _near(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of numbers whose texts are near; only texts of a pair are shuffled."""
    pairs = stage(pairs, "pairs")
    held = sieve(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b")))), 2 * pairs.count())
    some = signed.select("num", "shingles").filter(in_sieve(F.xxhash64("num"), held))
    sides = [some.select(F.col("num").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    # Merged: Spark takes a filtered or repeated side for as small as its file.
    half = pairs.hint("merge").join(sides[0].hint("merge"), "a")
    both = half.hint("merge").join(sides[1].hint("merge"), "b")
    return stage(both.filter(jaccard(F.col("sa"), F.col("sb")) >= similarity).select("a", "b"), "near")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open_pairs(signed: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: every pair that may be near and is of two groups as yet, by ``roots``.

    Two texts of n and m shingles of which ``similarity`` are common share one
    of the n - ceil(similarity * n) + 1 rarest of the one and of the other, so
    all that may be near meet under such a shingle. Of these the pairs of one
    group are left out, as a link of them joins nothing, and those whose sizes
    or places in the order rule it out. A bucket is cut into blocks and any two
    blocks are compared by themselves, so that no task has a large bucket.
    """
    here = Window.partitionBy("h")
    met = rarest(signed, rarity(signed), similarity).withColumn("c", F.count(F.lit(1)).over(here))
    met = stage(met.filter("c > 1").drop("c"), "met")
    known = roots.select(F.col("text_id").alias("num"), "root")
    rooted = met.join(known, "num", "left").withColumn("root", F.coalesce("root", "num"))
    several = [F.min("root").over(here).alias("low"), F.max("root").over(here).alias("high"), F.count(F.lit(1)).over(here).alias("c")]
    rooted = stage(rooted.select("*", *several).filter("low <> high").drop("low", "high"), "open")
    blocks = F.ceil(F.col("c") / _BLOCK).cast("int")
    placed = rooted.withColumn("g", blocks).withColumn("p", F.pmod(F.xxhash64("num"), F.col("g")).cast("int"))
    sides = []
    for c, first, last in (("a", F.col("p"), F.col("g") - 1), ("b", F.lit(0), F.col("p"))):
        other = F.explode(F.sequence(first, last)).alias("other")
        side = placed.select("h", "p", *[F.col(x).alias(f"{x}{c}") for x in ("num", "n", "i", "root")], other)
        low, high = ("p", "other") if c == "a" else ("other", "p")
        sides.append(side.withColumn("low", F.col(low)).withColumn("high", F.col(high)).drop("p", "other"))
    # The texts left from this one on, in the order of all, are what two can have in common.
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - 1e-9)
    reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least
    once = (F.col("low") < F.col("high")) | (F.col("numa") < F.col("numb"))
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-9
    pairs = sides[0].hint("merge").join(sides[1].hint("merge"), ["h", "low", "high"])
    return pairs.filter(once & (F.col("roota") != F.col("rootb")) & sized & reach).select(*_ordered("numa", "numb")).distinct()


def near_links(texts: DataFrame, similarity: float = SIMILARITY, shape: Bands = BANDS, rounds: int = 2) -> DataFrame:
    """Verified links ``a, b`` between different texts, that join all that is near over any chain.

    First what bands of signatures show at little cost: in each bucket every
    text is compared with one of it, the first, and those that are not near it
    with the first of themselves, for ``rounds`` rounds. Which is first differs between bands, so
    that two texts that meet in some are not all the time compared with the
    same third one. A bucket of any size gives a row per text and round.

    Then, exact and without a cap, all pairs that may be near and are not in
    one group by these links (see ``_open_pairs``). So for any two near
    texts there is a chain of links, though not always one of their own.
    """
    signed = stage(_with_bands(texts, shape), "signatures")
    buckets = signed.select("num", F.posexplode("bands").alias("band", "key"))
    none = signed.select(F.col("num").alias("a"), F.col("num").alias("b")).filter(F.lit(False))
    links, tried = none, none
    place = F.xxhash64("num", F.col("band") % _ORDERS)
    for _ in range(rounds):
        keys = ["band", "key"]
        lead = buckets.groupBy(*keys).agg(F.min_by("num", place).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        asked = stage(buckets.join(lead, keys).filter("num <> a").select(*keys, "a", F.col("num").alias("b")), "asked")
        if asked.isEmpty():
            break
        # A pair that meets in many bands is compared once.
        pairs = stage(asked.select(*_ordered("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        near = _near(pairs, signed, similarity)
        links, tried = links.unionByName(near), tried.unionByName(pairs)
        found = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = asked.join(found, ["a", "b"], "left_anti").select(F.col("b").alias("num"), *keys)
        buckets = stage(rest, "buckets")
    rest = _open_pairs(signed, groups(links), similarity).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_near(rest, signed, similarity))
    for c in "ab":
        links = links.join(signed.select(F.col("num").alias(c), F.col("text_id").alias(f"text_{c}")), c)
    return stage(links.select(*_ordered("text_a", "text_b")), "near-links")


# --- groups ------------------------------------------------------------------

_SLICES = 64


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest neighbour; a node with many is reduced in slices first."""
    part = edges.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(_SLICES)).alias("slice")).agg(F.min("v").alias("m"))
    return part.groupBy("u").agg(F.min("m").alias("m"))


def groups(links: DataFrame) -> DataFrame:
    """``text_id, root``: the smallest text reachable over ``links (a, b)``, by handing labels on.

    Every text first points at its smallest neighbour, then at that one's
    target, until nothing changes; each round is written down.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    at = stage(_least(edges).select(F.col("u").alias("text_id"), F.least("u", "m").alias("root")), "labels")
    while True:
        # The smallest label around, then the label's own label.
        around = edges.join(at.select(F.col("text_id").alias("v"), F.col("root").alias("w")), "v").select("u", F.col("w").alias("v"))
        best = at.join(_least(around).select(F.col("u").alias("text_id"), "m"), "text_id")
        best = best.select("text_id", F.least("root", "m").alias("next"), "root")
        jump = at.select(F.col("text_id").alias("next"), F.col("root").alias("far"))
        moved = best.join(jump, "next").select("text_id", F.least("next", "far").alias("new"), "root")
        moved = stage(moved, "labels")
        at = moved.select("text_id", F.col("new").alias("root"))
        if moved.filter("new <> root").isEmpty():
            return at


def near_groups(
    df: DataFrame, text: str, *, row_id: str = "row_id", similarity: float = SIMILARITY, words: int = WORDS, shape: Bands = BANDS
) -> DataFrame:
    """``row_id, group_id``: rows whose texts are near, over any chain, share the group of the smallest row id.

    Near is a Jaccard similarity of word shingles of at least ``similarity``;
    every link is verified on whole texts, and none that would join two groups
    is missed. Rows without words are near each other and to
    nothing else. Copies are one text before anything is compared. A null row
    id makes a row, but names no group if there is another.
    """
    rows = stage(with_text_id(df, text, [row_id], words), "text-ids")
    links = near_links(texts_once(df, text, words), similarity, shape)
    roots = groups(links)
    named = rows.join(roots, "text_id", "left").withColumn("text_id", F.coalesce("root", "text_id")).drop("root")
    named = named.select(row_id, F.coalesce("text_id", F.lit("")).alias("text_id"))
    first = named.groupBy("text_id").agg(F.min(row_id).alias("group_id"))
    return named.join(first, "text_id").select(row_id, "group_id")


def split_by_group(
    df: DataFrame, text: str, shares: dict[str, int], *, row_id: str = "row_id", similarity: float = SIMILARITY, seed: int = 42, name: str = "split"
) -> DataFrame:
    """``row_id`` with the name of a split, the same for all rows of a near group.

    No text has a near copy, over any chain, in another split.
    """
    from seedloom.operators.refine import split_by_seed

    found = near_groups(df, text, row_id=row_id, similarity=similarity)
    return split_by_seed(found, shares, row_id="group_id", seed=seed, name=name)


# --- overlap of two sets -----------------------------------------------------


def _told(df: DataFrame, row_id: str, text: str, words: int) -> DataFrame:
    """Every row with its shingles, their text id and a number that is fixed once the table is staged."""
    made = let(shingle_hashes(F.col(text), words), lambda s: F.struct(s.alias("shingles"), text_id(s).alias("text_id")))
    named = df.select(row_id, F.monotonically_increasing_id().alias("__num"), made.alias("__made"))
    return named.select(row_id, "__num", F.col("__made.shingles").alias("__shingles"), F.col("__made.text_id").alias("__text_id"))


def _told_once(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``num, shingles`` of one row of each text; and by its ``num`` how many rows have the text.

    The shingles are not shuffled for it. A few more rows pass, which ``num``
    of the second table leaves out.
    """
    row_id = told.columns[0]
    with_words = told.filter(F.size("__shingles") > 0)
    counted = with_words.groupBy(F.col("__text_id").alias("text_id")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first"), F.min("__num").alias("num"), F.min(F.size("__shingles")).alias("n")
    )
    counted = stage(counted, "copies")
    firsts = sieve(counted.select(F.xxhash64("num")), counted.count())
    return with_words.select(F.col("__num").alias("num"), F.col("__shingles").alias("shingles")).filter(in_sieve(F.xxhash64("num"), firsts)), counted


def _postings(held: DataFrame, asked: np.ndarray) -> DataFrame:
    """``h, t`` of the shingles of ``held`` that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                keep = _passes(flat, asked)
                owner = np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(owner[keep])], ["h", "t"])

    return held.select("t", "st").mapInArrow(run, "h bigint, t bigint")


def overlap(
    rows: DataFrame,
    against: DataFrame,
    text: str,
    *,
    row_id: str = "row_id",
    least: float = SIMILARITY,
    words: int = WORDS,
) -> DataFrame:
    """``row_id, n_shingles, overlap, n_matches, match_id`` for every row of ``rows``.

    ``overlap`` is the largest part of the row's distinct shingles that one row
    of ``against`` holds, where that is at least ``least``; ``n_matches`` counts
    the rows that reach ``least`` and ``match_id`` is the smallest of those
    with the largest part. Otherwise they are null, 0 and null.

    Exact and without a cap. A row that holds ``least`` of n shingles holds one
    of any n - ceil(least * n) + 1 of them; the rarest in ``against`` are asked
    for, and those alone are joined. Neither side is broadcast by this, copies
    on either side are one text, and what is found is verified on whole sets.
    """
    told = [stage(_told(df, row_id, text, words), "told") for df in (rows, against)]
    texts, copies = zip(*[_told_once(x) for x in told], strict=True)
    asked = texts[0].select(F.col("num").alias("q"), F.col("shingles").alias("sq"), F.size("shingles").alias("n"))
    held = texts[1].select(F.col("num").alias("t"), F.col("shingles").alias("st"))
    each = asked.select("q", "n", F.explode("sq").alias("h"))
    # The shingles that are asked for, where they are held, and by how many texts. Most others never leave their task.
    wanted = stage(each.select("h").distinct(), "wanted")
    known = _postings(held, sieve(wanted, wanted.count()))
    known = stage(known.hint("merge").join(wanted.hint("merge"), "h", "left_semi"), "known")
    counts = stage(known.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "counts")
    rare = each.join(counts, "h", "left").groupBy("q", "n").agg(
        # A text's shingles are no more than its words.
        F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h"))).alias("r")
    )
    needed = F.ceil(F.col("n") * F.lit(least) - 1e-9)
    prefix = F.filter(F.slice("r", F.lit(1), (F.col("n") - needed + 1).cast("int")), lambda x: x["c"] > 0)
    probes = rare.select("q", F.inline(prefix)).select("q", "h")
    pairs = stage(probes.hint("merge").join(known.hint("merge"), "h").select("q", "t").distinct(), "pairs")
    common = F.size(F.array_intersect("sq", "st"))
    # Only texts of a pair are shuffled, each side merged: Spark takes what is filtered for as small as its file.
    few = [side.filter(in_sieve(F.xxhash64(c), sieve(pairs.select(F.xxhash64(c)), pairs.count()))) for side, c in ((asked, "q"), (held, "t"))]
    tested = pairs.hint("merge").join(few[0].hint("merge"), "q").hint("merge").join(few[1].hint("merge"), "t")
    tested = tested.select("q", "t", common.alias("common"), "n")
    found = stage(tested.filter(F.col("common") >= F.ceil(F.col("n") * F.lit(least) - 1e-9)), "overlaps")

    named = found.join(copies[1].select(F.col("num").alias("t"), "copies", "first"), "t")
    best = F.min(F.struct((-F.col("common")).alias("c"), F.col("first").alias("f")))
    per = named.groupBy("q").agg(best.alias("best"), F.sum("copies").alias("matches"))
    done = copies[0].select(F.col("num").alias("q"), "text_id", "n").join(per, "q", "left").drop("q")
    ids = told[0].select(row_id, F.when(F.size("__shingles") > 0, F.col("__text_id")).alias("text_id"))
    return ids.join(done, "text_id", "left").select(
        row_id,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        (-F.col("best.c") / F.col("n")).alias("overlap"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best.f").alias("match_id"),
    )
