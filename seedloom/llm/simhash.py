"""SimHash near-duplicates by multi-index hashing.

Two fingerprints at most 3 bits apart differ in at most one bit in one of
their 32-bit halves. Each fingerprint is filed under both halves and looked up
under the Hamming ball of radius 1 around each; a pair that differs in a bit of
the half is found from the side that has the bit set, so the ball needs the
set bits only. What is found is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import few_rows, fresh
from seedloom.llm.components import components
from seedloom.sources.staging import stage

DISTANCE = 3
SEED = 42
# Under a half that more fingerprints share, the other half is indexed as well.
HOT = 256
# Up to so many row numbers of copies (16 MB) are broadcast.
FEW_COPIES = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over the 3-word shingles of a text, as a signed integer.

    Fewer than three words form one shingle; no words give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < 3:
        return int(np.array(xxhash.xxh64_intdigest(b" ".join(words), SEED), np.uint64).view(np.int64))
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    count, ones = len(words) - 2, np.zeros(64, np.int64)
    digest, at = xxhash.xxh64_intdigest, starts.tolist()
    for low in range(0, count, _BLOCK):
        high = min(count, low + _BLOCK)
        hashes = np.fromiter(
            (digest(joined[at[i] : at[i + 3] - 1], SEED) for i in range(low, high)), np.uint64, high - low
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count, bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column as a bigint; null counts as empty.

    One column crosses to Python batch by batch and one number comes back.
    """

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return df.withColumn(name, of(F.col(text)))


def _half(value: Column, which: int) -> Column:
    return F.shiftrightunsigned(value, 32) if which else value.bitwiseAND(0xFFFFFFFF)


def _key(half: Column, which: int) -> Column:
    return half.bitwiseOR(F.lit(which << 32))


def _ball(value: Column, bits: int, only_set: bool) -> Column:
    """``value`` and what differs from it in one of its low bits."""
    masks = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
    if only_set:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) != 0)
    return F.concat(F.array(value), F.transform(masks, lambda m: value.bitwiseXOR(m)))


def _parts(value: Column, which: Column) -> tuple[Column, Column]:
    """The two 16-bit parts of the half that a key does not hold."""
    other = F.when(which == 0, F.shiftrightunsigned(value, 32)).otherwise(value.bitwiseAND(0xFFFFFFFF))
    return other.bitwiseAND(0xFFFF), F.shiftrightunsigned(other, 16)


def _part_keys(values: Column, part: int) -> Column:
    return F.transform(values, lambda v: v + ((part + 1) << 16))


def _asked(half: Column, which: int) -> Column:
    return F.transform(
        _ball(half, 32, True),
        lambda v, i: F.struct(_key(v, which).alias("key"), (i > 0).alias("flip")),
    )


def _refined(rows: DataFrame, hot: DataFrame, ball: bool) -> DataFrame:
    """Rows under a hot key get a part of the other half as a second key.

    Within a hot key the other halves of a pair differ in at most 3 bits, so in
    at most one bit of one 16-bit part: exact again, with keys 2^16 as narrow.
    """
    which = F.shiftrightunsigned("key", 32)
    parts = _parts(F.col("fp"), which)
    many = [_part_keys(_ball(p, 16, False) if ball else F.array(p), n) for n, p in enumerate(parts)]
    flagged = rows.join(hot, "key", "left")
    sub = F.when(F.col("hot"), F.concat(*many)).otherwise(F.array(F.lit(0).cast("long")))
    return flagged.select("fp", "key", "flip", F.explode(sub).alias("sub"))


def links(prints: DataFrame, distance: int = DISTANCE, hot_from: int = HOT) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints, column ``fp``, at most 3 bits apart.

    ``prints`` holds each fingerprint once, so copies never pair with each other.
    The sides are sorted and merged: Spark takes the exploded keys, some 17 to a
    half, for as small as the table they come from and would broadcast them.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves and a ball of radius 1 find distances up to 3")
    fp = F.col("fp")
    halves = [_half(fp, w) for w in (0, 1)]
    filed = prints.select("fp", F.explode(F.array(*[_key(h, w) for w, h in enumerate(halves)])).alias("key"))
    filed = filed.withColumn("flip", F.lit(False))
    balls = [_asked(h, w) for w, h in enumerate(halves)]
    asked = prints.select("fp", F.inline(F.concat(*balls)))
    hot = filed.groupBy("key").count().filter(F.col("count") > hot_from).select("key", F.lit(True).alias("hot"))
    hot = stage(hot, "hot-halves")
    left = _refined(filed, hot, False).drop("flip").withColumnRenamed("fp", "a")
    right = _refined(asked, hot, True).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # An equal half is found from both sides, a flipped bit from one.
    once = F.col("flip") | (F.col("a") < F.col("b"))
    found = left.hint("merge").join(right.hint("merge"), ["key", "sub"]).filter(near & once & (F.col("a") != F.col("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """``(fp, root)`` of each fingerprint that has a link."""
    found = components(links(prints.select("fp").distinct()))
    return found.select(F.col("node").alias("fp"), "root")


def components_of(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of each document.

    The component id is the smallest doc_id reachable over links; ids that are
    null are passed over where there is another. Repeated rows stay repeated.
    """
    prints = with_fingerprint(documents.select("doc_id", "text"), name="fp").drop("text")
    prints = stage(prints, "fingerprints")
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    rooted = first.join(classes(first), "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", shown, "component_id")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id.

    Null ids come last, and among rows with the same id one stays. The other
    columns pass through; without rows the result is empty.
    """
    rid, fp = fresh(documents, "__row"), fresh(documents, "__fp")
    numbered = documents.withColumn(rid, F.monotonically_increasing_id())
    rows = stage(with_fingerprint(numbered, name=fp), "fingerprinted")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(rid).alias("r"))
    first = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(rank).alias("first"))
    first = stage(first, "prints")
    rooted = first.join(classes(first), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    best = rooted.join(best, "root").select("fp", F.col("best.r").alias("best"))
    copies = rows.select(rid, F.col(fp).alias("fp")).join(best, "fp").filter(F.col(rid) != F.col("best"))
    copies = stage(copies.select(rid), "copies")
    # Numbers only; while they are few, the texts need no shuffle to lose them.
    if few_rows(copies, FEW_COPIES):
        copies = F.broadcast(copies)
    return rows.join(copies, rid, "left_anti").select(*documents.columns)
