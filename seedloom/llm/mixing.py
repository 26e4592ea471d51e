"""Mixing sources to target weights by proportionate fair scheduling.

Documents of a source, in a random but repeatable order, form blocks. In the
fluid mix every source with blocks left gets a share of each slot in proportion
to its weight. A block is released at the slot in which the fluid mix starts it
and due by the end of the one in which it finishes; each slot takes the released
block that is due first. All deadlines are met, as the fluid mix meets them, so
no source is ever a whole block ahead of or behind the fluid mix. Weights enter
as the exact values of their floats, releases and deadlines are exact integers,
and when a source runs out, the others share the slots in proportion.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from math import isfinite
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.sources.staging import stage


class Settings(NamedTuple):
    """Sizes and bounds.

    ``bucket_rows`` sizes the pieces in which a source's documents are numbered;
    from ``few_pieces`` times as many documents on, pieces grow instead. Without
    weights a source weighs its count to the power ``temper``; with weights,
    one that has none gets ``default_weight``. More sources than
    ``most_sources``, where it is set, are an error.
    """

    block: int = 16
    temper: float = 0.5
    default_weight: float = 1.0
    seed: int = 0
    most_sources: int | None = None
    bucket_rows: int = 4_000
    few_pieces: int = 100_000


SETTINGS = Settings()


def whole_weights(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    if not all(isfinite(w) and w > 0 for w in weights):
        raise ValueError("weights must be positive")
    ratios = [float(w).as_integer_ratio() for w in weights]
    # Denominators of floats are powers of two.
    scale = max((d for _, d in ratios), default=1)
    return [n * (scale // d) for n, d in ratios]


def earliest_deadlines(blocks: Sequence[int], weights: Sequence[int]) -> Iterator[tuple[int, int, int, int]]:
    """``source, block, release, deadline`` for one slot after the other.

    The fluid mix has spent ``sum(min(blocks, weight * v))`` slots at virtual
    time ``v`` and finishes the k-th block of a source at ``v = (k + 1) / weight``.
    Among equal deadlines the first source goes first. Holds one block of each
    source, so memory does not grow with the number of blocks.
    """
    shift = 2 * max((w.bit_length() for w in weights), default=0) + 1
    ends: dict[int, list[int]] = {}  # what stops at a virtual time: blocks, weight
    for n, w in zip(blocks, weights, strict=True):
        if n:
            # Different fractions of such denominators stay different and in order.
            end = ends.setdefault((n << shift) // w, [0, 0])
            end[0], end[1] = end[0] + n, end[1] + w
    times = sorted(ends)
    spent, left = [0], [sum(w for _, w in ends.values())]
    for v in times:
        spent.append(spent[-1] + ends[v][0])
        left.append(left[-1] - ends[v][1])
    waiting = [(0, i) for i, n in enumerate(blocks) if n]  # (release, source)
    taken = [0] * len(blocks)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, release, next release)
    for slot in range(spent[-1]):
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            k = taken[i] + 1
            piece = bisect_left(times, (k << shift) // weights[i])
            whole, part = divmod(left[piece] * k, weights[i])
            following = spent[piece] + whole
            heapq.heappush(ready, (following + (part > 0), i, release, following))
        deadline, i, release, following = heapq.heappop(ready)
        yield i, taken[i], release, deadline
        taken[i] += 1
        if taken[i] < blocks[i]:
            heapq.heappush(waiting, (following, i))


_PLAN = "s string, block bigint, release bigint, deadline bigint, slot bigint"


def planned(sources: DataFrame) -> DataFrame:
    """One row per block with its slot, from ``s``, ``blocks`` and ``weight`` of each source.

    Slots follow from one another, so one task makes them; it reads a row per
    source and hands on blocks as it goes.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(r for b in batches for r in zip(b["s"], b["blocks"].tolist(), b["weight"].tolist(), strict=True))
        columns = ["s", "block", "release", "deadline", "slot"]
        made = []
        dealt = earliest_deadlines([n for _, n, _ in rows], whole_weights([w for *_, w in rows]))
        for slot, (i, k, release, deadline) in enumerate(dealt):
            made.append((rows[i][0], k, release, deadline, slot))
            if len(made) == 50_000:
                yield pd.DataFrame(made, columns=columns)
                made = []
        if made:
            yield pd.DataFrame(made, columns=columns)

    return sources.select("s", "blocks", "weight").coalesce(1).mapInPandas(deal, _PLAN)


def _source(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def mix(
    documents: DataFrame,
    weights: Mapping[str, float] | None = None,
    settings: Settings = SETTINGS,
    *,
    order_key: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """Every document with the block it is in and that block's place in the mix.

    Adds ``block``, ``release``, ``deadline``, ``slot`` and ``place`` (within the
    block); reading by slot and place gives the mix, and nothing is dropped or
    repeated. Columns of these names in ``documents`` are replaced. A null
    source is a source of its own, named None in ``weights``. Rows that agree in
    ``order_key`` come in either order. An empty table stays empty.

    Any number of sources is mixed: counts, plan and pieces are tables, and the
    driver sees the number of rows. Documents are numbered in pieces of a source,
    so one that has a third of all rows is spread like the rest.
    """
    spark = documents.sparkSession
    added = ["block", "release", "deadline", "slot", "place"]
    kept = [c for c in documents.columns if c.lower() not in added]
    counts = documents.groupBy(_source("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(settings.temper)))
    else:
        named = [("" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        counts = counts.join(spark.createDataFrame(named, "s string, w double"), "s", "left")
        weight = F.coalesce("w", F.lit(float(settings.default_weight)))
    blocks = F.call_function("div", F.col("n") + (settings.block - 1), F.lit(settings.block))
    sources = stage(counts.select("s", "n", blocks.alias("blocks"), weight.alias("weight")), "mix-sources")
    bad = ~(F.col("weight") > 0) | F.isnan("weight") | (F.col("weight") == float("inf"))
    seen = sources.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows"), F.count_if(bad).alias("bad")).first()
    if settings.most_sources is not None and seen.sources > settings.most_sources:
        raise ValueError(f"more than {settings.most_sources} sources; group them first")
    if seen.bad:
        raise ValueError("weights must be positive")
    plan = stage(planned(sources), "mix-plan")

    # A source is cut where it has more rows than a piece: so many sources, and
    # twice so many pieces, are at most ``few_pieces``.
    bucket_rows = max(settings.bucket_rows, -(-(seen.rows or 0) // settings.few_pieces))
    buckets = F.call_function("div", F.col("n") + (bucket_rows - 1), F.lit(bucket_rows))
    large = sources.filter(F.col("n") > bucket_rows).select(F.col("s").alias("of"), buckets.alias("buckets"))
    # The document travels as one column, so its names clash with none of these.
    first = F.xxhash64(F.lit(settings.seed), *order_key).alias("digest")
    hashed = documents.select(F.struct(*kept).alias("row"), _source("source").alias("s"), first, F.col(order_key[0]).alias("k0"))
    placed = hashed.join(F.broadcast(large), F.col("s") == F.col("of"), "left")
    placed = placed.withColumn("bucket", F.pmod("digest", F.coalesce("buckets", F.lit(1)))).drop("of", "buckets")
    sizes = placed.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per piece of a source.
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    pieces = sizes.select("s", "bucket", "n", before)
    from_, to = (F.call_function("div", x, F.lit(settings.block)) for x in (F.col("before"), F.col("before") + F.col("n") - 1))
    spread = pieces.select("s", "bucket", "before", F.explode(F.sequence(from_, to)).alias("block"))
    # A piece and the blocks that its rows are in, in order.
    dealt = F.sort_array(F.collect_list(F.struct("block", "release", "deadline", "slot")))
    pieces = spread.join(plan, ["s", "block"]).groupBy("s", "bucket", "before").agg(dealt.alias("plan"))
    pieces = stage(pieces.select(F.col("s").alias("os"), F.col("bucket").alias("ob"), "before", "plan"), "mix-pieces")

    in_piece = F.row_number().over(Window.partitionBy("s", "bucket").orderBy("digest", "k0"))
    numbered = placed.withColumn("at", in_piece - 1)
    # Numbered rows lie as the join wants them, so documents are shuffled once.
    found = numbered.join(pieces, (F.col("s") == F.col("os")) & (F.col("bucket") == F.col("ob")))
    at = F.col("before") + F.col("at")
    nth = F.call_function("div", at, F.lit(settings.block)) - F.call_function("div", F.col("before"), F.lit(settings.block))
    found = found.select("row", F.get("plan", nth.cast("int")).alias("p"), (at % settings.block).cast("int").alias("place"))
    document = [F.col("row").getField(c).alias(c) for c in kept]
    return found.select(*document, *[F.col(f"p.{c}").alias(c) for c in added[:-1]], "place")
