"""Lloyd's algorithm with the dimensions in shards.

Vectors are cut into blocks of columns. A task that holds rows of a block
computes exact integer partial distances to its slice of every centroid; the
partial distances of a vector are added over its blocks, the nearest centroid
is taken, and each block then updates its own slice of the centroids from the
assignments. No task needs a whole vector or a whole centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.sources.staging import stage


class Settings(NamedTuple):
    """``dims`` components a vector must have; ``shard`` of them form a block.

    Centroids are ``k`` times ``dims`` numbers, held as one row per block, so
    they are bounded by these parameters. ``scale`` turns a component x into
    the integer floor(scale * x).
    """

    dims: int = 64
    shard: int = 16
    k: int = 16
    rounds: int = 3
    scale: int = 64


SETTINGS = Settings()


class Clustering(NamedTuple):
    """``rows``: ``rid, vec_id, cluster, distance``; ``centroids``: ``block, slices``, one array per centroid."""

    rows: DataFrame
    centroids: DataFrame


def usable(vectors: DataFrame, settings: Settings) -> DataFrame:
    """``vec_id`` and ``v``, the integers of vectors of the right length without nulls, NaN and infinities."""
    raw = F.col("embedding")
    finite = F.forall(raw, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.filter((F.size(raw) == settings.dims) & F.coalesce(finite, F.lit(False)))
    v = F.transform(raw, lambda x: F.floor(x.cast("double") * settings.scale).cast("long"))
    return kept.select("vec_id", v.alias("v"))


# --- rows of integers as bytes ------------------------------------------------


def _packed(rows: np.ndarray) -> dict[str, list]:
    """Each row as bytes of the narrowest integers that hold all of them."""
    low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return {"width": [width] * len(rows), "part": [r.tobytes() for r in rows.astype(f"<i{width}")]}


def _unpacked(frame: pd.DataFrame) -> np.ndarray:
    widths, parts = frame["width"].to_numpy(), frame["part"].to_numpy()
    out = np.empty((len(frame), len(parts[0]) // int(widths[0])), np.int64)
    for width in np.unique(widths):
        mine = widths == width
        out[mine] = np.frombuffer(b"".join(parts[mine]), f"<i{width}").reshape(-1, out.shape[1])
    return out


_PACKED = "width int, part binary"


def _shards(vectors: DataFrame, settings: Settings) -> DataFrame:
    """``rid, block, width, part``: the vectors cut into blocks of columns."""
    starts = range(0, settings.dims, settings.shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            whole = np.stack(batch["v"].to_numpy()).astype(np.int64)
            for block, start in enumerate(starts):
                cut = _packed(whole[:, start : start + settings.shard])
                yield pd.DataFrame({"rid": batch["rid"], "block": block, **cut})

    return vectors.select("rid", "v").mapInPandas(run, f"rid long, block int, {_PACKED}")


# --- one round ----------------------------------------------------------------


def _first_centroids(vectors: DataFrame, settings: Settings) -> DataFrame:
    """``block, slices``: the ``k`` vectors with the smallest digests of their ids, cut up."""
    id_text = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    drawn = vectors.select(F.sha2(F.concat(F.lit("1:"), id_text), 256).alias("h"), "v").orderBy("h", "v").limit(settings.k)
    # No more than k rows: what the limit left.
    held = drawn.agg(F.sort_array(F.collect_list(F.struct("h", "v"))).alias("c")).filter(F.size("c") > 0)

    def cut(start: int) -> Column:
        return F.transform("c", lambda c: F.slice(c["v"], start + 1, settings.shard))

    slices = [cut(s) for s in range(0, settings.dims, settings.shard)]
    return held.select(F.posexplode(F.array(*slices)).alias("block", "slices"))


def _partial_distances(shards: DataFrame, centroids: DataFrame) -> DataFrame:
    """For each row of a block its squared distances to the slices of all centroids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("block", sort=False):
                c = np.stack([np.asarray(s, np.int64) for s in rows["slices"].iloc[0]])
                x = _unpacked(rows)
                widest = float(max(x.max(), c.max())) - float(min(x.min(), c.min()))
                if widest**2 * x.shape[1] >= 2**62:
                    raise OverflowError("a squared distance does not fit into 64 bits")
                found = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                yield pd.DataFrame({"rid": rows["rid"].to_numpy(), **_packed(found)})

    joined = shards.join(F.broadcast(centroids), "block")
    return joined.select("rid", "block", "width", "part", "slices").mapInPandas(run, f"rid long, {_PACKED}")


def _nearest(partial: DataFrame, blocks: int) -> DataFrame:
    """``rid, cluster, distance``: blocks added, then the smallest sum, of equal ones the first.

    A vector has a row per block; they lie together, though a batch may end between them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            whole = len(rows) // blocks * blocks
            rest, rows = rows[whole:], rows[:whole]
            if whole:
                parts = _unpacked(rows)
                if float(parts.max()) * blocks >= 2**62:
                    raise OverflowError("a squared distance does not fit into 64 bits")
                total = parts.reshape(-1, blocks, parts.shape[1]).sum(axis=1)
                best = total.argmin(axis=1)
                yield pd.DataFrame(
                    {"rid": rows["rid"].to_numpy()[::blocks], "cluster": best, "distance": total[np.arange(len(best)), best]}
                )

    placed = partial.repartition("rid").sortWithinPartitions("rid")
    return placed.mapInPandas(run, "rid long, cluster int, distance long")


def _updated(shards: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each block's slices replaced by the floor of the mean of their vectors; empty ones stay.

    Tasks add up before anything is shuffled, so a cluster with most of the
    vectors sends a row per batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (block, cluster), rows in batch.groupby(["block", "cluster"], sort=False):
                x = _unpacked(rows)
                if float(np.abs(x).max()) * len(x) >= 2**62:
                    raise OverflowError("a sum of components does not fit into 64 bits")
                yield pd.DataFrame({"block": [block], "cluster": [cluster], "n": [len(x)], "sums": [x.sum(axis=0)]})

    joined = shards.join(assigned.select("rid", "cluster"), "rid").select("block", "cluster", "width", "part")
    added = joined.mapInPandas(run, "block int, cluster int, n long, sums array<long>")
    flat = added.select("block", "cluster", "n", F.posexplode("sums").alias("at", "s"))
    per = flat.groupBy("block", "cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    floor = F.call_function("div", F.col("s") - F.pmod("s", "n"), F.col("n"))
    # A block has k centroids of ``shard`` numbers each.
    means = per.groupBy("block", "cluster").agg(F.sort_array(F.collect_list(F.struct("at", floor.alias("m")))).alias("m"))
    means = means.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.col("m.m").alias("m")))).alias("new"))
    slices = F.transform("slices", lambda old, c: F.coalesce(F.try_element_at(F.col("new"), c), old))
    kept = F.when(F.col("new").isNull(), F.col("slices")).otherwise(slices)
    return centroids.join(F.broadcast(means), "block", "left").select("block", kept.alias("slices"))


def cluster(vectors: DataFrame, settings: Settings = SETTINGS) -> Clustering:
    """Clusters of ``vec_id, embedding`` after ``rounds`` updates.

    Vectors of another length, null ones and ones with a null or non-finite
    component are left out. Rows of one id are vectors of their own; a null id
    counts as empty text in the draw, and of one id the smaller vector is drawn
    first. Fewer vectors than ``k`` make as many centroids. Equal distances go
    to the smaller number. Components whose squared distances pass 64 bits are
    an error. Rounds write assignments and centroids to the shared folder.
    """
    rid = F.monotonically_increasing_id().alias("rid")
    kept = stage(usable(vectors, settings).select(rid, "vec_id", "v"), "vectors")
    shards = stage(_shards(kept, settings), "shards")
    centroids = stage(_first_centroids(kept, settings), "centroids")
    blocks = -(-settings.dims // settings.shard)

    def assign() -> DataFrame:
        return stage(_nearest(_partial_distances(shards, centroids), blocks), "assigned")

    for _ in range(settings.rounds):
        centroids = stage(_updated(shards, assign(), centroids), "centroids")
    return Clustering(assign().join(kept.select("rid", "vec_id"), "rid"), centroids)


def report(found: Clustering) -> DataFrame:
    """One row per vector with its cluster, distance, inertia and its centroid's digest."""
    slices = found.centroids.agg(F.sort_array(F.collect_list(F.struct("block", "slices"))).alias("b"))
    # One row: k times ``dims`` numbers, whatever the number of vectors.
    numbers = F.sequence(F.lit(0), F.size(F.col("b")[0]["slices"]) - 1)
    flat = slices.filter(F.size("b") > 0).select("b", F.explode(numbers).alias("cluster"))
    whole = F.flatten(F.transform("b", lambda b: F.get(b["slices"], F.col("cluster"))))
    text = F.array_join(F.transform(whole, lambda x: x.cast("string")), ",")
    digests = flat.select("cluster", F.sha2(text, 256).alias("centroid_sha256"))
    per = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    small = per.join(digests, "cluster").crossJoin(F.broadcast(total))
    return found.rows.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
