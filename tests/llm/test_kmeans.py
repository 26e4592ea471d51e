"""Sharded clustering against plain integers."""

import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from seedloom.llm import kmeans  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, s):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == s.dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(s.scale * x) for x in e]))
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in drawn[: s.k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(s.rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (i, v), (k, _) in zip(kept, found, strict=True) if k == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    per = Counter()
    for c, d in found:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [
        (i, c, d, per[c], sum(per.values()), digest[c]) for (i, _), (c, d) in zip(kept, found, strict=True)
    ]


def vectors(seed, count, dims, spread=1.0):
    rng = random.Random(seed)
    # Halves and quarters are exact as floats.
    return [(n, [rng.randint(-400, 400) / 256 * spread for _ in range(dims)]) for n in range(count)]


def run(spark, rows, s):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    df = df.selectExpr("*", "1 as rid", "2 as cluster", "3 as distance", "4 as v", "5 as block").repartition(3)
    return sorted(map(repr, (tuple(r) for r in kmeans.report(kmeans.cluster(df, s)).collect())))


@pytest.mark.parametrize("shard", [3, 4, 12])
def test_shards_do_not_matter(spark, shard):
    s = kmeans.Settings(dims=12, shard=shard, k=4, rounds=2, scale=64)
    rows = vectors(shard, 60, 12)
    assert run(spark, rows, s) == sorted(map(repr, plain(rows, s)))


def test_odd_vectors(spark):
    s = kmeans.Settings(dims=4, shard=3, k=5, rounds=3, scale=64)
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None, 2.0, 3.0]), (5, [nan, 0.0, 0.0, 0.0]), (6, [0.0, inf, 0.0, 0.0]),
        (7, [0.0, 0.0, 0.0, -inf]), (8, [-0.0, -0.001, 0.001, 1.0]), (8, [-0.0, -0.001, 0.001, 1.0]), (8, [2.0, 2.0, 2.0, 2.0]),
        (None, [1.0, 1.0, 1.0, 1.0]), (None, None), (9, [1000000.0, -1000000.0, 0.5, 0.25]), (10, [1.0, 1.0, 1.0, 1.0]),
    ]
    rows += [(100 + n, [3.0, -3.0, 3.0, -3.0]) for n in range(30)]
    assert run(spark, rows, s) == sorted(map(repr, plain(rows, s)))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 3, 64)
    assert run(spark, rows, kmeans.SETTINGS) == sorted(map(repr, plain(rows, kmeans.SETTINGS)))
    assert run(spark, [(1, None)], kmeans.SETTINGS) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert kmeans.report(kmeans.cluster(empty)).count() == 0


def test_distances_that_do_not_fit_are_an_error(spark):
    s = kmeans.Settings(dims=2, shard=1, k=2, rounds=1)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0])], s)
