"""Boosted trees fitted on a bounded sample and applied as column expressions."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A leaf is a number, an inner node (feature, threshold, left, right).
Node = float | tuple


def _node(java: Any) -> Node:
    if java.getClass().getSimpleName() == "LeafNode":
        return float(java.prediction())
    split = java.split()
    left, right = _node(java.leftChild()), _node(java.rightChild())
    return (split.featureIndex(), float(split.threshold()), left, right)


def _column(node: Node, features: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(features[feature] <= threshold, _column(left, features)).otherwise(_column(right, features))


class Boosted(NamedTuple):
    trees: tuple[Node, ...]
    weights: tuple[float, ...]

    def score(self, features: Column) -> Column:
        """Probability of label 1 for an array of doubles; stays inside the JVM."""
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + _column(tree, features) * weight
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The ``most`` rows with the smallest digests of ``key``: the same on every run."""
    return rows.withColumn("__o", F.xxhash64(key)).orderBy("__o").limit(most).drop("__o")


def fit(rows: DataFrame, *, rounds: int = 10, depth: int = 3, step: float = 0.3, seed: int = 7) -> Boosted | None:
    """Fit on ``features array<double>`` and ``label 0/1``; None unless both labels occur."""
    seen = {r.label for r in rows.select(F.col("label").cast("int")).distinct().collect()}
    if seen != {0, 1}:
        return None
    data = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxBins=32)
    model = gbt.fit(data)
    trees = tuple(_node(t._java_obj.rootNode()) for t in model.trees)
    return Boosted(trees, tuple(float(w) for w in model.treeWeights))
