"""Exact Shapley values of gradient-boosted trees, along the paths of each tree.

The value of a set of known features is the expected tree output when splits on unknown features
send a row both ways, weighted by the training rows on either side. For one leaf this is a product
over the features on its path: 1 or 0 for a known feature (the row does or does not follow the path),
the share of training rows that do for an unknown one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators.features import sanitize
from returns_risk.sources.store import new_path


@dataclass
class Leaf:
    """One leaf: its path features, the interval each must lie in, the share of rows that do, its output."""

    features: list[int]
    low: list[float]
    high: list[float]
    shares: list[float]
    output: float
    expected: float


def leaves_of_tree(nodes: dict[int, dict], scale: float) -> list[Leaf]:
    """All leaves of one stored tree; ``scale`` multiplies the leaf outputs."""
    leaves: list[Leaf] = []

    def walk(number: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[number]
        if node["left"] < 0:
            shares = [share for _, _, share in path.values()]
            output = node["prediction"] * scale
            leaves.append(Leaf(
                list(path), [low for low, _, _ in path.values()], [high for _, high, _ in path.values()],
                shares, output, output * float(np.prod(shares)),
            ))
            return
        feature, threshold = node["feature"], node["threshold"]
        low, high, share = path.get(feature, (-inf, inf, 1.0))
        for child, low_, high_ in (
            (node["left"], low, min(high, threshold)), (node["right"], max(low, threshold), high)
        ):
            walk(child, {**path, feature: (low_, high_, share * nodes[child]["rows"] / node["rows"])})

    walk(0, {})
    return leaves


def read_leaves(df: DataFrame, model: PipelineModel) -> list[Leaf]:
    """The leaves of all trees, in log-odds, from the model as stored. Bounded by the model's size."""
    trees = model.stages[-1]
    path = new_path(df.sparkSession, "trees")
    trees.write().save(path)
    stored = df.sparkSession.read.parquet(f"{path}/data").selectExpr(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount AS rows",
        "nodeData.leftChild AS left", "nodeData.rightChild AS right",
        "nodeData.split.featureIndex AS feature",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) AS threshold",
    )
    by_tree: dict[int, dict[int, dict]] = {}
    for row in stored.collect():
        by_tree.setdefault(row.treeID, {})[row.id] = row.asDict()
    # A class probability is 1 / (1 + exp(-2 * margin)): twice the margin is the log-odds.
    return [
        leaf for tree, weight in enumerate(trees.treeWeights)
        for leaf in leaves_of_tree(by_tree[tree], 2.0 * weight)
    ]


def batch_explainer(leaves: list[Leaf]) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a batch of feature rows to phi (rows x features).

    For each path feature of a leaf, the other features are taken up one after the other into a
    polynomial whose coefficients tell how much weight the sets of each size have; the cost grows with
    the third power of the path's features. Rows that follow the same features of a leaf share the work.
    The function holds arrays only, so that Python workers need nothing of this package.
    """
    paths = []
    for leaf in leaves:
        if leaf.features:
            n = len(leaf.features)
            weights = np.array([factorial(size) * factorial(n - size - 1) / factorial(n) for size in range(n)])
            paths.append((np.array(leaf.features), np.array(leaf.low), np.array(leaf.high), np.array(leaf.shares), leaf.output, weights))

    def explain(values: np.ndarray) -> np.ndarray:
        phi = np.zeros_like(values)
        for features, low, high, shares, output, weights in paths:
            at = values[:, features]
            follows, row = np.unique((at > low) & (at <= high), axis=0, return_inverse=True)
            found = np.empty(follows.shape)
            for j in range(len(features)):
                sizes = np.zeros(follows.shape)
                sizes[:, 0] = 1
                for k in range(len(features)):
                    if k != j:
                        more = sizes[:, :-1] * follows[:, k, None]
                        sizes *= shares[k]
                        sizes[:, 1:] += more
                found[:, j] = output * (follows[:, j] - shares[j]) * (sizes @ weights)
            phi[:, features] += found[row.ravel()]
        return phi

    return explain


def tree_shapley(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``base`` and ``phi`` (log-odds, feature order) of a :func:`train_gbt` model.

    Rows stay in their partitions; only the feature columns pass through Arrow batches.
    """
    clean = sanitize(df)
    leaves = read_leaves(clean, model)
    base = float(sum(leaf.expected for leaf in leaves))
    explain = batch_explainer(leaves)

    @F.pandas_udf("array<double>")
    def phi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(explain(batch.to_numpy("float64"))))

    features = F.expr(f"struct({', '.join(f'double({name}) AS {name}' for name in c.FEATURES)})")
    return clean.withColumns({"base": F.lit(base), "phi": phi(features)})
