"""Exact Shapley values of stored trees (:mod:`boosting`), without Python workers.

What a tree contributes to a row depends only on which of its tests the row passes. So each row becomes one pattern of
test results for each tree; equal patterns are grouped, and each distinct pattern is explained once. For a leaf, the value
of a set of known features is a product over the features of its path: 1 or 0 for a known one (the row does or does not
follow the path), the share of training rows that do for an unknown one. The weights of the sets of each size are the
coefficients of a polynomial that takes up one feature after the other, kept as an SQL array. Work therefore grows with
patterns x leaves, and with rows only by one lookup for each tree.
"""

from __future__ import annotations

from math import factorial, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators.boosting import tree_nodes
from returns_risk.operators.features import sanitize
from returns_risk.sources.store import write_once

#: Tests in one number of a pattern, and patterns (some 200 bytes each) that are sent to every executor.
BITS, MOST_SENT = 62, 100_000

_LEAVES = (
    "tree int, value double, weights array<double>, "
    "path array<struct<feature: int, share: double, tests: array<struct<word: int, mask: bigint, want: bigint>>>>"
)


def _leaf_rows(tree: int, nodes: dict[int, dict], number_of: dict[int, int], features: list[str]) -> list[tuple]:
    """For each leaf its value, the weight of sets by size, and for each feature of its path the share and the tests."""
    out: list[tuple] = []

    def walk(number: int, path: dict[int, tuple[float, dict[int, tuple[int, int]]]]) -> None:
        node = nodes[number]
        if node["feature"] is None:
            n = len(path)
            weights = [factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)]
            steps = [(f, share, [(w, mask, want) for w, (mask, want) in tests.items()]) for f, (share, tests) in path.items()]
            out.append((tree, node["value"], weights, steps))
            return
        feature, (word, bit) = features.index(node["feature"]), divmod(number_of[number], BITS)
        share, tests = path.get(feature, (1.0, {}))
        mask, want = tests.get(word, (0, 0))
        for side, passed in (("left", 1 << bit), ("right", 0)):
            own = {**tests, word: (mask | 1 << bit, want | passed)}
            walk(node[side], {**path, feature: (share * nodes[node[side]]["rows"] / node["rows"], own)})

    walk(0, {})
    return out


def _pattern(nodes: dict[int, dict], number_of: dict[int, int]) -> str:
    """SQL: the results of a tree's tests as an array of whole numbers, one bit each."""
    words: dict[int, list[str]] = {}
    for number, place in number_of.items():
        word, bit = divmod(place, BITS)
        test = f"double({nodes[number]['feature']}) <= {nodes[number]['threshold']!r}D"
        words.setdefault(word, []).append(f"if({test}, {1 << bit}L, 0L)")
    return f"array({', '.join(' + '.join(bits) for bits in words.values())})"


def _explained(patterns: DataFrame, leaves: DataFrame, width: int) -> DataFrame:
    """phi0, phi1, ... of each (tree, pattern)."""
    passed = "transform(path, f -> struct(f.feature AS feature, f.share AS z, double(forall(f.tests, t -> (pattern[t.word] & t.mask) = t.want)) AS o))"
    taken_up = (
        "aggregate(path, array(1D), (sizes, f) -> if(f.feature = own.feature, sizes, zip_with("
        "concat(transform(sizes, s -> s * f.z), array(0D)), concat(array(0D), transform(sizes, s -> s * f.o)), (a, b) -> a + b)))"
    )
    part = f"value * (own.o - own.z) * aggregate(zip_with({taken_up}, weights, (s, w) -> s * w), 0D, (a, b) -> a + b)"
    # The leaves are bounded by the model.
    parts = patterns.join(F.broadcast(leaves), "tree").selectExpr("tree", "pattern", "value", "weights", f"{passed} AS path")
    parts = parts.selectExpr("*", "explode(path) AS own").selectExpr("tree", "pattern", "own.feature AS feature", f"{part} AS part")
    sums = [F.expr(f"sum(if(feature = {k}, part, 0D))").alias(f"phi{k}") for k in range(width)]
    return parts.groupBy("tree", "pattern").agg(*sums)


def explain_trees(df: DataFrame, model: DataFrame, key: str = c.CUSTOMER, features: tuple[str, ...] = c.FEATURES) -> DataFrame:
    """Adds ``base`` and ``phi`` (log-odds, feature order) of a :func:`boosting.train_trees` model.

    ``df`` has one row for each ``key`` and is read three times: pass a stored table. Runs the patterns at once.
    """
    spark, clean, names = df.sparkSession, sanitize(df, features), list(features)
    base, leaves, patterns = 0.0, [], []
    for tree, nodes in tree_nodes(model).items():
        inner = {number: place for place, number in enumerate(n for n in nodes if nodes[n]["feature"] is not None)}
        rows = _leaf_rows(tree, nodes, inner, names)
        base += sum(value * prod(share for _, share, _ in path) for _, value, _, path in rows)
        if inner:
            leaves += rows
            patterns.append(f"struct({tree} AS tree, {_pattern(nodes, inner)} AS pattern)")
    if not patterns:
        return clean.selectExpr("*", f"{base!r}D AS base", f"array_repeat(0D, {len(names)}) AS phi")
    hits = clean.selectExpr(key, f"inline(array({', '.join(patterns)}))")
    found = _explained(hits.select("tree", "pattern").distinct(), spark.createDataFrame(leaves, _LEAVES), len(names))
    found = write_once(found, "patterns")
    if found.limit(MOST_SENT + 1).count() <= MOST_SENT:
        found = F.broadcast(found)
    sums = hits.join(found, ["tree", "pattern"]).groupBy(key).agg(*[F.sum(f"phi{k}").alias(f"_phi{k}") for k in range(len(names))])
    phi = f"array({', '.join(f'_phi{k}' for k in range(len(names)))})"
    return clean.join(sums, key).selectExpr(*[f"`{name}`" for name in clean.columns], f"{base!r}D AS base", f"{phi} AS phi")
