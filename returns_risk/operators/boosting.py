"""Boosted trees for a 0/1 label, grown best leaf first on histograms.

Features are cut into at most ``bins`` bins. A round takes the gradient and hessian of the log loss of every row as whole
numbers (24 binary digits after the point) and sums them by leaf, feature and bin: each task on Arrow batches, then one
grouped aggregate over the tasks. Whole-number sums don't depend on the order of rows, so the trees are the same however
the rows are partitioned. At most leaves x features x bins sums come back to the driver, whatever the number of rows; the
splits are chosen there. The tree is grown as if the leaf with the highest gain were split one at a time; the sums of all
leaves that may take part are gathered together, one job for each level. Of two new leaves only the smaller one is summed,
the other is the difference. Leaves of at most ``TASK_ROWS`` rows are grown on by one task each, all of them in one job, by
the same steps. Each round's rows (bins, score, gradient) are a stored table, and the one before it is deleted.

A model is a small table of nodes. Tree 0 is the prior: a single leaf. Trees reach the tasks as data, not as SQL text: no
step compiles code of its own, however many and large they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators.evaluate import seeded_hash
from returns_risk.operators.features import sanitize
from returns_risk.sources.store import new_path, newest_version, remove_table, write_once, write_version

#: Nodes of a model: inner ones have a feature, a threshold (at most: left) and children, leaves a value in log-odds.
NODES = "tree int, node int, feature string, threshold double, left int, right int, value double, rows bigint, gain double"
#: Binary digits of a gradient; the sums of 2^38 rows fit into a long.
DIGITS = 24
#: Rows, those with the smallest seeded hash, that the bin limits are taken from. All rows are trained on.
BIN_ROWS = 200_000
#: Smallest sum of hessians in a leaf.
LEAST_HESSIAN = 1e-3
#: Rows of a leaf, about 50 bytes each, that one task grows on by itself.
TASK_ROWS = 1 << 18

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need nothing of this package


@dataclass
class _Node:
    """A node of the tree that is being grown; ``totals`` is (gradient, hessian, rows), ``sums`` the same by feature and bin."""

    totals: tuple[int, int, int]
    split: tuple[float, int, int] | None = None  # gain, feature, bin
    children: tuple[_Node, _Node] | None = field(default=None, repr=False)
    sums: np.ndarray | None = field(default=None, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)  # in a task


def _summed(sums: np.ndarray, least_rows: int, rows: np.ndarray | None = None) -> _Node:
    return _Node(tuple(int(n) for n in sums[:, 0].sum(axis=1)), _best_split(sums, least_rows), None, sums, rows)


def _reached(columns: Sequence[np.ndarray], way: Any, rows: np.ndarray) -> Iterator[tuple[Any, np.ndarray]]:
    """What is at the leaves of ``way``, each with those of ``rows`` that reach it.

    ``way`` is (feature, limit, way of the rows at most there, way of the others), or what is at a leaf; None: no matter.
    """
    if isinstance(way, tuple):
        feature, limit, low, high = way
        below = columns[feature][rows] <= limit
        yield from _reached(columns, low, rows[below])
        yield from _reached(columns, high, rows[~below])
    elif way is not None and len(rows):
        yield way, rows


def _bin_columns(bins: pa.Array | pa.ChunkedArray, features: int) -> np.ndarray:
    """The bin numbers by feature and row."""
    whole = bins.combine_chunks() if isinstance(bins, pa.ChunkedArray) else bins
    return np.ascontiguousarray(whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, features).T)


def _sums(columns: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, bins: int) -> np.ndarray:
    """(gradient, hessian, rows) by feature and bin. As floats the sums are exact: whole numbers below 2^53."""
    g, h = g[rows], h[rows]
    by_feature = [[np.bincount(column, weights, bins) for weights in (g, h, None)] for column in columns[:, rows]]
    return np.array(by_feature, dtype=np.float64).transpose(1, 0, 2).astype(np.int64)


def bin_limits(df: DataFrame, features: Sequence[str], bins: int, key: str) -> list[list[float]]:
    """The upper limits of each feature's bins but the last, ascending.

    Every value is a bin of its own where there are at most ``bins`` of them; else values go to bins by the share of
    rows below them. A limit lies halfway between the values on either side.
    """
    sample = df.orderBy(F.expr(seeded_hash(key)), key).limit(BIN_ROWS)
    lines = ", ".join(f"{k}, double({name})" for k, name in enumerate(features))
    values = sample.selectExpr(f"stack({len(features)}, {lines}) AS (feature, x)").groupBy("feature", "x").agg(F.count("*").alias("n"))
    by_value, all_values = Window.partitionBy("feature").orderBy("x"), Window.partitionBy("feature")
    numbered = values.select(
        "feature", "x", F.row_number().over(by_value).alias("place"), F.count("*").over(all_values).alias("distinct"),
        (F.sum("n").over(by_value) - F.col("n")).alias("below"), F.sum("n").over(all_values).alias("rows"),
    ).selectExpr("feature", "x", f"if(distinct <= {bins}, place - 1, (below * {bins}) div rows) AS bin")
    ends = numbered.groupBy("feature", "bin").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ends = ends.select("*", F.lead("low").over(Window.partitionBy("feature").orderBy("bin")).alias("next"))
    limits = ends.where("next IS NOT NULL").selectExpr(
        "feature", "if((high + next) / 2 < next, (high + next) / 2, high) AS upper"
    ).orderBy("feature", "upper").collect()  # at most features x bins
    return [[row.upper for row in limits if row.feature == k] for k in range(len(features))]


def _binned(df: DataFrame, features: Sequence[str], limits: list[list[float]]) -> DataFrame:
    """Adds ``_bins``, the bin numbers in feature order."""
    cut = [k for k, upper in enumerate(limits) if upper]
    df = df.selectExpr("*", *[f"double({features[k]}) AS _x{k}" for k in cut])
    if cut:  # a bucket holds its lower limit: the next number after a bin's upper limit
        splits = [[-np.inf, *(float(np.nextafter(upper, np.inf)) for upper in limits[k]), np.inf] for k in cut]
        df = Bucketizer(splitsArray=splits, inputCols=[f"_x{k}" for k in cut], outputCols=[f"_b{k}" for k in cut]).transform(df)
    numbers = ", ".join(f"smallint(_b{k})" if k in cut else "0S" for k in range(len(features)))
    return df.withColumn("_bins", F.expr(f"array({numbers})")).drop(*[f"_{kind}{k}" for k in cut for kind in "xb"])


def _with_gradient(score: str) -> list[str]:
    p = f"(1D / (1D + exp(-({score}))))"
    one = float(1 << DIGITS)
    return [f"bigint(floor(({p} - _y) * {one}D + 0.5D)) AS _g", f"bigint(floor({p} * (1D - {p}) * {one}D + 0.5D)) AS _h"]


def _best_split(sums: np.ndarray, least_rows: int) -> tuple[float, int, int] | None:
    """Gain, feature and bin of the best split; of equal ones the first feature, then the lowest bin."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    least = LEAST_HESSIAN * (1 << DIGITS)
    fits = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= least) & (right[1] >= least)
    (g, h), (g_left, h_left), (g_right, h_right) = (part[:2].astype(float) for part in (whole, left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g_left * g_left / h_left + g_right * g_right / h_right - g * g / h
    gain = np.where(fits, gain, 0.0)
    best = int(gain.argmax())
    return (float(gain.flat[best]), *(int(k) for k in divmod(best, gain.shape[1]))) if gain.flat[best] > 0 else None


def _grown(root: _Node, leaves: int) -> list[_Node]:
    """The nodes that are split, in order: always the leaf with the highest gain, of equal ones the oldest.

    A new right leaf takes the next number, the left one keeps its parent's. Leaves that aren't summed yet don't take part.
    """
    order, open_ = [], {0: root}
    while len(order) < leaves - 1:
        ready = [(-node.split[0], number) for number, node in open_.items() if node and node.split]
        if not ready:
            break
        number = min(ready)[1]
        node = open_[number]
        order.append(node)
        open_[number], open_[len(order)] = node.children or (None, None)
    return order


def _histograms(rows: DataFrame, shape: tuple[int, int], way: Any, leaves: int) -> list[np.ndarray]:
    """Sums by feature and bin of the rows that reach each of the ``leaves`` numbered in ``way``."""
    features, bins = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((leaves, 3, *shape), dtype=np.int64)
        for batch in batches:
            columns = _bin_columns(batch.column("_bins"), features)
            g, h = (batch.column(name).fill_null(0).to_numpy() for name in ("_g", "_h"))  # null: no label
            for leaf, own in _reached(columns, way, np.arange(batch.num_rows)):
                sums[leaf] += _sums(columns, g, h, own, bins)
        node, feature, bin_ = np.nonzero(sums[:, 2])
        arrays = [node, feature, bin_, *(sums[node, k, feature, bin_] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["node", "feature", "bin", "g", "h", "n"])

    kinds = "node bigint, feature bigint, bin bigint, g bigint, h bigint, n bigint"
    sums = rows.select("_g", "_h", "_bins").mapInArrow(partial, kinds).groupBy("node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")
    ).toArrow()
    out = np.zeros((leaves, 3, *shape), dtype=np.int64)
    place = tuple(sums[name].to_numpy() for name in ("node", "feature", "bin"))
    for k, name in enumerate(("g", "h", "n")):
        out[place[0], k, place[1], place[2]] = sums[name].to_numpy()
    return list(out)


def _grown_here(columns: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, leaves: int, least_rows: int) -> _Node:
    """A tree on rows that are all at hand."""
    every = np.arange(len(g))
    root = _summed(_sums(columns, g, h, every, bins), least_rows, every)
    while todo := [node for node in _grown(root, leaves) if node.children is None]:
        for node in todo:
            _, feature, bin_ = node.split
            below = columns[feature][node.rows] <= bin_
            low, high = node.rows[below], node.rows[~below]
            smaller = _sums(columns, g, h, min(low, high, key=len), bins)
            both = (smaller, node.sums - smaller) if len(low) <= len(high) else (node.sums - smaller, smaller)
            node.children = tuple(_summed(own, least_rows, rows) for own, rows in zip(both, (low, high), strict=True))
            node.sums = node.rows = None
    return root


def _grow_in_tasks(rows: DataFrame, shape: tuple[int, int], way: Any, nodes: list[_Node], leaves: int, least_rows: int) -> None:
    """Grows each of ``nodes``, numbered in ``way``, on as if it were the root, in a task of its own."""
    features, bins = shape

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.full(batch.num_rows, -1, dtype=np.int64)
            for place, own in _reached(_bin_columns(batch.column("_bins"), features), way, np.arange(batch.num_rows)):
                node[own] = place
            out = pa.RecordBatch.from_arrays([pa.array(node), *batch.columns], ["node", *batch.schema.names])
            yield out.filter(pa.array(node >= 0))

    def grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g, h = (table[name].fill_null(0).to_numpy() for name in ("_g", "_h"))
        lines: list[tuple] = []

        def add(node: _Node) -> int:
            number = len(lines)
            lines.append(())
            below = tuple(map(add, node.children)) if node.children else (None, None)
            lines[number] = (key[0].as_py(), number, *node.totals, *(node.split or (None, None, None)), *below)
            return number

        add(_grown_here(_bin_columns(table["_bins"], features), g, h, bins, leaves, least_rows))
        kinds = [pa.float64() if name == "gain" else pa.int64() for name in names]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*lines), kinds)], names)

    names = ["node", "number", "g", "h", "n", "gain", "feature", "bin", "low", "high"]
    schema = ", ".join(f"{name} {'double' if name == 'gain' else 'bigint'}" for name in names)
    dealt = rows.select("_g", "_h", "_bins").mapInArrow(numbered, "node bigint, _g bigint, _h bigint, _bins array<smallint>")
    lines = {(r.node, r.number): r for r in dealt.groupBy("node").applyInArrow(grown, schema).collect()}  # bounded by the leaves

    def fill(node: _Node, place: int, number: int) -> _Node:
        line = lines[place, number]
        node.totals = line.g, line.h, line.n
        node.split = None if line.gain is None else (line.gain, line.feature, line.bin)
        if line.low is not None:
            node.children = tuple(fill(_Node((0, 0, 0)), place, k) for k in (line.low, line.high))
        return node

    for place, node in enumerate(nodes):
        fill(node, place, 0)


def _one_tree(rows: DataFrame, count: int, shape: tuple[int, int], leaves: int, least_rows: int) -> _Node:
    if count <= TASK_ROWS:
        _grow_in_tasks(rows, shape, 0, [root := _Node((0, 0, count))], leaves, least_rows)
        return root
    root = _summed(_histograms(rows, shape, 0, 1)[0], least_rows)
    while todo := [node for node in _grown(root, leaves) if node.children is None]:
        large = [node for node in todo if node.totals[2] > TASK_ROWS]
        asked = {id(node): place for place, node in enumerate(large or todo)}
        smaller = {  # whether the right side is
            id(node): 2 * int(node.sums[2, node.split[1], : node.split[2] + 1].sum()) > node.totals[2] for node in large
        }

        def way(node: _Node) -> Any:
            if node.children:
                return (*node.split[1:], *map(way, node.children))
            place = asked.get(id(node))
            if id(node) not in smaller:
                return place
            return (*node.split[1:], None, place) if smaller[id(node)] else (*node.split[1:], place, None)

        if not large:
            _grow_in_tasks(rows, shape, way(root), todo, leaves, least_rows)
            continue
        found = _histograms(rows, shape, way(root), len(large))
        for node, sums in zip(large, found, strict=True):
            both = (node.sums - sums, sums) if smaller[id(node)] else (sums, node.sums - sums)
            node.children = tuple(_summed(own, least_rows) for own in both)
    return root


def _listed(tree: int, root: _Node, leaves: int, features: Sequence[str], limits: list[list[float]], rate: float) -> tuple[list[tuple], Any]:
    """The rows of a tree in :data:`NODES`, and the way to the values of its leaves, by bins."""
    split = {id(node) for node in _grown(root, leaves)}
    out: list[tuple] = []

    def add(node: _Node) -> tuple[int, Any]:
        number, (g, h, n) = len(out), node.totals
        out.append(())
        if id(node) not in split:
            value = -(g / h) * rate
            out[number] = (tree, number, None, None, None, None, value, n, None)
            return number, value
        gain, feature, bin_ = node.split
        (left, low), (right, high) = (add(child) for child in node.children)
        out[number] = (tree, number, features[feature], limits[feature][bin_], left, right, None, n, gain / (1 << DIGITS))
        return number, (feature, bin_, low, high)

    return out, add(root)[1]


def _moved(rows: DataFrame, features: int, way: Any) -> DataFrame:
    """The rows with the values of their leaves added to their scores."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("_score").to_numpy().copy()
            for value, own in _reached(_bin_columns(batch.column("_bins"), features), way, np.arange(batch.num_rows)):
                score[own] += value
            yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("_bins"), pa.array(score)], ["_y", "_bins", "_score"])

    rows = rows.select("_y", "_bins", "_score")
    return rows.mapInArrow(add, rows.schema)


def train_trees(
    labelled: DataFrame, label: str = c.LABEL, features: Sequence[str] = c.FEATURES, rounds: int = 100, leaves: int = 31,
    rate: float = 0.1, least_rows: int = 20, bins: int = 255, key: str = c.CUSTOMER,
) -> DataFrame:
    """The stored table of a model's nodes (:data:`NODES`). Runs at once, a few jobs for each round.

    Missing and infinite features count as 0. Rows without a label have a gradient of 0. Training ends early when no leaf can
    be split. No rows are an error.
    """
    spark = labelled.sparkSession
    clean = sanitize(labelled.select(key, label, *features), tuple(features))
    stored = write_once(clean.withColumnRenamed(label, "_y"), "train")
    n, ones = stored.selectExpr("count(1)", "count_if(_y = 1)").first()
    if not n:
        raise ValueError("No rows to train on")
    share = min(max(ones / n, 1e-15), 1 - 1e-15)
    prior = log(share / (1 - share))
    limits = bin_limits(stored, features, bins, key)
    shape = (len(features), max(len(upper) for upper in limits) + 1)
    nodes = [(0, 0, None, None, None, None, prior, n, None)]
    start = _binned(stored, features, limits).selectExpr("_y", "_bins", f"{prior!r}D AS _score")
    path = new_path(spark, "boost-0")
    start = start.selectExpr("*", *_with_gradient("_score"))
    start.write.parquet(path)
    for tree in range(1, rounds + 1):
        rows = spark.read.schema(start.schema).parquet(path)
        root = _one_tree(rows, n, shape, leaves, least_rows)
        if root.split is None:
            break
        own, way = _listed(tree, root, leaves, features, limits, rate)
        nodes += own
        if tree < rounds:
            before, path = path, new_path(spark, f"boost-{tree}")
            moved = _moved(rows, len(features), way)
            moved.selectExpr("*", *_with_gradient("_score")).write.parquet(path)
            remove_table(spark, before)
    remove_table(spark, path)
    return write_once(spark.createDataFrame(nodes, NODES).coalesce(1), "trees")


def tree_nodes(model: DataFrame) -> dict[int, dict[int, dict]]:
    """Trees by number, nodes by number. Bounded by the model's size."""
    trees: dict[int, dict[int, dict]] = {}
    for row in model.collect():
        trees.setdefault(row.tree, {})[row.node] = row.asDict()
    return dict(sorted(trees.items()))


def log_odds(trees: dict[int, dict[int, dict]]) -> Column:
    """The sum of the leaves that a row reaches, tree after tree. Only the features that the trees test go to Python."""
    names = sorted({node["feature"] for nodes in trees.values() for node in nodes.values() if node["feature"]})

    def way(nodes: dict[int, dict], number: int) -> Any:
        node = nodes[number]
        if node["feature"] is None:
            return node["value"]
        return names.index(node["feature"]), node["threshold"], way(nodes, node["left"]), way(nodes, node["right"])

    ways = [way(nodes, 0) for nodes in trees.values()]
    if not names:
        return F.lit(float(sum(ways)))

    @F.arrow_udf("double")
    def odds(*columns: pa.Array) -> pa.Array:
        values = [column.to_numpy(zero_copy_only=False) for column in columns]
        out = np.zeros(len(values[0]))
        for own_way in ways:
            for value, own in _reached(values, own_way, np.arange(len(out))):
                out[own] += value
        return pa.array(out)

    return odds(*[F.col(name).cast("double") for name in names])


def score_trees(df: DataFrame, model: DataFrame, threshold: float = c.CLASS_THRESHOLD) -> DataFrame:
    """Adds probability and class of a stored model, in place of any that are there."""
    odds = log_odds(tree_nodes(model))
    scored = sanitize(df).drop(c.PROBABILITY, c.PREDICTION).select("*", odds.alias("_odds"))
    scored = scored.selectExpr("* EXCEPT (_odds)", f"1D / (1D + exp(-_odds)) AS {c.PROBABILITY}")
    return scored.selectExpr("*", f"int({c.PROBABILITY} > {threshold}D) AS {c.PREDICTION}")


def save_trees(model: DataFrame, path: str) -> None:
    """Publishes a model as the newest version under ``path``. Readers see the version before it, or this one whole."""
    write_version(model.coalesce(1), path)


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(newest_version(spark, path))
