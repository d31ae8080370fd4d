import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators import boosting
from returns_risk.operators.tree_patterns import explain_trees
from returns_risk.sources.store import new_path, newest_version, write_once
from test_evaluate import exact_phi, random_features


def labelled(spark, n=400, seed=3):
    return random_features(spark, n, seed).selectExpr(
        "*", f"int(RefundRate_by_Items > 0.5 AND AvgTicketSentimentScore < -0.3 OR TotalItemsReturned > 17) AS {c.LABEL}"
    )


def nodes_of(model):
    return sorted((tuple(r) for r in model.collect()), key=lambda r: r[:2])


def brute_trees(x, y, rounds, leaves, rate=0.1, least=20, bins=255):
    """By definition, one split at a time: every leaf, feature and limit is tried; gradients are whole numbers."""
    one = 1 << 24
    limits = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        below = np.cumsum(counts) - counts
        of = np.arange(len(values)) if len(values) <= bins else below * bins // len(column)
        limits.append([(a + b) / 2 if (a + b) / 2 < b else a for a, b, k, m in zip(values, values[1:], of, of[1:]) if k != m])
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.floor((p - y) * one + 0.5).astype(np.int64), np.floor(p * (1 - p) * one + 0.5).astype(np.int64)
        leaf = np.zeros(len(y), dtype=int)
        for number in range(1, leaves):
            best = (0.0,)
            for own in range(number):
                rows = leaf == own
                for f, cuts in enumerate(limits):
                    for t in cuts:
                        left = rows & (x[:, f] <= t)
                        right = rows & ~left
                        if left.sum() < least or right.sum() < least or min(h[left].sum(), h[right].sum()) < one / 1000:
                            continue
                        gl, hl, gr, hr = (float(v) for v in (g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()))
                        gain = gl * gl / hl + gr * gr / hr - float(g[rows].sum()) ** 2 / float(h[rows].sum())
                        if gain > best[0]:
                            best = gain, own, f, t
            if len(best) == 1:
                break
            _, own, f, t = best
            leaf[(leaf == own) & (x[:, f] > t)] = number
        for own in np.unique(leaf):
            score[leaf == own] += -(float(g[leaf == own].sum()) / float(h[leaf == own].sum())) * rate
        out.append(leaf)
    return score


@pytest.mark.parametrize("bins", [255, 9])
def test_trees_by_definition(spark, bins):
    frame = labelled(spark)
    local = frame.toPandas()
    model = boosting.train_trees(frame, rounds=3, leaves=6, bins=bins)
    scored = {r[c.CUSTOMER]: r[c.PROBABILITY] for r in boosting.score_trees(frame, model).collect()}
    score = brute_trees(local[list(c.FEATURES)].to_numpy(float), local[c.LABEL].to_numpy(), 3, 6, bins=bins)
    for customer, odds in zip(local[c.CUSTOMER], score):
        assert scored[customer] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-12)


def test_equal_trees_however_rows_are_dealt_out(spark):
    frame = write_once(labelled(spark, 900), "labelled")
    models = [nodes_of(boosting.train_trees(frame.repartition(n), rounds=4, leaves=8)) for n in (1, 7, 64)]
    assert models[0] == models[1] == models[2] and max(r[0] for r in models[0]) == 4
    leaves = [r for r in models[0] if r[0] == 1 and r[2] is None]
    assert len(leaves) == 8 and sum(r[7] for r in leaves) == 900 and min(r[7] for r in leaves) >= 20


def test_odd_training_rows(spark):
    frame = labelled(spark, 200)
    with pytest.raises(ValueError, match="No rows"):
        boosting.train_trees(frame.limit(0))
    one_class = boosting.train_trees(frame.withColumn(c.LABEL, frame[c.LABEL] * 0), rounds=3)
    assert len(nodes_of(one_class)) == 1 and boosting.score_trees(frame, one_class).where(f"{c.PREDICTION} <> 0").count() == 0
    flat = frame.selectExpr(c.CUSTOMER, c.LABEL, *[f"0D AS {name}" for name in c.FEATURES])
    assert len(nodes_of(boosting.train_trees(flat, rounds=3))) == 1
    odd = frame.withColumn("TotalPurchaseValue", frame.TotalPurchaseValue * float("nan")).withColumn("AccountAgeDays", frame.AccountAgeDays * None)
    model = boosting.train_trees(odd, rounds=2, leaves=4)
    assert {r[2] for r in nodes_of(model)}.isdisjoint({"TotalPurchaseValue", "AccountAgeDays"})
    assert boosting.score_trees(odd.unionByName(odd), model).where(f"isnan({c.PROBABILITY})").count() == 0


def test_versions_are_seen_whole(spark):
    frame = labelled(spark)
    path = new_path(spark, "published")
    with pytest.raises(FileNotFoundError):
        boosting.load_trees(spark, path)
    first = boosting.train_trees(frame, rounds=1, leaves=3)
    second = boosting.train_trees(frame, rounds=2, leaves=3)
    boosting.save_trees(first, path)
    reader = boosting.load_trees(spark, path)
    boosting.save_trees(second, path)
    assert nodes_of(reader) == nodes_of(first)  # one that began before goes on with the version that it found
    assert nodes_of(boosting.load_trees(spark, path)) == nodes_of(second)
    newest = newest_version(spark, path)
    first.write.parquet(f"{path}/v-999999999999999-crashed")
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v-999999999999999-crashed/_SUCCESS")
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, False)
    assert newest_version(spark, path) == newest


def test_patterns_give_shapley_values(spark, monkeypatch):
    from returns_risk.operators import tree_patterns

    frame = write_once(labelled(spark, 300), "labelled")
    model = boosting.train_trees(frame, rounds=3, leaves=7)
    trees = boosting.tree_nodes(model)

    def value(row, known, nodes, number=0):
        node = nodes[number]
        if node["feature"] is None:
            return node["value"]
        sides = (node["left"], node["right"])
        if node["feature"] in known:
            return value(row, known, nodes, sides[row[node["feature"]] > node["threshold"]])
        return sum(value(row, known, nodes, side) * nodes[side]["rows"] for side in sides) / node["rows"]

    used = sorted({n["feature"] for nodes in trees.values() for n in nodes.values() if n["feature"]})
    assert 2 <= len(used) <= 8
    for bits, sent in ((62, 100_000), (2, 0)):  # also with patterns of several numbers, joined by shuffle
        monkeypatch.setattr(tree_patterns, "BITS", bits)
        monkeypatch.setattr(tree_patterns, "MOST_SENT", sent)
        rows = explain_trees(boosting.score_trees(frame, model), model).collect()
        assert len(rows) == 300
        for row in rows[::25]:
            expected = exact_phi(lambda known: sum(value(row, known, nodes) for nodes in trees.values()), used)
            assert dict(zip(c.FEATURES, row.phi)) == pytest.approx({n: expected.get(n, 0.0) for n in c.FEATURES}, abs=1e-9)
        for row in rows:
            odds = math.log(row[c.PROBABILITY] / (1 - row[c.PROBABILITY]))
            assert row.base + sum(row.phi) == pytest.approx(odds, abs=1e-9)
    lone = explain_trees(frame, model.where("tree = 0")).first()
    assert lone.phi == [0.0] * 17 and lone.base == trees[0][0]["value"]


def test_equal_trees_however_many_rows_a_task_grows_on(spark, monkeypatch):
    frame = write_once(labelled(spark, 900), "labelled")
    models = []
    for most in (1 << 18, 300, 60, 0):  # all in tasks, first levels by sums, all by sums
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        models.append(nodes_of(boosting.train_trees(frame.repartition(5), rounds=3, leaves=12)))
    assert models[0] == models[1] == models[2] == models[3] and max(r[0] for r in models[0]) == 3


def test_rows_without_label_have_no_gradient(spark, monkeypatch):
    frame = labelled(spark, 300).withColumn(c.LABEL, F.expr(f"if({c.CUSTOMER} % 7 = 0, NULL, {c.LABEL})"))
    models = []
    for most in (1 << 18, 0):
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        models.append(nodes_of(boosting.train_trees(frame, rounds=2, leaves=4)))
    assert models[0] == models[1] and sum(r[7] for r in models[0] if r[0] == 1 and r[2] is None) == 300


def test_many_large_trees_are_scored_as_data(spark):
    names = list(c.FEATURES)
    nodes, trees = [(0, 0, None, None, None, None, -0.25, 1, None)], 100
    for tree in range(1, trees + 1):  # a chain of 30 splits: 31 leaves
        for k in range(30):
            limit = (tree * 7 + k * 13) % 40 / 8 - 1
            nodes.append((tree, 2 * k, names[(tree + k) % 17], limit, 2 * k + 1, 2 * k + 2, None, 1, 1.0))
            nodes.append((tree, 2 * k + 1, None, None, None, None, (k - tree % 29) / 1000, 1, None))
        nodes.append((tree, 60, None, None, None, None, 0.03, 1, None))
    model = spark.createDataFrame(nodes, boosting.NODES)
    frame = write_once(labelled(spark, 60), "labelled")
    plan = boosting.score_trees(frame, model)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 50_000  # the trees aren't a part of the plan
    local = {row[c.CUSTOMER]: row for row in frame.collect()}
    by_tree = boosting.tree_nodes(model)
    for row in boosting.score_trees(frame, model).collect():
        odds = 0.0
        for own in by_tree.values():
            node = own[0]
            while node["feature"]:
                node = own[node["left" if local[row[c.CUSTOMER]][node["feature"]] <= node["threshold"] else "right"]]
            odds += node["value"]
        assert row[c.PROBABILITY] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-14)
