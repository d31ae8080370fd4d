import hashlib
import math
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest

from returns_risk import constants as c
from returns_risk.operators import evaluate, scoring, shapley
from returns_risk.operators.sampled_shapley import sampled_shapley
from returns_risk.operators.tree_shapley import batch_explainer, leaves_of_tree, tree_shapley
from returns_risk.sources.store import write_once


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_split_is_exact_per_class(spark, n):
    labels = {i: int(i % 10 < 3) for i in range(n)}
    table = write_once(spark.createDataFrame(list(labels.items()), f"{c.CUSTOMER} long, {c.LABEL} int"), "labels")
    got = {r[0] for r in evaluate.stratified_split(table).where("is_test").collect()}
    expected = set()
    for label in (0, 1):
        ids = sorted((i for i in labels if labels[i] == label), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        expected |= set(ids[:int(0.2 * len(ids) + 0.5)])
    assert got == expected


def test_totals_and_distribution(spark):
    schema = f"{c.LABEL} int"
    some = spark.createDataFrame([(0,), (0,), (1,)], schema)
    assert tuple(evaluate.label_totals(some).first()) == (3, 1, 1 / 3 * 100)
    assert [tuple(r) for r in evaluate.label_distribution(some).collect()] == [(0, 2, 2 / 3), (1, 1, 1 / 3)]
    none = spark.createDataFrame([], schema)
    assert tuple(evaluate.label_totals(none).first()) == (0, 0, 0.0)
    assert evaluate.label_distribution(none).collect() == []


def test_report(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 11
    df = spark.createDataFrame(pairs, f"{c.LABEL} int, {c.PREDICTION} int")
    got = {r[0]: tuple(r)[1:] for r in evaluate.classification_report(df).collect()}
    assert got["1"] == (6 / 7, 6 / 8, 12 / 15, 8)
    assert got["0"] == (11 / 13, 11 / 12, 22 / 25, 12)
    assert got["accuracy"] == (0.85, 0.85, 0.85, 20)
    assert got["macro avg"][3] == 20 and got["macro avg"][2] == pytest.approx((0.8 + 0.88) / 2)
    assert got["weighted avg"][1] == pytest.approx(0.85)
    silent = spark.createDataFrame([(0, 0)], df.schema)
    assert {r[0]: tuple(r)[1:4] for r in evaluate.classification_report(silent).collect()}["1"] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("ranges", [1, 9, 50])
def test_auc_counts_won_pairs(spark, ranges):
    rng = random.Random(1)
    data = [(rng.randint(0, 1), rng.randint(0, 60) / 60) for _ in range(400)]
    df = spark.createDataFrame(data, f"{c.LABEL} int, {c.PROBABILITY} double")
    ones, zeros = ([s for label, s in data if label == k] for k in (1, 0))
    won = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert evaluate.roc_auc(df, ranges=ranges).first().roc_auc == pytest.approx(won / len(ones) / len(zeros))
    only = df.where(f"{c.LABEL} = 1")
    assert evaluate.roc_auc(only).first().roc_auc is None


def random_features(spark, n, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        made.append((
            i, rng.randint(1, 9), rng.randint(0, 90), rng.randint(0, 20), rng.random() * 900, rng.random() * 300,
            rng.random(), rng.random(), rng.randint(0, 900), rng.randint(0, 6), rng.randint(0, 4), 0, 0, rng.randint(0, 3),
            rng.randint(0, 2), rng.randint(0, 2), -rng.random(), -rng.random(),
        ))
    return scoring.feature_rows(spark, made)


def exact_phi(value, names):
    """Shapley values of a set function by definition."""
    n, phi = len(names), {}
    for name in names:
        rest = [other for other in names if other != name]
        phi[name] = sum(
            factorial(k) * factorial(n - k - 1) / factorial(n) * (value({*chosen, name}) - value(set(chosen)))
            for k in range(n) for chosen in combinations(rest, k)
        )
    return phi


def test_linear_shapley_by_definition(spark):
    frame = random_features(spark, 25)
    background = shapley.background_sample(frame, 10)
    others = [r.asDict() for r in background.collect()]
    assert len(others) == 10
    rows = shapley.linear_shapley(scoring.linear_score(frame), background).collect()

    def score(row):
        return min(0.95, max(0.05, sum(row[name] * weight for name, weight in c.SCORE_WEIGHTS.items())))

    for row in rows:
        def value(known):
            return sum(score({**other, **{name: row[name] for name in known}}) for other in others) / len(others)

        phi = dict(zip(c.FEATURES, row.phi))
        expected = exact_phi(value, list(c.SCORE_WEIGHTS))
        assert all(phi[name] == pytest.approx(expected.get(name, 0.0), abs=1e-12) for name in c.FEATURES)
        assert row.base + sum(row.phi) == pytest.approx(row[c.PROBABILITY], abs=1e-12)
    long = shapley.by_feature(shapley.linear_shapley(frame, background))
    assert long.count() == 25 * len(c.FEATURES)
    top = shapley.global_importance(shapley.linear_shapley(frame, background)).first()
    means = np.abs([row.phi for row in rows]).mean(axis=0)
    assert top.importance == pytest.approx(means.max()) and top.feature == c.FEATURES[int(means.argmax())]


def test_clipped_means_at_every_place(spark):
    """Also where the score is clipped on either side, for other weights, and with one background row."""
    weights = {"RefundRate_by_Items": 1.3, "Tickets_TypeRefundRequest": -0.6, "TotalUniqueOrders": 0.2, "MinTicketSentimentScore": -0.5}
    frame = random_features(spark, 12, 4)
    for size in (1, 2, 9):
        background = shapley.background_sample(frame, size)
        others = [r.asDict() for r in background.collect()]
        for row in shapley.linear_shapley(frame, background, weights).collect():
            def value(known):
                rows = ({**other, **{name: row[name] for name in known}} for other in others)
                return sum(min(0.95, max(0.05, sum(r[n] * w for n, w in weights.items()))) for r in rows) / len(others)

            expected = exact_phi(value, list(weights))
            assert dict(zip(c.FEATURES, row.phi)) == pytest.approx({n: expected.get(n, 0.0) for n in c.FEATURES}, abs=1e-12)
    with pytest.raises(ValueError, match="sampled_shapley"):
        shapley.linear_shapley(frame, frame, dict.fromkeys(c.FEATURES, 0.1))


def test_sampled_values_come_near_the_exact_ones(spark):
    frame = write_once(random_features(spark, 30), "frame")
    background = write_once(shapley.background_sample(frame, 8), "background")
    names = ("RefundRate_by_Items", "MinTicketSentimentScore", "Tickets_TypeRefundRequest", "TotalPurchaseValue")
    exact = {r[0]: r.phi for r in shapley.linear_shapley(frame, background).collect()}
    seen = {}
    for error in (0.05, 0.01):
        got = sampled_shapley(frame, background, scoring.linear_score, names, error=error, most_pairs=256).collect()
        assert len(got) == 30
        for row in got:
            for phi, spread, expected in zip(row.phi, row.phi_error, exact[row[0]]):
                assert spread <= error or row.pairs == 256
                assert abs(phi - expected) <= 6 * spread + error
            assert row.phi[c.FEATURES.index("TotalPurchaseValue")] == 0
        seen[error] = sum(row.pairs for row in got)
    assert seen[0.01] > seen[0.05] >= 30 * 8


def test_a_scorer_of_any_kind_is_explained(spark):
    """A pandas function of all seventeen features, additive: every draw is then exact but for the background row."""
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def total(values: pd.DataFrame) -> pd.Series:
        return (values * np.arange(1, 18) / 1000).sum(axis=1)

    def scorer(df):
        return df.withColumn(c.PROBABILITY, total(F.struct(*[F.col(n).cast("double") for n in c.FEATURES])))

    frame = write_once(random_features(spark, 6), "frame")
    background = frame.limit(1)
    other = background.first()
    for row in sampled_shapley(frame, background, scorer).collect():
        expected = [(row[n] - other[n]) * k / 1000 for k, n in enumerate(c.FEATURES, 1)]
        assert row.phi == pytest.approx(expected, abs=1e-9) and max(row.phi_error) < 1e-6 and row.pairs == 8
        assert row.base + sum(row.phi) == pytest.approx(sum(row[n] * k / 1000 for k, n in enumerate(c.FEATURES, 1)))


def test_summary_of_attributions(spark):
    frame = random_features(spark, 200)
    explained = shapley.linear_shapley(frame, shapley.background_sample(frame, 10))
    got = {tuple(r)[:3]: r.customers for r in shapley.attribution_summary(explained, 4, 0.02).collect()}
    rows, expected = explained.collect(), {}
    for k, name in enumerate(c.FEATURES):
        values = sorted(r[name] for r in rows)
        limits = [values[math.ceil(q / 4 * 200) - 1] for q in (1, 2, 3)]
        for r in rows:
            key = name, sum(limit < r[name] for limit in limits), math.floor(round(r.phi[k], 8) / 0.02)
            expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_tree_leaves_by_definition():
    def split(feature, threshold, left, right, rows):
        return {"feature": feature, "threshold": threshold, "left": left, "right": right, "rows": rows, "prediction": 0.0}

    def leaf(prediction, rows):
        return {"left": -1, "right": -1, "rows": rows, "prediction": prediction}

    nodes = {
        0: split(0, 0.5, 1, 2, 100), 1: split(1, 0.3, 3, 4, 60), 2: split(0, 0.8, 5, 6, 40),
        3: leaf(1.0, 20), 4: split(2, 0.1, 7, 8, 40), 5: leaf(-2.0, 30), 6: split(1, 0.9, 9, 10, 10),
        7: leaf(0.25, 15), 8: leaf(3.0, 25), 9: leaf(5.0, 4), 10: leaf(-1.0, 6),
    }

    def value(row, known, number=0):
        node = nodes[number]
        if node["left"] < 0:
            return node["prediction"] * 2
        left, right = node["left"], node["right"]
        if node["feature"] in known:
            return value(row, known, left if row[node["feature"]] <= node["threshold"] else right)
        return sum(value(row, known, child) * nodes[child]["rows"] for child in (left, right)) / node["rows"]

    leaves = leaves_of_tree(nodes, 2.0)
    rows = np.random.default_rng(5).random((50, 3))
    got = batch_explainer(leaves)(rows)
    assert sum(leaf_.expected for leaf_ in leaves) == pytest.approx(value(rows[0], set()))
    for row, phi in zip(rows, got):
        expected = exact_phi(lambda known: value(row, known), [0, 1, 2])
        assert phi == pytest.approx([expected[name] for name in range(3)])


def test_trees_save_load_and_explain(spark, tmp_path):
    frame = random_features(spark, 300).selectExpr("*", f"int(RefundRate_by_Items > 0.6) AS {c.LABEL}")
    model = scoring.train_gbt(frame, maxIter=4, maxDepth=3)
    path = str(tmp_path / "model")
    scoring.save_model(model, path)
    scoring.save_model(scoring.train_gbt(frame, maxIter=1, maxDepth=1), path)
    scoring.save_model(model, path)  # the newest counts
    scored = scoring.score_gbt(frame, model)
    again = scoring.score_features(frame, scoring.load_model(path))
    assert scored.columns == again.columns
    assert sorted(scored.collect()) == sorted(again.collect())
    assert scored.where(f"{c.PREDICTION} <> {c.LABEL}").count() < 10
    for row in tree_shapley(scored, model).collect():
        log_odds = np.log(row[c.PROBABILITY] / (1 - row[c.PROBABILITY]))
        assert row.base + sum(row.phi) == pytest.approx(log_odds, abs=1e-6)


def test_deep_trees_are_explained_and_scores_replaced(spark):
    frame = random_features(spark, 300).selectExpr("*", f"int(RefundRate_by_Items + AvgTicketSentimentScore > 0.6) AS {c.LABEL}")
    model = scoring.train_gbt(frame, maxIter=2, maxDepth=12)
    scored = scoring.score_gbt(scoring.linear_score(frame), model)
    assert scored.columns.count(c.PROBABILITY) == 1
    for row in tree_shapley(scored, model).collect():
        log_odds = np.log(row[c.PROBABILITY] / (1 - row[c.PROBABILITY]))
        assert row.base + sum(row.phi) == pytest.approx(log_odds, abs=1e-6)


def test_a_large_background_is_refused(spark):
    frame = scoring.linear_score(random_features(spark, 30))
    with pytest.raises(ValueError, match="background"):
        shapley.linear_shapley(frame, frame.crossJoin(spark.range(400).toDF("copy")))
