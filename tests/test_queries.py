import inspect

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, comparable
from returns_risk.operators import boosting
from returns_risk.plans.oracle_trees import whole_ctes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(name for name in oracle_sql() if not name.startswith("op")))
def test_query_equals_its_sql(spark, duck, name):
    ours = comparable(queries()[name](spark, FOLDER).toPandas())
    theirs = comparable(duck.execute(oracle_sql()[name]).fetch_df())
    assert len(ours) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_exact=True, check_dtype=False)


def test_every_query_has_its_sql():
    corpus = {name for name in queries() if name.startswith("op") or name == "pipeline"}
    assert set(queries()) - set(oracle_sql()) == corpus - set(oracle_sql())


def test_profile_of_the_smallest_tables(spark):
    labelled = queries()["abuse_label"](spark, FOLDER).toPandas()
    assert len(labelled) == 150 and labelled.is_refund_abuser.sum() == 66
    assert [labelled[rule].sum() for rule in ("rule_a", "rule_b", "rule_c")] == [11, 20, 64]
    scored = entry(spark).toPandas()
    assert (scored.Predicted_Probability > 0.5).sum() == 44 and (scored.Predicted_Probability > 0.7).sum() == 11
    assert queries()["roc_auc"](spark, FOLDER).first().roc_auc == pytest.approx(0.9313672438672439, abs=1e-15)
    assert tuple(queries()["dq_dropped"](spark, FOLDER).first()) == (6000, 172, 129)


def test_tree_queries(spark):
    scored = queries()["gbt_scored"](spark, FOLDER).toPandas()
    assert len(scored) == 30 and scored.Predicted_Probability.between(0, 1).all()
    assert queries()["gbt_shapley"](spark, FOLDER).count() == 30 * 17


def test_gbt_scored_trains_the_whole_model(spark, monkeypatch):
    asked = []
    train = boosting.train_trees
    monkeypatch.setattr(boosting, "train_trees", lambda df, **size: (asked.append(size), train(df, **{"rounds": 1, **size}))[1])
    queries()["gbt_scored"](spark, FOLDER)
    assert asked == [{}]  # no smaller size than the operator's own, which the SQL twin has too
    for function in (train, whole_ctes):
        size = inspect.signature(function).parameters
        assert (size["rounds"].default, size["leaves"].default) == (100, 31)
