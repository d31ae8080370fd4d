"""SQL twins of the boosted-tree queries: training unrolled, one common table expression for each split, or as a recursion.

The steps follow the definition, not the operator: sums of every leaf anew at every split, one split at a time, tests on
the feature values, and Shapley values by enumerating all subsets of a path's features.
"""

from __future__ import annotations

from returns_risk import constants as c

_ONE = float(1 << 24)
_GRADIENT = (
    f"floor((1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) - y) * {_ONE}::DOUBLE + 0.5)::BIGINT AS g, "
    f"floor((1.0::DOUBLE / (1.0::DOUBLE + exp(-score))) * (1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)))"
    f" * {_ONE}::DOUBLE + 0.5)::BIGINT AS h"
)
_CELLS = ", ".join(f"{{'feature': {k}, 'x': {name}::DOUBLE}}" for k, name in enumerate(c.FEATURES))

_START = {
    "cells": f"""
    SELECT id, is_test, cell.feature AS feature, cell.x AS x
    FROM (SELECT Simulated_CustomerID AS id, is_test, unnest([{_CELLS}]) AS cell FROM split)""",
    "bins": """
    SELECT feature, x, CASE WHEN kinds <= 255 THEN place - 1 ELSE (below * 255) // total END AS bin
    FROM (SELECT feature, x, row_number() OVER w AS place, sum(n) OVER w - n AS below,
                 count(*) OVER (PARTITION BY feature) AS kinds, sum(n) OVER (PARTITION BY feature) AS total
          FROM (SELECT feature, x, count(*) AS n FROM cells WHERE is_test = 0 GROUP BY ALL)
          WINDOW w AS (PARTITION BY feature ORDER BY x))""",
    "limits": """
    SELECT feature, bin, CASE WHEN (high + next) / 2 < next THEN (high + next) / 2 ELSE high END AS upper
    FROM (SELECT feature, bin, max(x) AS high, lead(min(x)) OVER (PARTITION BY feature ORDER BY bin) AS next
          FROM bins GROUP BY feature, bin)""",
    "binned": "SELECT id, feature, bin FROM cells JOIN bins USING (feature, x) WHERE is_test = 0",
    "prior": "SELECT ln((avg(is_refund_abuser) / (1 - avg(is_refund_abuser)))::DOUBLE) AS value FROM split WHERE is_test = 0",
    "state0": f"""
    SELECT *, {_GRADIENT}
    FROM (SELECT Simulated_CustomerID AS id, is_refund_abuser AS y, is_test, value AS score FROM split, prior)""",
}


def _round(number: int) -> dict[str, str]:
    """One tree: where each row is after each split, the leaves' values, and the conditions on the way to each leaf."""
    steps = {
        f"at{number}_0": f"SELECT id, is_test, 0 AS leaf, g, h FROM state{number - 1}",
        f"path{number}_0": "SELECT 0 AS leaf, 0 AS feature, true AS low, 0.0::DOUBLE AS upper, 1.0::DOUBLE AS share WHERE false",
    }
    for k in range(1, c.TREE_LEAVES):
        at, best, path = f"at{number}_{k - 1}", f"best{number}_{k}", f"path{number}_{k - 1}"
        steps[best] = f"""
        SELECT leaf, feature, bin, upper, nl, n, gl * gl / hl + gr * gr / hr - g * g / h AS gain
        FROM (SELECT leaf, feature, bin, nl, n, n - nl AS nr, gl::DOUBLE AS gl, hl::DOUBLE AS hl, (g - gl)::DOUBLE AS gr,
                     (h - hl)::DOUBLE AS hr, g::DOUBLE AS g, h::DOUBLE AS h
              FROM (SELECT leaf, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
                           sum(g) OVER t AS g, sum(h) OVER t AS h, sum(n) OVER t AS n
                    FROM (SELECT leaf, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n
                          FROM {at} JOIN binned USING (id) GROUP BY leaf, feature, bin)
                    WINDOW w AS (PARTITION BY leaf, feature ORDER BY bin), t AS (PARTITION BY leaf, feature)))
        JOIN limits USING (feature, bin)
        WHERE nl >= 20 AND nr >= 20 AND hl >= {1e-3 * _ONE} AND hr >= {1e-3 * _ONE}
            AND gl * gl / hl + gr * gr / hr - g * g / h > 0
        ORDER BY gain DESC, leaf, feature, bin LIMIT 1"""
        steps[f"at{number}_{k}"] = f"""
        SELECT a.id, a.is_test, CASE WHEN a.leaf = b.leaf AND x > upper THEN {k} ELSE a.leaf END AS leaf, g, h
        FROM {at} a LEFT JOIN {best} b ON true LEFT JOIN cells ON cells.id = a.id AND cells.feature = b.feature"""
        steps[f"path{number}_{k}"] = f"""
        SELECT * FROM {path}
        UNION ALL SELECT {k}, p.feature, low, p.upper, share FROM {path} p JOIN {best} b ON p.leaf = b.leaf
        UNION ALL SELECT leaf, feature, true, upper, nl::DOUBLE / n FROM {best}
        UNION ALL SELECT {k}, feature, false, upper, (n - nl)::DOUBLE / n FROM {best}"""
    last = f"at{number}_{c.TREE_LEAVES - 1}"
    steps[f"value{number}"] = f"""
    SELECT leaf, -(sum(g)::DOUBLE / sum(h)::DOUBLE) * 0.1::DOUBLE AS value FROM {last} WHERE is_test = 0 GROUP BY leaf"""
    steps[f"state{number}"] = f"""
    SELECT *, {_GRADIENT}
    FROM (SELECT s.id, s.y, s.is_test, s.score + value AS score
          FROM state{number - 1} s JOIN {last} a ON a.id = s.id JOIN value{number} USING (leaf))"""
    return steps


def _attribution() -> dict[str, str]:
    rounds, last = range(1, c.TREE_ROUNDS + 1), c.TREE_LEAVES - 1
    paths = " UNION ALL ".join(f"SELECT {r} AS tree, * FROM path{r}_{last}" for r in rounds)
    values = " UNION ALL ".join(f"SELECT {r} AS tree, leaf, value FROM value{r}" for r in rounds)
    chosen = "list_transform(range(1, n + 1), lambda k: CASE WHEN k = j THEN 1.0 WHEN (m >> (k - 1)) & 1 = 1 THEN os[k] ELSE zs[k] END)"
    weight = "(factorial(bit_count(m)::INTEGER) * factorial((n - 1 - bit_count(m))::INTEGER))::DOUBLE / factorial(n::INTEGER)::DOUBLE"
    subsets = f"list_filter(range(0, (1 << n)::BIGINT), lambda m: (m >> (j - 1)) & 1 = 0)"
    return {
        "paths": paths,
        "leaf_values": values,
        "follows": """
        SELECT id, tree, leaf, feature, min(CASE WHEN low THEN x <= upper ELSE x > upper END::INT)::DOUBLE AS o, product(share) AS z
        FROM cells JOIN paths USING (feature) WHERE is_test = 1 GROUP BY id, tree, leaf, feature""",
        "leaf_paths": """
        SELECT id, value, list(feature ORDER BY feature) AS fs, list(o ORDER BY feature) AS os, list(z ORDER BY feature) AS zs, count(*) AS n
        FROM follows JOIN leaf_values USING (tree, leaf) GROUP BY id, tree, leaf, value""",
        "parts": f"""
        SELECT id, fs[j] AS feature, value * (os[j] - zs[j])
            * list_sum(list_transform({subsets}, lambda m: {weight} * list_aggregate({chosen}, 'product'))) AS part
        FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM leaf_paths)""",
        "tree_base": """
        SELECT sum(value * share) + (SELECT value FROM prior) AS base
        FROM (SELECT tree, leaf, value, product(share) AS share FROM paths JOIN leaf_values USING (tree, leaf) GROUP BY ALL)""",
        "tree_phi": """
        SELECT c.id, c.feature, c.x AS value, base, coalesce(sum(part), 0.0) AS phi
        FROM cells c CROSS JOIN tree_base LEFT JOIN parts p ON p.id = c.id AND p.feature = c.feature
        WHERE c.is_test = 1 GROUP BY c.id, c.feature, c.x, base""",
    }


def tree_ctes() -> dict[str, str]:
    """Common table expressions in order, on ``split``. ``tested`` has the test rows with probability and class."""
    steps = dict(_START)
    for number in range(1, c.TREE_ROUNDS + 1):
        steps |= _round(number)
    steps["tested"] = f"""
    SELECT id AS Simulated_CustomerID, y AS is_refund_abuser, 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) AS Predicted_Probability,
           (1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) > 0.5)::INTEGER AS Predicted_Abuser
    FROM state{c.TREE_ROUNDS} WHERE is_test = 1"""
    return steps | _attribution()


def whole_ctes(rounds: int = 100, leaves: int = 31) -> dict[str, str]:
    """Like :func:`tree_ctes`, for as many trees as :func:`boosting.train_trees` grows by default.

    Each step of ``grown`` makes one split or, where there is none or the tree is full, begins the next tree. Rows carry the
    gain and the split of their leaf, found anew in the step after the leaf was made. Training ends where a tree's first
    leaf can't be split.
    """
    return _START | {
        "grown": f"""
    SELECT id, is_test, y, score, g, h, 1 AS tree, 1 AS split, 0 AS leaf, true AS new, 0.0::DOUBLE AS gain, 0 AS feature,
           0.0::DOUBLE AS upper
    FROM state0
    UNION
    (WITH found AS MATERIALIZED (
        SELECT DISTINCT ON (leaf) leaf, feature, upper, gl * gl / hl + gr * gr / hr - g * g / h AS gain
        FROM (SELECT leaf, feature, bin, nl, n - nl AS nr, gl::DOUBLE AS gl, hl::DOUBLE AS hl, (g - gl)::DOUBLE AS gr,
                     (h - hl)::DOUBLE AS hr, g::DOUBLE AS g, h::DOUBLE AS h
              FROM (SELECT leaf, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
                           sum(g) OVER t AS g, sum(h) OVER t AS h, sum(n) OVER t AS n
                    FROM (SELECT leaf, b.feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n
                          FROM grown JOIN binned b USING (id) WHERE new AND tree <= {rounds} GROUP BY leaf, b.feature, bin)
                    WINDOW w AS (PARTITION BY leaf, feature ORDER BY bin), t AS (PARTITION BY leaf, feature)))
        JOIN limits USING (feature, bin)
        WHERE nl >= 20 AND nr >= 20 AND hl >= {1e-3 * _ONE} AND hr >= {1e-3 * _ONE}
            AND gl * gl / hl + gr * gr / hr - g * g / h > 0
        ORDER BY leaf, gain DESC, feature, bin),
    known AS MATERIALIZED (
        SELECT id, is_test, y, score, g, h, tree, split, leaf, CASE WHEN new THEN f.gain ELSE k.gain END AS gain,
               CASE WHEN new THEN f.feature ELSE k.feature END AS feature, CASE WHEN new THEN f.upper ELSE k.upper END AS upper
        FROM grown k LEFT JOIN found f USING (leaf)),
    best AS MATERIALIZED (
        SELECT leaf, feature, upper FROM known WHERE gain > 0 AND split < {leaves} AND tree <= {rounds}
        ORDER BY gain DESC, leaf LIMIT 1),
    leaf_values AS MATERIALIZED (
        SELECT leaf, -(sum(g)::DOUBLE / sum(h)::DOUBLE) * 0.1::DOUBLE AS value
        FROM known WHERE is_test = 0 AND split > 1 GROUP BY leaf)
    SELECT k.id, k.is_test, y, score, g, h, tree, split + 1, CASE WHEN k.leaf = b.leaf AND x > b.upper THEN split ELSE k.leaf END,
           k.leaf = b.leaf, gain, k.feature, k.upper
    FROM known k CROSS JOIN best b JOIN cells ON cells.id = k.id AND cells.feature = b.feature
    UNION ALL
    SELECT id, is_test, y, score, {_GRADIENT}, tree + 1, 1, 0, true, 0.0::DOUBLE, 0, 0.0::DOUBLE
    FROM (SELECT id, is_test, y, score + value AS score, tree
          FROM known JOIN leaf_values USING (leaf) WHERE NOT EXISTS (FROM best)))""",
        "tested": """
    SELECT id AS Simulated_CustomerID, y AS is_refund_abuser, 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) AS Predicted_Probability,
           (1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) > 0.5)::INTEGER AS Predicted_Abuser
    FROM grown WHERE is_test = 1""",
    }


FEATURE_NAMES = "[" + ", ".join(f"'{name}'" for name in c.FEATURES) + "][feature + 1]"
