"""Shapley values: exact for the linear score, and summaries of any attribution."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators.evaluate import seeded_hash
from returns_risk.operators.features import sanitize
from returns_risk.operators.scoring import linear_sum

# Background rows accepted: a few hundred kilobytes in every task.
BACKGROUND_MOST = 10_000
# Weighted features that are explained exactly; the subsets double with each. Beyond: sampled_shapley.
EXACT_MOST = 8
# Accuracy of quantiles: the rank of a limit is off by at most the rows divided by this.
QUANTILE_ROWS = 100_000


def background_sample(df: DataFrame, rows: int = c.BACKGROUND_ROWS, seed: int = c.SEED) -> DataFrame:
    """The comparison rows of an explanation: those with the smallest seeded hash of the customer."""
    return df.orderBy(F.expr(seeded_hash(c.CUSTOMER, seed)), c.CUSTOMER).limit(rows)


def background_rows(background: DataFrame, features: Sequence[str]) -> Column:
    """The background's values of ``features`` as one array of structs, for every row of a query.

    More than ``BACKGROUND_MOST`` rows are refused; that counts them, in a job of its own.
    """
    if background.limit(BACKGROUND_MOST + 1).count() > BACKGROUND_MOST:
        raise ValueError(f"The background has more than {BACKGROUND_MOST} rows; take a sample")
    values = ", ".join(f"double({name}) AS {name}" for name in features)
    return sanitize(background, tuple(features)).agg(F.expr(f"collect_list(struct({values}))")).scalar()


def _below(sums: str, limit: str, steps: int) -> str:
    """SQL text: how many of the ascending ``sums`` are less than ``limit``, by halving."""
    jump = f"{sums}[at + shiftleft(1, step) - 1]"
    return (
        f"aggregate(sequence({steps}, 0, -1), 0, (at, step) -> "
        f"if(at + shiftleft(1, step) <= size({sums}) AND {jump} < {limit}, at + shiftleft(1, step), at))"
    )


def linear_shapley(
    df: DataFrame,
    background: DataFrame,
    weights: Mapping[str, float] = c.SCORE_WEIGHTS,
) -> DataFrame:
    """Exact attribution of the clipped linear score against the rows of ``background``.

    Adds ``base`` (mean background score) and ``phi``, one value per feature in feature order;
    features without weight get 0. For each set of known features the weighted sums of the others over the
    background are sorted once, with their running totals. Where a row's own part reaches the limits of the
    score is then found by halving, so a mean costs the logarithm of the background's rows. The sums travel to
    every task as array values: see :func:`background_rows`. More than ``EXACT_MOST`` weights are refused.
    """
    if len(weights) > EXACT_MOST:
        raise ValueError(f"More than {EXACT_MOST} weights; use sampled_shapley")
    names, (low, high) = list(weights), c.SCORE_RANGE
    subsets = [frozenset(chosen) for size in range(len(names) + 1) for chosen in combinations(names, size)]
    mean = {known: f"_mean{number}" for number, known in enumerate(subsets)}
    partly = [known for known in subsets if 0 < len(known) < len(names)]

    def part(chosen: Iterable[str], row: str = "") -> str:
        return " + ".join(f"{row}{name} * ({float(weights[name])!r}D)" for name in names if name in chosen) or "0D"

    rest = [
        f"array_sort(transform(rows, other -> {part(set(names) - known, 'other.')})) AS s{number}"
        for number, known in enumerate(partly)
    ]
    totals = [
        f"transform(sequence(0, size(s{number})), k -> aggregate(slice(s{number}, 1, k), 0D, (t, v) -> t + v)) AS t{number}"
        for number in range(len(partly))
    ]
    base = f"aggregate(rows, 0D, (t, other) -> t + {linear_sum(weights, lambda name: f'other.{name}')}) / size(rows)"
    sample = (
        background.sparkSession.range(1).select(background_rows(background, names).alias("rows"))
        .selectExpr(f"{base} AS base", *rest).selectExpr("*", *totals)
    )
    columns = ", ".join(sample.columns)
    sample = sample.agg(F.expr(f"first(struct({columns}))")).scalar()

    def mean_score(known: frozenset[str]) -> str:
        """Mean over the background if only the features in ``known`` take the row's own value."""
        if not known:
            return "_sample.base"
        if len(known) == len(names):
            return linear_sum(weights)
        number = partly.index(known)
        return (
            f"({low}D * _from{number} + _own{number} * (_to{number} - _from{number}) + _sample.t{number}[_to{number}]"
            f" - _sample.t{number}[_from{number}] + {high}D * (size(_sample.s{number}) - _to{number})) / size(_sample.s{number})"
        )

    def phi(name: str) -> str:
        terms = [
            f"({mean[known | {name}]} - {mean[known]})"
            f" * {factorial(len(known)) * factorial(len(names) - len(known) - 1)}"
            for known in subsets if name in weights and name not in known
        ]
        return f"({' + '.join(terms)}) / {factorial(len(names))}D" if terms else "0D"

    steps = BACKGROUND_MOST.bit_length()
    own = [f"{part(known)} AS _own{number}" for number, known in enumerate(partly)]
    ends = []
    for number in range(len(partly)):
        ends.append(f"{_below(f'_sample.s{number}', f'{low}D - _own{number}', steps)} AS _from{number}")
        ends.append(f"{_below(f'_sample.s{number}', f'{high}D - _own{number}', steps)} AS _to{number}")
    kept = [f"`{name}`" for name in df.columns]
    return (
        sanitize(df).withColumn("_sample", sample).selectExpr("*", *own).selectExpr("*", *ends)
        .selectExpr(*kept, *[f"{mean_score(known)} AS {column}" for known, column in mean.items()])
        .selectExpr(
            f"* EXCEPT ({', '.join(mean.values())})",
            f"{mean[frozenset()]} AS base",
            f"array({', '.join(map(phi, c.FEATURES))}) AS phi",
        )
    )


def by_feature(explained: DataFrame) -> DataFrame:
    """One row per customer and feature: (customer, feature, value, base, phi)."""
    lines = ", ".join(f"'{name}', double({name}), phi[{position}]" for position, name in enumerate(c.FEATURES))
    return explained.selectExpr(
        c.CUSTOMER, "base", f"stack({len(c.FEATURES)}, {lines}) AS (feature, value, phi)"
    ).select(c.CUSTOMER, "feature", "value", "base", "phi")


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first. One pass, one row of partial sums."""
    means = explained.selectExpr(*[f"avg(abs(phi[{i}])) AS {name}" for i, name in enumerate(c.FEATURES)])
    lines = ", ".join(f"'{name}', {name}" for name in c.FEATURES)
    return means.selectExpr(f"stack({len(c.FEATURES)}, {lines}) AS (feature, importance)").orderBy(
        F.desc("importance"), "feature"
    )


def attribution_summary(explained: DataFrame, ranks: int = 10, width: float = 0.05) -> DataFrame:
    """How attributions lie for low and high values: feature, rank_bin, phi_bin, customers.

    ``rank_bin`` is the tenth (or other share, 0 to ``ranks`` - 1) that a customer's value of the feature falls in: the number
    of limits below it, where limits are the mergeable quantiles of all values (exact while a feature has fewer than
    ``QUANTILE_ROWS`` values, else off by as small a share). ``phi_bin`` is the attribution over ``width``, rounded down
    after eight decimals. Two passes, each one row of partial results or one for each bin.
    """
    shares = ", ".join(f"{k / ranks!r}D" for k in range(1, ranks))
    limits = explained.agg(
        *[F.expr(f"percentile_approx(double({name}), array({shares}), {QUANTILE_ROWS})").alias(name) for name in c.FEATURES]
    )
    limits = limits.agg(F.expr(f"first(struct({', '.join(c.FEATURES)}))")).scalar()
    lines = ", ".join(
        f"'{name}', size(filter(_limits.{name}, limit -> limit < double({name}))), phi[{k}]" for k, name in enumerate(c.FEATURES)
    )
    bins = explained.withColumn("_limits", limits).selectExpr(f"stack({len(c.FEATURES)}, {lines}) AS (feature, rank_bin, phi)")
    return bins.selectExpr("feature", "rank_bin", f"int(floor(round(phi, 8) / {width!r}D)) AS phi_bin").groupBy(
        "feature", "rank_bin", "phi_bin"
    ).agg(F.count("*").alias("customers"))
