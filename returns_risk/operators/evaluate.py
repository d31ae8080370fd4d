"""Split, class counts, classification report and area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returns_risk import constants as c
from returns_risk.operators.ranks import totals_before
from returns_risk.sources.store import write_once


def seeded_hash(key: str = c.CUSTOMER, seed: int = c.SEED) -> str:
    """SQL text: the hash that decides random draws of rows."""
    return f"md5(concat('{seed}:', string({key})))"


def stratified_split(
    df: DataFrame,
    label: str = c.LABEL,
    key: str = c.CUSTOMER,
    fraction: float = c.TEST_FRACTION,
    seed: int = c.SEED,
) -> DataFrame:
    """Adds ``is_test``: in each class exactly round(fraction * n) rows, drawn by a seeded hash.

    A class is never sorted as a whole. Hash prefixes are counted (2 x 65,536 groups at most), the
    prefix that holds the last test row is found, only the rows of that one prefix are ranked, and
    their cut-off hash per class comes back as one row. Reads ``df`` three times: pass a stored table.
    """
    drawn = seeded_hash(key, seed)
    hashed = df.selectExpr(f"{label} = 1 AS _one", f"{drawn} AS _hash").selectExpr(
        "*", "substr(_hash, 1, 4) AS _prefix"
    )
    counted = hashed.groupBy("_one", "_prefix").agg(F.expr("count(1) AS _n")).selectExpr(
        "*",
        "sum(_n) OVER (PARTITION BY _one ORDER BY _prefix) AS _upto",
        f"bigint(round({fraction}D * sum(_n) OVER (PARTITION BY _one))) AS _wanted",
    )
    last_prefix = counted.where("_wanted <= _upto AND _wanted > _upto - _n").selectExpr(
        "_one", "_prefix", "_wanted - _upto + _n AS _place"
    )
    # last_prefix has one row per class.
    ranked = hashed.join(F.broadcast(last_prefix), ["_one", "_prefix"]).selectExpr(
        "*", "row_number() OVER (PARTITION BY _one ORDER BY _hash) AS _rank"
    )
    cuts = ranked.where("_rank = _place").agg(F.expr(
        "struct(max(if(_one, _hash, NULL)) AS one, max(if(_one, NULL, _hash)) AS zero)"
    )).scalar()
    return (
        df.withColumn("_cuts", cuts)
        .selectExpr(
            "* EXCEPT (_cuts)",
            f"coalesce({drawn} <= if({label} = 1, _cuts.one, _cuts.zero), false) AS is_test",
        )
    )


def label_totals(df: DataFrame, label: str = c.LABEL) -> DataFrame:
    """Customers, abusers and their percentage; 0 percent of nobody."""
    return df.selectExpr("count(1) AS total_customers", f"count_if({label} = 1) AS abusers").selectExpr(
        "*", "coalesce(try_divide(double(abusers), total_customers) * 100, 0D) AS percent"
    )


def label_distribution(df: DataFrame, label: str = c.LABEL) -> DataFrame:
    """Count and share of each label value that occurs. One pass, one row of partial sums."""
    return (
        df.selectExpr("count(1) AS _n", f"count_if({label} = 1) AS _ones")
        .selectExpr("_n", f"stack(2, 1, _ones, 0, _n - _ones) AS ({label}, customers)")
        .where("customers > 0")
        .selectExpr(label, "customers", "double(customers) / _n AS share")
        .orderBy(F.desc("customers"), label)
    )


def _ratio(top: str, bottom: str) -> str:
    return f"coalesce(try_divide(double({top}), {bottom}), 0D)"


def classification_report(df: DataFrame, label: str = c.LABEL, prediction: str = c.PREDICTION) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Ratios without a base are 0. The accuracy line holds the accuracy in all three columns. The data
    is read once, into four counts.
    """
    counts = df.selectExpr(
        f"count_if({label} = 1 AND {prediction} = 1) AS n11", f"count_if({label} = 1 AND {prediction} = 0) AS n10",
        f"count_if({label} = 0 AND {prediction} = 1) AS n01", f"count_if({label} = 0 AND {prediction} = 0) AS n00",
    )
    measures = []
    for name, hit, false_alarm, missed in (("0", "n00", "n10", "n01"), ("1", "n11", "n01", "n10")):
        measures += [
            f"{_ratio(hit, f'{hit} + {false_alarm}')} AS p{name}",
            f"{_ratio(hit, f'{hit} + {missed}')} AS r{name}",
            f"{_ratio(f'2 * {hit}', f'2 * {hit} + {false_alarm} + {missed}')} AS f{name}",
            f"{hit} + {missed} AS s{name}",
        ]
    macro = ", ".join(f"({m}0 + {m}1) / 2" for m in "prf")
    weighted = ", ".join(_ratio(f"{m}0 * s0 + {m}1 * s1", "s0 + s1") for m in "prf")
    return counts.selectExpr(f"{_ratio('n11 + n00', 'n11 + n10 + n01 + n00')} AS a", *measures).selectExpr(
        f"""stack(5, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'accuracy', a, a, a, s0 + s1,
                  'macro avg', {macro}, s0 + s1, 'weighted avg', {weighted}, s0 + s1)
            AS (class, precision, recall, f1_score, support)"""
    )


def roc_auc(
    df: DataFrame,
    label: str = c.LABEL,
    score: str = c.PROBABILITY,
    ranges: int | None = None,
) -> DataFrame:
    """Area under the ROC curve, exact, with half weight for ties.

    Stores the counts per score at once. Rows meet by score first, so a score that very many customers share is one row from there on.
    Twice the number of won pairs is summed in whole numbers and divided once.
    """
    by_score = write_once(
        df.groupBy(F.col(score).alias("_score")).agg(
            F.expr(f"count_if({label} = 1) AS _ones"), F.expr(f"count_if({label} = 0) AS _zeros")
        ),
        "scores",
    )
    below = totals_before(by_score, "_score", {"_below": "_zeros"}, ranges)
    won = "CAST(_ones AS decimal(19,0)) * CAST(2 * _below + _zeros AS decimal(19,0))"
    return below.selectExpr(
        f"double(sum({won})) AS _won", "sum(_ones) AS ones", "sum(_zeros) AS zeros"
    ).selectExpr("try_divide(_won, double(ones) * double(zeros) * 2) AS roc_auc", "ones", "zeros")
