"""Running totals and dense numbers over a whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returns_risk.sources.store import write_once

#: Rows of one run, about: a table is cut into as many runs as it takes, and each is sorted by one task.
RUN_ROWS = 1 << 18
#: Runs that are added up together; their sums are added up once more.
GROUP = 1024


def _runs(df: DataFrame, order: str, ranges: int | None) -> DataFrame:
    """``df`` stored in sorted runs: ``_run`` never falls as ``order`` rises, ``_place`` counts from 0 in each run."""
    if ranges is None:
        ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RUN_ROWS))
    if ranges < 1:
        raise ValueError("ranges must be at least 1")
    runs = df.repartitionByRange(ranges, F.expr(order)).sortWithinPartitions(F.expr(order))
    # The number has the partition above 33 bits and the row's place in it below.
    return write_once(
        runs.withColumn("_id", F.monotonically_increasing_id())
        .selectExpr("* EXCEPT (_id)", "shiftright(_id, 33) AS _run", "_id & ((1L << 33) - 1) AS _place"),
        "runs",
    )


def _before(sums: DataFrame, names: list[str]) -> DataFrame:
    """The sums of all earlier runs, in two levels: within groups of runs, then over the groups."""
    group = f"_run div {GROUP}"
    inside = Window.partitionBy("_group").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 1,024 runs
    sums = sums.selectExpr("*", f"{group} AS _group")
    groups = sums.groupBy("_group").agg(*[F.sum(name).alias(name) for name in names]).select(
        "_group", *[F.coalesce(F.sum(name).over(over), F.lit(0)).alias(f"_over_{name}") for name in names]
    )
    return sums.select(
        "_run", "_group", *[F.coalesce(F.sum(name).over(inside), F.lit(0)).alias(f"_in_{name}") for name in names]
    ).join(groups, "_group").selectExpr("_run", *[f"_in_{name} + _over_{name} AS _before_{name}" for name in names])


def totals_before(df: DataFrame, order: str, totals: Mapping[str, str], ranges: int | None = None) -> DataFrame:
    """Adds, per entry of ``totals``, the sum of its expression over all rows that come before in ``order``.

    ``order`` must be unique and ``df`` cheap to count (a stored table). The table is range-partitioned into sorted runs of
    about ``RUN_ROWS`` rows, or ``ranges`` of them, and stored, at once. Every row gets the total of the runs before its own
    plus a window sum inside the run; the sums of the runs, one row each, are added up in two levels. The limits between
    runs decide only how even the tasks are.
    """
    cut = _runs(df, order, ranges)
    before = "(PARTITION BY _run ORDER BY _place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inside = cut.selectExpr(
        "*", *[f"coalesce(sum({value}) OVER {before}, 0L) AS {name}" for name, value in totals.items()]
    )
    sums = cut.groupBy("_run").agg(*[F.expr(f"sum({value})").alias(name) for name, value in totals.items()])
    return (
        inside.join(_before(sums, list(totals)), "_run")
        .withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in totals})
        .drop("_run", "_place", *[f"_before_{name}" for name in totals])
    )


def dense_index(df: DataFrame, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in ascending ``order``. See :func:`totals_before`; no window is needed."""
    cut = _runs(df, order, ranges)
    offsets = _before(cut.groupBy("_run").agg(F.count("*").alias("n")), ["n"])
    return cut.join(offsets, "_run").withColumn(name, F.expr("_place + _before_n")).drop("_run", "_place", "_before_n")
