"""What several operators share: tables, words, row keys, Arrow batches, links to groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from returns_risk.sources.store import write_once

#: Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return.
WORDS = r"filter(split({0}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"

#: Rows without an id get one from their text, above all ids in use.
FIRST_OWN_ID = 1 << 62

#: Ways that the rows of one key are dealt out in joins on keys that may be hot.
LANES = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def row_id(id_col: str = "doc_id", text_col: str = "text") -> str:
    """SQL for a key that is never null: the id, or for rows without one a number made from the text."""
    own = f"{FIRST_OWN_ID} + (xxhash64({text_col}) & {(1 << 61) - 1})"
    return f"coalesce(cast({id_col} AS bigint), {own})"


def named_id(key: str) -> str:
    """SQL that turns a ``row_id`` back: null where the row had no id."""
    return f"CASE WHEN {key} < {FIRST_OWN_ID} THEN {key} END"


def per_batch(df: DataFrame, function: Callable[..., dict], schema: str) -> DataFrame:
    """Runs ``function`` in Python on every Arrow batch.

    It gets each column of ``df`` as a list and returns a dict with a list for each column of ``schema``.
    """
    names, out = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(*(batch.column(name).to_pylist() for name in names))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def groups(links: DataFrame, name: str) -> DataFrame:
    """Columns ``node`` and ``label``, the smallest node that can be reached, of all nodes in ``links`` (a, b).

    Alternates two steps until nothing changes: every node hands the smallest of its neighbours to its larger
    neighbours, then every node hands it to its smaller ones. The number of rounds grows with the logarithm of
    the longest chain. Each round is a written table; a node with many neighbours is dealt over ``LANES`` keys.
    """

    def handed(pairs: DataFrame, low: DataFrame) -> DataFrame:
        low = low.selectExpr("x", "low", f"explode(sequence(0, {LANES - 1})) AS lane")
        return pairs.selectExpr("x", "y", f"cast(pmod(xxhash64(y), {LANES}) AS int) AS lane").join(low, ["x", "lane"])

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.selectExpr("count(*)", "sum(cast(xxhash64(x, y) AS decimal(38, 0)))").first())

    edges = write_once(
        links.where("a <> b").selectExpr("greatest(a, b) AS x", "least(a, b) AS y").distinct(), f"{name}-edges"
    )
    before, now = None, mark(edges)
    while now != before:
        both = edges.selectExpr("inline(array(struct(x, y), struct(y AS x, x AS y)))")
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("low"))
        down = handed(both.where("y > x"), low).selectExpr("y AS x", "low AS y").distinct()
        low = down.groupBy("x").agg(F.min("y").alias("low"))
        edges = handed(down, low).selectExpr("inline(array(struct(x, low AS y), struct(y AS x, low AS y)))")
        edges = write_once(edges.where("x <> y").distinct(), f"{name}-edges")
        before, now = now, mark(edges)
    return edges.selectExpr("inline(array(struct(x AS node, y AS label), struct(y AS node, y AS label)))").distinct()
