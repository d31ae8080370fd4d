"""Mixing sources to target weights.

The words of each source, document after document in a pseudorandom order, are packed into blocks of fixed length. The
targets in words give the number of slots of each source. Every output shard draws its source counts from a multinomial
distribution over the slots that are left, so each shard is random and all together meet the targets. A source's slots
are numbered through; slot j takes block j modulo the number of blocks, mapped by a pseudorandom permutation of the
block numbers (a keyed Feistel network, another key each time round). Slots and blocks are joined by number. A source's
last slot takes only the first words of its block, as many as the target leaves over, so that sources smaller than a
block also get their share.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from returns_risk.llm.common import WORDS, documents, row_id
from returns_risk.llm.hashing import mixed
from returns_risk.sources.store import write_once

WEIGHTS, MOST_TIMES, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 128, 64, 11
#: Parts of a source in which the running totals are taken; slots that one row is expanded to at a time.
PARTS, CHUNK = 4096, 4096
#: Slots that one task numbers and maps. Their rows are small before they are expanded, so their bytes tell nothing.
TASK = 1 << 20
#: More sources than this are refused: their sizes and draws come to the driver.
MOST_SOURCES = 10_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> list[Fraction]:
    """Shares of all words by weight (repeating), at most ``most_times`` a source's size; the excess is shared again."""
    weigh = [weights[k % len(weights)] for k in range(len(sizes))]
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weigh[k] for k in open_)
        shares = {k: left * weigh[k] / total for k in open_}
        above = {k for k in open_ if shares[k] > most_times * sizes[k]}
        if not above:
            for k in open_:
                out[k] = shares[k]
            break
        for k in above:
            out[k] = Fraction(most_times * sizes[k])
            left -= out[k]
        open_ -= above
    return out


def draws(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard, (shards, sources): multinomial draws over what is left."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for shard in range(shards):
        todo = int(left.sum()) // (shards - shard)
        while todo:
            drawn = np.minimum(rng.multinomial(todo, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            todo -= int(drawn.sum())
    return out


def permuted(place: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 applied to ``place``, one for each ``key``."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low, out = np.uint64((1 << int(half)) - 1), place.astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():  # values beyond n go on along their cycle, four steps at most on average
        left, right, keys = out[walking] >> half, out[walking] & low, key[walking]
        for turn in range(4):
            left, right = right, left ^ (mixed(right + keys + np.uint64(turn)) & low)
        out[walking] = (left << half) | right
        walking = out >= n
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _block_of(slot: pd.Series, blocks: pd.Series, source: pd.Series) -> pd.Series:
    turn = slot // blocks
    key = mixed(mixed(source.to_numpy().astype(np.uint64) + np.uint64(SEED)) + turn.to_numpy().astype(np.uint64))
    out = np.empty(len(slot), dtype=np.int64)
    for n in blocks.unique():
        rows = (blocks == n).to_numpy()
        out[rows] = permuted((slot - turn * blocks).to_numpy()[rows], int(n), key[rows])
    return pd.Series(out)


def _plan(sized: DataFrame, weights: tuple, most_times: int, block: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The sources (source, sid, source_size, target), and the slots (sid, shard, slot, block, words)."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"More than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    wanted = targets(sizes, weights, most_times)
    blocks = [-(-n // block) for n in sizes]
    exact = [w * b / n if n else Fraction(0) for w, b, n in zip(wanted, blocks, sizes, strict=True)]
    slots = [-(-e.numerator // e.denominator) for e in exact]
    sources = spark.createDataFrame(
        [(r.source, k, r.n, float(w)) for k, (r, w) in enumerate(zip(rows, wanted, strict=True))],
        "source string, sid int, source_size bigint, target double",
    )
    drawn = draws(slots, shards)
    first = drawn.cumsum(axis=0) - drawn
    drawn = [
        (sid, shard, int(first[shard, sid]), int(drawn[shard, sid]), blocks[sid], sizes[sid], slots[sid], float(exact[sid] - slots[sid] + 1))
        for shard, sid in zip(*np.nonzero(drawn), strict=True)
    ]
    drawn = [(int(a), int(b), *more) for a, b, *more in drawn]
    drawn = spark.createDataFrame(
        drawn, "sid int, shard int, first bigint, n bigint, blocks bigint, source_size bigint, slots bigint, last double"
    )
    chunks = drawn.selectExpr("*", f"explode(sequence(0L, n - 1, {CHUNK}L)) AS start")
    chunks = chunks.repartition(max(1, -(-sum(slots) // TASK)), "sid", "shard", "start")
    last = f"least(start + {CHUNK}, n) - 1"
    slots = chunks.selectExpr(
        "sid", "shard", "blocks", "source_size", "slots", "last", f"explode(sequence(first + start, first + {last})) AS slot"
    ).withColumn("block", _block_of("slot", "blocks", "sid"))
    words = f"least({block}, source_size - block * {block})"
    return sources, slots.selectExpr(
        "sid", "shard", "slot", "block", f"if(slot < slots - 1, {words}, cast(floor(last * ({words}) + 0.5D) AS bigint)) AS words",
        "slot = slots - 1 AS cut",
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.selectExpr(
        f"cast({id_col} AS bigint) AS doc_id", f"{row_id(id_col, text_col)} AS rid", f"{source_col} AS source",
        f"cast(coalesce(regexp_count({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) AS bigint) AS size",
    )
    return write_once(rows, "mix-sizes")


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid, source_size, target and ``at``, the document's first word in its source. Two levels of totals: parts
    of a source, then documents of a part, so no task holds a whole source."""
    rows = sized.join(F.broadcast(sources.withColumnRenamed("source", "of")), F.expr("source <=> of")).drop("of")
    rows = rows.selectExpr("*", "xxhash64(rid, 23) AS h").selectExpr("*", f"pmod(h, {PARTS}) AS part")
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("h", "rid", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(parts, ["sid", "part"]).withColumn("at", F.expr("base + inside")).drop("base", "inside", "part", "h")


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, most_times: int = MOST_TIMES, block: int = BLOCK, shards: int = SHARDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and nothing taken. Rows without a source are a source of their own, the last.
    Repeated rows are packed one by one. Other columns are left out. Reruns agree.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    sources, slots = _plan(sized, weights, most_times, block, shards)
    placed = write_once(_placed(sized, sources), "mix-placed")
    # At most one slot of a source is cut.
    times = slots.groupBy("sid", "block").agg(F.expr("count_if(NOT cut) AS times"), F.expr("coalesce(max(if(cut, words, 0L)), 0L) AS some"))
    pieces = placed.where("size > 0").selectExpr("sid", "at", "size", f"explode(sequence(at div {block}, (at + size - 1) div {block})) AS block")
    start, end = f"greatest(at, block * {block})", f"least(at + size, (block + 1) * {block})"
    words = f"({end} - {start}) * times + greatest(least({end}, block * {block} + some) - {start}, 0L)"
    taken = pieces.join(times, ["sid", "block"]).groupBy("sid", "at").agg(F.expr(f"sum({words})").alias("taken"))
    out = placed.join(taken.withColumn("any", F.lit(True)), F.expr("any = (size > 0)") & (placed.sid == taken.sid) & (placed["at"] == taken["at"]), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.expr("coalesce(taken, 0L)").alias("taken"))


def mixed_blocks(
    docs: DataFrame, weights: tuple = WEIGHTS, most_times: int = MOST_TIMES, block: int = BLOCK, shards: int = SHARDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: shard, slot, source, block, words (an array of 1 to ``block``). Arguments as for ``mix``."""
    sized = _sized(docs, id_col, text_col, source_col)
    sources, slots = _plan(sized, weights, most_times, block, shards)
    texts = docs.selectExpr(f"{row_id(id_col, text_col)} AS rid", f"{source_col} AS source", f"{WORDS.format(text_col)} AS words")
    placed = write_once(_placed(sized, sources).where("size > 0"), "mix-placed")
    one = Window.partitionBy("rid", "source").orderBy("at")
    placed = placed.withColumn("copy", F.row_number().over(one))
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("rid", "source").orderBy(F.expr("size(words)"))))
    rows = texts.alias("t").join(placed.alias("p"), F.expr("t.rid = p.rid AND t.source <=> p.source AND t.copy = p.copy"))
    rows = rows.selectExpr("sid", "p.source AS source", "at", "words", f"explode(sequence(at div {block}, (at + p.size - 1) div {block})) AS block")
    start = f"greatest(at, block * {block}) - at"
    rows = rows.selectExpr(
        "sid", "source", "block", "at",
        f"slice(words, cast({start} + 1 AS int), cast(least(size(words), (block + 1) * {block} - at) - ({start}) AS int)) AS words",
    )
    packed = rows.groupBy("sid", "source", "block").agg(F.expr("flatten(transform(array_sort(collect_list(struct(at, words))), p -> p.words)) AS words"))
    slots = slots.where("words > 0").withColumnRenamed("words", "most")
    return slots.join(packed, ["sid", "block"]).selectExpr("shard", "slot", "source", "block", "slice(words, 1, int(most)) AS words")


def op4_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, weights 5, 2, 1, at most three times a source."""
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "source")
