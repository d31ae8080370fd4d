"""MinHash near-duplicates with odd sketches.

A document is the set of its word shingles. Sets are equal, linked (Jaccard similarity of at least ``percent``)
or apart. The steps:

1. One Python pass makes of every text its set's digest, MinHash bands and an odd sketch: the MinHash samples are
   hashed into a bitmap in which each sample flips one bit. The XOR of two bitmaps has few set bits for similar sets,
   and its population count gives the similarity.
2. Equal sets become one node, the smallest id. Exact copies cost nothing from here on.
3. Nodes that share a band key are a bucket. Each member is paired with the smallest member of the bucket only, so
   a bucket gives as many pairs as it has members.
4. Pairs whose sketches are near enough are confirmed on the full sets. Links give groups.
5. Where several groups meet in a bucket, the members of the smaller ones are compared with the largest, and with each
   other, first by sketch and then by set. Buckets with more than ``DENSE`` such members are first split by a second
   band that pairs must share too, and by a third; what is then still dense is compared as it is.

Two sets with a similarity of 0.8 share no band with a probability of 5e-9 and fail the sketch test with about 1e-9.
Where all bands that a pair shares are dense (step 5), one or two shared bands are not enough for a comparison: such a
pair is missed with about 1.5e-6, unless other links join its groups.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import documents, groups, named_id, per_batch, row_id
from returns_risk.llm.hashing import mixed, window_hashes
from returns_risk.sources.store import write_once

BANDS, ROWS, BITS = 48, 5, 1024
SAMPLES = BANDS * ROWS
#: How far below the threshold a sketch's estimate may lie: six standard deviations of 240 samples.
MARGIN = 0.16
DENSE = 4000

_draw = np.random.default_rng(20240229)
_SEEDS = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SAMPLE_TAGS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_BAND_TAGS = _draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: ``words`` words each, A-Z lower-cased.

    A text with fewer words is one shingle as a whole; one without words, or null, is the empty set.
    """
    # bytes: only A-Z change, and only the six ASCII spaces divide
    return np.unique(window_hashes((text or "").encode().lower().split(), words))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), 512):
        block = short[start : start + 512, None] ^ _SEEDS
        block *= _ODD
        np.minimum(low, block.min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One number for each band, from its rows and its place."""
    rows, key = low.astype(np.uint64).reshape(BANDS, ROWS), _BAND_TAGS
    for k in range(ROWS):
        key = mixed(key + rows[:, k])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Bitmap in which every sample, with its place, flips one bit."""
    bit = (mixed(low.astype(np.uint64) + _SAMPLE_TAGS) >> np.uint64(54)).astype(np.int64)  # the top ten: BITS
    flipped = np.bincount(bit, minlength=BITS).astype(np.uint8) & 1
    return np.packbits(flipped).view(np.int64)


def most_differing_bits(percent: int) -> int:
    """Population count of the XOR that the sketches of a pair at the threshold stay below."""
    apart = 2 * SAMPLES * (1 - percent / 100 + MARGIN)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * apart / BITS)))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per document (rid, text): set size, digest, band keys, odd sketch; null for an empty set."""

    def sign(rids: list, texts: list) -> dict:
        out = {"rid": rids, "n_shingles": [], "digest": [], "bands": [], "sketch": []}
        for text in texts:
            found = shingle_set(text, words)
            out["n_shingles"].append(len(found))
            if len(found):
                low = minima(found)
                out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()))
                out["bands"].append(band_keys(low))
                out["sketch"].append(odd_sketch(low))
            else:
                for name in ("digest", "bands", "sketch"):
                    out[name].append(None)
        return out

    schema = "rid bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>"
    return per_batch(docs, sign, schema)


def _near(percent: int, x: str, y: str) -> str:
    """SQL: the sizes allow the similarity, and the odd sketches are near enough."""
    differing = " + ".join(f"bit_count({x}.sketch[{k}] ^ {y}.sketch[{k}])" for k in range(BITS // 64))
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {percent} * greatest({x}.n_shingles, {y}.n_shingles)"
    return f"{sizes} AND {differing} <= {most_differing_bits(percent)}"


def _linked(percent: int, x: str, y: str) -> str:
    """SQL: the full sets reach the similarity."""
    shared = f"size(array_intersect({x}.found, {y}.found))"
    return f"{100 + percent}L * {shared} >= {percent}L * (size({x}.found) + size({y}.found))"


def _to_hubs(members: DataFrame, nodes: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members of buckets and their hubs."""
    pairs = members.where("node <> hub").selectExpr("hub AS a", "node AS b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(nodes.selectExpr(f"node AS {side}", f"struct(n_shingles, sketch) AS of_{side}"), side)
    pairs = write_once(pairs.where(_near(percent, "of_a", "of_b")).select("a", "b"), "near-pairs")
    for side in ("a", "b"):
        pairs = pairs.join(about.selectExpr(f"node AS {side}", f"struct(found) AS of_{side}"), side)
    return pairs.where(_linked(percent, "of_a", "of_b")).select("a", "b").distinct()


def _across(members: DataFrame, nodes: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups that meet in a bucket: members (key, node, label).

    The label with the most members in a bucket is its main one, the members of others are its strays. A stray is
    compared with all nodes of the main label, once however many buckets they share, and with the strays of other
    labels. Sketches and sets are compared inside the join, so only links leave it. A label of many nodes is dealt out
    by its measured size.
    """
    held = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    held = held.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    held = write_once(held.where("labels > 1").selectExpr("key", "top.label AS main"), "near-mixed")
    strays = write_once(members.join(held, "key").where("label <> main"), "near-strays")

    owners = strays.selectExpr("main AS label").distinct()
    owned = members.select("node", "label").distinct().join(owners, "label")
    lanes = owned.groupBy("label").agg(F.expr(f"cast(1 + count(*) div {DENSE} AS int) AS lanes"))
    lanes = write_once(lanes, "near-lanes")
    owned = owned.join(lanes, "label").selectExpr("label AS main", "node", "pmod(xxhash64(node), lanes) AS lane")
    asked = strays.select("node", "main").distinct().join(lanes.withColumnRenamed("label", "main"), "main")
    asked = asked.selectExpr("main", "node", "explode(sequence(0L, lanes - 1L)) AS lane")
    x = write_once(asked.join(about, "node"), "near-asked").alias("x")
    y = write_once(owned.join(about, "node"), "near-owned").alias("y")
    on = f"x.main = y.main AND x.lane = y.lane AND {_near(percent, 'x', 'y')} AND {_linked(percent, 'x', 'y')}"
    links = [x.join(y, F.expr(on)).selectExpr("x.node AS a", "y.node AS b")]

    def several(rows: DataFrame, name: str) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("top"), F.count("*").alias("n"))
        keys = write_once(keys.where("low < top").select("key", "n"), f"{name}-keys")
        return write_once(rows.join(keys, "key"), name)

    rows = several(strays.selectExpr("key", "node", "label", "array(key) AS used"), "near-several")
    for last in (False, False, True):
        part = rows if last else rows.where(f"n <= {DENSE}")
        part = write_once(part.select("key", "node", "label").join(about, "node"), "near-sides")
        x, y = part.alias("x"), part.alias("y")
        on = "x.key = y.key AND x.node < y.node AND x.label <> y.label"
        on = f"{on} AND {_near(percent, 'x', 'y')} AND {_linked(percent, 'x', 'y')}"
        links.append(x.join(y, F.expr(on)).selectExpr("x.node AS a", "y.node AS b"))
        dense = rows.where(f"n > {DENSE}")
        if last or dense.isEmpty():
            break
        dense = dense.select("node", "label", "used").join(nodes.select("node", "bands"), "node")
        dense = dense.selectExpr("node", "label", "used", "explode(array_except(bands, used)) AS more")
        dense = dense.selectExpr("node", "label", "array_sort(concat(used, array(more))) AS used")
        rows = several(dense.selectExpr("xxhash64(used) AS key", "node", "label", "used").distinct(), "near-finer")
    return reduce(DataFrame.unionByName, links).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``rid``, doc_id, n_shingles, component_id (the smallest id reachable), kept.

    Any other column of ``docs`` is left out, whatever its name. A null or empty text has the empty set and is linked
    with nothing; it is its own component and kept. Rows without an id take part: they join the group of their text,
    are kept only if nothing in the group has an id, and then all have a null component. Rows that share an id count
    as one document with the links of each of them. Tables without rows give a result without rows.
    """
    docs = docs.selectExpr(f"{row_id(id_col, text_col)} AS rid", f"{text_col} AS text")
    signed = write_once(signatures(docs, words), "near-signatures")
    full = signed.where("digest IS NOT NULL").selectExpr("digest", "rid", "n_shingles", "bands", "sketch")
    some = [F.any_value(name).alias(name) for name in ("n_shingles", "bands", "sketch")]
    nodes = write_once(full.groupBy("digest").agg(F.min("rid").alias("node"), *some), "near-nodes")

    dealt = nodes.selectExpr("explode(bands) AS key", "node")
    buckets = dealt.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = write_once(buckets.select("key", "hub"), "near-buckets")
    members = write_once(dealt.join(buckets, "key"), "near-members")

    wanted = members.selectExpr("node AS rid").distinct()
    found = per_batch(
        docs.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text"),
        lambda rids, texts: {"node": rids, "found": [shingle_set(t, words).view(np.int64) for t in texts]},
        "node bigint, found array<bigint>",
    )
    about = write_once(found.join(nodes.select("node", "n_shingles", "sketch"), "node"), "near-sets")

    links = write_once(_to_hubs(members, nodes, about, percent), "near-links")
    labels = write_once(groups(links, "near-first"), "near-labels")
    members = members.join(labels, "node", "left").selectExpr("key", "node", "coalesce(label, node) AS label")
    more = _across(write_once(members, "near-labelled"), nodes, about, percent)
    labels = groups(labels.selectExpr("node AS a", "label AS b").unionByName(more), "near-last")
    labels = nodes.select("digest", "node").join(labels, "node", "left")
    labels = write_once(labels.selectExpr("digest", "coalesce(label, node) AS label"), "near-classes")
    out = signed.select("rid", "n_shingles", "digest").join(labels, "digest", "left")
    out = out.selectExpr("rid", "n_shingles", "coalesce(label, rid) AS label")
    return out.selectExpr(
        "rid",
        f"{named_id('rid')} AS doc_id",
        "n_shingles",
        f"{named_id('label')} AS component_id",
        "rid = label AS kept",
    )


def one_of_each(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group, all its columns: the smallest id. Repeated rows become one."""
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("kept").select("rid").distinct()
    kept = write_once(kept, "near-kept")
    key = "_".join(["rid", *docs.columns])  # longer than any column's name, so it is free
    keyed = docs.withColumn(key, F.expr(row_id(f"`{id_col}`", f"`{text_col}`")))
    keyed = keyed.join(kept.withColumnRenamed("rid", key).hint("shuffle_hash"), key)
    return keyed.dropDuplicates([key]).select(*(f"`{c}`" for c in docs.columns))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``: two-word shingles, similarity of 0.8 or more."""
    return near_duplicates(documents(spark, folder), words=2, percent=80).drop("rid")
