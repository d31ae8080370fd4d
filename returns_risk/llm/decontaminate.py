"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are runs of letters and digits, in lower case. A seed is eight words of a window; a mask says which, and the words
between them are free to differ. The hashes of all seeds of the benchmark are joined with those of all texts. Each hit
lays a benchmark item over a text; the overlap is confirmed if in some ``WINDOW`` neighbouring words of the item at
least ``EQUAL`` are the same as in the text at that place, or in some longer window a smaller share (``LONGER``). Copies
with every third, fourth or fifth word exchanged hold a whole seed of one of the masks; they are confirmed where 24, 16
and 12 of their words lie in a row, and those of a whole item of 16 words or more in any case. A seed alone, 8 equal words,
is enough only for an item of nine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import LANES, documents, row_id, table
from returns_risk.sources.store import write_once

MASKS = ("111101111", "1110111011", "11011011011")
WINDOW, EQUAL = 12, 10
#: Longer windows, and one in how many of their words may differ. Items shorter than a window but not than ``WHOLE`` are
#: one window as a whole.
LONGER, WHOLE = ((16, 4), (24, 3)), 16
#: At most so many rows of two or three numbers (about 60 bytes each) are sent to every executor, more are joined by
#: shuffle: the seeds of the benchmark, and the keys of the texts that hold any.
MOST_SENT = 2_000_000

HASHED = r"transform(filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w))"


def seeds() -> str:
    """SQL: array of the seed hashes that begin at word ``at`` of ``words``, one for each mask; null where one runs over
    the end."""
    parts = []
    for k, mask in enumerate(MASKS):
        taken = ", ".join(f"words[at + {j}]" for j, on in enumerate(mask) if on == "1")
        parts.append(f"CASE WHEN at + {len(mask)} <= size(words) THEN xxhash64({k}, {taken}) END")
    return f"array({', '.join(parts)})"


def seeded(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns``, at and seed of every seed of ``rows``, which have ``words``.

    Places are expanded before their seeds are hashed, so both run in one compiled loop. The outer form keeps Spark from
    testing the expanded array beforehand, which would make it twice.
    """
    least = min(map(len, MASKS))
    places = f"CASE WHEN size(words) >= {least} THEN sequence(0, size(words) - {least}) END"
    placed = rows.selectExpr(*columns, "words", f"explode_outer({places}) AS at")
    return placed.selectExpr(*columns, "at", f"explode({seeds()}) AS seed").where("seed IS NOT NULL")


def _confirmed(words: str, held: str) -> str:
    """SQL: some window of the overlap holds enough equal words; ``words`` of the item, ``held`` by the text there."""

    def most(width: str) -> str:
        sums = f"transform(sequence(0, size(e) - {width}), i -> aggregate(slice(e, i + 1, {width}), 0, (s, v) -> s + v))"
        return f"array_max({sums})"

    width = f"least({WINDOW}, size(e))"
    enough = [f"{most(width)} * {WINDOW} >= {EQUAL} * {width}"]
    for long, one_in in LONGER:
        width = f"least({long}, size(e))"
        enough.append(f"size(e) >= {WHOLE} AND {most(width)} >= {width} - ceil({width} / {one_in})")
    equal = f"zip_with({words}, {held}, (w, h) -> CASE WHEN w = h THEN 1 ELSE 0 END)"
    return f"transform(array({equal}), e -> {' OR '.join(f'({x})' for x in enough)})[0]"


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, sent to every executor if they are few, else joined by shuffle."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs: rid, own (a hash of the document's text), item (a hash of the benchmark text's words); and the
    members of each such class of equal benchmark texts: item, id.

    Each document, item and shift is a row of its own, with the words of that item and as many of the text, so no row
    grows with the number of items that share a passage. Rows without a text and items of fewer than nine words have no
    seeds and match nothing. Equal rows give one result. Items without an id are compared, but aren't members.
    """
    texts = docs.selectExpr(f"{row_id(id_col, text_col)} AS rid", f"xxhash64({text_col}) AS own", f"{text_col} AS text")
    items = benchmark.selectExpr(f"{item_col} AS id", f"{HASHED.format(item_text_col)} AS words")
    items = write_once(items.where("size(words) > 0").selectExpr("xxhash64(words) AS item", "id", "words"), "leak-all")
    members = items.where("id IS NOT NULL").select("item", "id").distinct()
    items = write_once(items.select("item", "words").dropDuplicates(["item"]), "leak-items")
    known = seeded(items.withColumn("n", F.size("words")), "item", "n").selectExpr("seed", "item", "n", "at AS item_at").distinct()
    known = write_once(known, "leak-seeds")

    hits = seeded(texts.selectExpr("rid", "own", f"{HASHED.format('text')} AS words"), "rid", "own")
    hits = hits.join(_sent(known), "seed").selectExpr("rid", "own", "item", "n", "at - item_at AS shift").distinct()
    hits = write_once(hits, "leak-hits")
    texts = texts.join(_sent(hits.select("rid", "own").distinct()), ["rid", "own"], "left_semi")
    texts = texts.dropDuplicates(["rid", "own"]).selectExpr("rid", "own", f"{HASHED.format('text')} AS words")
    held = "transform(sequence(shift, shift + n - 1), p -> get(words, p)) AS held"
    laid = hits.join(texts.hint("shuffle_hash"), ["rid", "own"]).selectExpr("rid", "own", "item", held)
    # an item that many texts hold is dealt out
    laid = laid.withColumn("lane", F.expr(f"cast(pmod(xxhash64(rid, own), {LANES}) AS int)"))
    items = items.selectExpr("item", "words", f"explode(sequence(0, {LANES - 1})) AS lane")
    pairs = laid.join(items, ["item", "lane"]).where(_confirmed("words", "held"))
    return pairs.select("rid", "own", "item").distinct(), members


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents with confirmed overlaps: rid, own (a hash of the text), items (sorted ids of benchmark rows).

    As ``overlaps``. Equal benchmark texts are compared once and all reported; items without an id count with the
    others, but only ids are listed.
    """
    pairs, members = overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
    listed = write_once(pairs, "leak-pairs").join(members, "item", "left").groupBy("rid", "own")
    return listed.agg(F.array_sort(F.collect_set("id")).alias("items"))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without a confirmed overlap, with all their columns.

    The texts stay where they are if at most ``MOST_SENT`` documents go, else they are shuffled to the list of these.
    """
    found = write_once(overlaps(docs, benchmark, id_col, text_col)[0].select("rid", "own").distinct(), "leak-found")
    key = "_".join(["rid", *docs.columns])  # longer than any column's name, so it is free
    found = found.withColumn(key, F.struct("rid", F.coalesce("own", F.lit(0)).alias("own"))).select(key)
    own = F.expr(f"struct({row_id(f'`{id_col}`', f'`{text_col}`')} AS rid, xxhash64(`{text_col}`) AS own)")
    return docs.withColumn(key, own).join(_sent(found), key, "left_anti").drop(key)


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``: doc_id, contaminated, n_items, items (comma-joined ids)."""
    docs = documents(spark, folder)
    found = write_once(contaminated(docs, table(spark, folder, "benchmark")), "leak-found")
    rows = docs.selectExpr("doc_id", f"{row_id()} AS rid", "xxhash64(text) AS own").join(found, ["rid", "own"], "left")
    return rows.selectExpr(
        "doc_id", "items IS NOT NULL AS contaminated", "cast(coalesce(size(items), 0) AS bigint) AS n_items",
        "coalesce(array_join(items, ','), '') AS items",
    )
