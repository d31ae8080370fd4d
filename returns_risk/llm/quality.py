"""Quality rules with risk-controlled thresholds.

Seven scores between 0 and 1, larger is worse, describe a text. A ladder of settings rejects more and more. The good
texts of one half of the labelled rows propose it: the first settings have cutoffs beyond the worst good text, by a
share ``BEYOND`` of what is left up to 1, the later ones the smallest cutoffs that reject at most a share of
``REJECTED`` of them. The other half tests the settings, per stratum (language) and in order. A setting passes if so few of its good
texts are rejected, by any score, that a share of ``risk`` or more would give as few with a probability of at most
``doubt`` / number of strata (exact binomial tail, Bonferroni correction). The last setting before the first that fails
is taken: testing in a fixed order needs no further correction. With probability 1 - ``doubt`` no stratum then loses
more than ``risk`` of its good texts to the scores. A stratum with too few labels to prove anything rejects nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import documents, table
from returns_risk.llm.hashing import window_hashes
from returns_risk.sources.store import write_once

RISK, DOUBT = 0.01, 0.05
WINDOW, SHORT, REPEAT_PERCENT = 8, 20, 30
#: Cutoffs are whole steps of the scores.
STEPS = 400
BEYOND = (1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64)
REJECTED = (0.0, 0.0002, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)
#: More strata than this are refused: their counts come to the driver.
MOST_STRATA = 2000

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same_next",
    "n_top_word",
)
#: Each score as (count, of what), a share.
SCORES = (
    ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"),
    ("n_marks", "word_chars"), ("n_same_next", "n_words"), ("n_top_word", "n_words"),
)
BASE_FAILED = f"(n_words < {SHORT} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more, the first included."""
    if len(words) <= size:
        return 0
    _, kind, times = np.unique(window_hashes(words, size), return_inverse=True, return_counts=True)
    found = times[kind] > 1
    return int((np.convolve(found, np.ones(size, dtype=np.int64)) > 0).sum()) if found.any() else 0


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers named by ``COUNTS``; all 0 for null and for an empty text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda what: len(raw) - len(raw.translate(None, what))
    spaces = without(b" \t\n\x0b\x0c\r")
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    return (
        len(words), len(text) - spaces, without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"!"), sum(map(bytes.__eq__, words, words[1:])), max(tally.values()),
    )


def counted(text):
    """Column: the counts as a struct. Marked as nondeterministic, else filters would run it a second time."""

    @F.pandas_udf(", ".join(f"{name} bigint" for name in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return count.asNondeterministic()(text)


def _step(k: int) -> str:
    """SQL: score ``k`` in whole steps, from 0 to STEPS; 0 where it has no meaning."""
    part, whole = SCORES[k]
    return f"CASE WHEN {whole} > 0 THEN least({STEPS}, {STEPS} * {part} div {whole}) ELSE 0 END"


def tail(n: int, k: int, share: float) -> float:
    """Probability of at most ``k`` rejections among ``n`` at a true share of ``share``."""
    logs = (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(share) + (n - i) * math.log1p(-share)
        for i in range(k + 1)
    )
    return min(1.0, math.fsum(math.exp(x) for x in logs))


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> dict:
    """Per stratum the chosen cutoffs, a list with one step for each score, or None where nothing can be proven.

    ``counts`` has doc_id, stratum and the counts; ``labels`` has doc_id and quality (1: good). Uses every labelled
    row. Labels without an id or a quality are ignored; a document with several labels is good if all say so.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    good = write_once(good.agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"), "quality-good")
    rows = counts.join(good, "doc_id").where(f"NOT {BASE_FAILED}")
    rows = rows.selectExpr(
        "stratum", "pmod(xxhash64(doc_id), 2) = 0 AS fitting", *(f"{_step(k)} AS s{k}" for k in range(len(SCORES)))
    )
    rows = write_once(rows, "quality-labelled")
    strata = [r.stratum for r in rows.select("stratum").distinct().limit(MOST_STRATA + 1).collect()]
    if len(strata) > MOST_STRATA:
        raise ValueError(f"More than {MOST_STRATA} strata have labels")

    pairs = ", ".join(f"struct({k} AS score, s{k} AS step)" for k in range(len(SCORES)))
    seen = rows.where("fitting").selectExpr("stratum", f"inline(array({pairs}))")
    counted_steps = seen.groupBy("stratum", "score", "step").count().collect()  # strata x scores x steps at most
    tables = {s: np.zeros((len(SCORES), STEPS + 1), dtype=np.int64) for s in strata}
    for r in counted_steps:
        tables[r.stratum][r.score, r.step] = r["count"]
    ladders = {}
    for stratum, held in tables.items():
        above = held.sum(axis=1, keepdims=True) - held.cumsum(axis=1)  # good texts beyond each cutoff
        total = int(held[0].sum())
        least = [[int(np.argmax(row <= share * total)) for row in above] for share in REJECTED]
        wider = [[worst + round((STEPS - worst) * share) for worst in least[0]] for share in BEYOND]
        ladders[stratum] = wider + least

    spark = rows.sparkSession
    settings = [(s, level, c) for s, ladder in ladders.items() for level, c in enumerate(ladder)]
    settings = spark.createDataFrame(settings, "of string, level int, cut array<int>")
    rejected = " OR ".join(f"s{k} > cut[{k}]" for k in range(len(SCORES)))
    tested = rows.where("NOT fitting").join(F.broadcast(settings), F.expr("stratum <=> of"))  # bounded by MOST_STRATA
    tested = tested.groupBy("stratum", "level").agg(F.count("*").alias("n"), F.expr(f"count_if({rejected})").alias("k"))
    results = {(r.stratum, r.level): (r.n, r.k) for r in tested.collect()}
    chosen = {}
    for stratum, ladder in ladders.items():
        chosen[stratum] = None
        for level, cut in enumerate(ladder):
            n, k = results.get((stratum, level), (0, 0))
            if n == 0 or tail(n, k, risk) > doubt / len(strata):
                break
            chosen[stratum] = cut
    return chosen


def verdict(rows: DataFrame, chosen: dict) -> DataFrame:
    """Adds base_failed and kept to rows with stratum and the counts."""
    settings = [(s, cut) for s, cut in chosen.items() if cut]
    settings = rows.sparkSession.createDataFrame(settings, "of string, cut array<int>")
    rejected = " OR ".join(f"({_step(k)}) > cut[{k}]" for k in range(len(SCORES)))
    rows = rows.join(F.broadcast(settings), F.expr("stratum <=> of"), "left")
    return rows.selectExpr(
        *rows.columns[:-2], f"{BASE_FAILED} AS base_failed", f"NOT {BASE_FAILED} AND NOT coalesce({rejected}, false) AS kept"
    )


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept; other columns are left out.

    Null and empty texts have counts of 0 and fail the base rules. A null language is a stratum of its own. Without
    labels only the base rules reject. Repeated rows each get the same verdict.
    """
    counts = docs.selectExpr(f"{id_col} AS doc_id", f"{stratum_col} AS stratum", f"{text_col} AS text")
    counts = counts.select("doc_id", "stratum", counted(F.col("text")).alias("c")).select("doc_id", "stratum", "c.*")
    counts = write_once(counts, "quality-counts")
    return verdict(counts, cutoffs(counts, labels)).drop("stratum")


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no others. The texts are counted a second time,
    which costs less than moving them."""
    counts = docs.selectExpr(f"{id_col} AS doc_id", f"{stratum_col} AS stratum", f"{text_col} AS text")
    counts = counts.select("doc_id", "stratum", counted(F.col("text")).alias("c")).select("doc_id", "stratum", "c.*")
    chosen = cutoffs(write_once(counts, "quality-counts"), labels)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(stratum_col).alias("stratum"),
        counted(F.col(text_col)).alias("c"),
    )
    return verdict(whole.select("row", "stratum", "c.*"), chosen).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, with the cutoffs that ``labels`` allow."""
    out = quality(documents(spark, folder), table(spark, folder, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")
