"""Token counts with a digest cache.

A text's key is the digest of its content together with the digest of the tokenizer's file and settings. Counts are
stored under this key in a Parquet table that outlives the run. Texts whose key is stored are not encoded; of the others
each distinct text is encoded once and its count appended. Content is normalised only so far that no tokenizer can tell:
null becomes the empty text.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import documents, per_batch, row_id
from returns_risk.sources.store import exists, new_path, write_once

LIMIT = 4096
#: Keys that are sent to every executor (about 100 bytes each). Texts move only if there are more of both kinds: of
#: those to encode, and of those to leave out.
MOST_SENT = 500_000
CACHE = "version string, digest binary, n_tokens bigint"
_loaded: dict[tuple[str, str], object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, and how it is called."""
    return f"{Path(path).suffix[1:]}-plain-{hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]}"


def lengths(path: str, version: str, texts: list[str]) -> list[int]:
    """Tokens of each text: no begin, end or added special tokens, whole texts.

    Loads the file once per worker and version, and only if it is the version that the counts are stored under.
    """
    if (path, version) not in _loaded:
        if (found := tokenizer_version(path)) != version:
            raise ValueError(f"{path} is {found} on this machine, not {version}")
        _loaded.clear()
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path, version] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            _loaded[path, version] = tokenizer
    encoder = _loaded[path, version]
    if path.endswith(".model"):
        return [len(encoder.encode(text, num_threads=1)) for text in texts]
    return [len(encoder.encode(text, add_special_tokens=False)) for text in texts]


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit; other columns are left out.

    ``cache`` is a folder that all executors share; it is made if it isn't there. Null counts as the empty text. Rows
    without an id and repeated rows are counted like others. ``tokenizer`` must lie at the same path on every machine;
    a worker that finds another file there raises. Texts of any length are encoded as a whole.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    rows = docs.selectExpr(
        f"cast({id_col} AS bigint) AS doc_id", f"{row_id(id_col, text_col)} AS rid", f"coalesce({text_col}, '') AS text"
    ).selectExpr("*", "unhex(sha2(text, 256)) AS digest")
    thin = write_once(rows.selectExpr("doc_id", "rid", "cast(octet_length(text) AS bigint) AS n_bytes", "digest"), "token-keys")

    if not exists(spark, cache):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    asked = thin.select("digest").distinct()
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest")
    misses = thin.groupBy("digest").agg(F.min("rid").alias("rid")).join(known, "digest", "left_anti")
    misses = write_once(misses, "token-misses")
    others = write_once(thin.select("rid", "digest").distinct().join(misses, ["rid", "digest"], "left_anti"), "token-others")
    texts = rows.select("rid", "digest", "text")
    if others.limit(MOST_SENT + 1).count() <= MOST_SENT:
        texts = texts.join(F.broadcast(others), ["rid", "digest"], "left_anti")
    elif misses.limit(MOST_SENT + 1).count() <= MOST_SENT:
        texts = texts.join(F.broadcast(misses), ["rid", "digest"], "left_semi")
    else:
        texts = texts.join(misses.hint("shuffle_hash"), ["rid", "digest"])
    counted = per_batch(
        texts.select("digest", "text"),
        lambda digests, texts: {"digest": digests, "n_tokens": lengths(tokenizer, version, texts)},
        "digest binary, n_tokens bigint",
    ).dropDuplicates(["digest"])  # repeated rows with one id and one text
    if misses.limit(1).count():
        counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)

    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).join(asked, "digest", "left_semi")
    stored = write_once(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return thin.join(stored, "digest").selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``. The cache is new for each call, so every call encodes every distinct text."""
    import public_tokenizers

    return count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
