"""Packing documents into sequences of fixed length: exact complements first, then best fit.

Documents become token ids with an end mark, longer ones are cut, and the pieces are stored with a number that runs
through the pieces of one length that one task wrote. Only the number of pieces of each length, at most as many rows
as a sequence has tokens, goes to the driver. There the fill is planned by lengths: for the longest length left, a
single, pair or triple of lengths is looked up whose sum is exactly the gap, and as many sequences are filled that way
as all its lengths last; only gaps without such a complement take the longest length that fits, and go on with what is
left. Every such step uses a length up, so the plan has at most a few rows for each length, whatever the number of
documents. A piece finds its place from its length and its number among the pieces of that length; no piece meets
another one.

Null texts are empty ones and give the end mark alone. Repeated rows and rows without an id are packed like others.
Texts may be of any length. Other columns are left out; no documents give no pieces.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returns_risk.llm.common import documents
from returns_risk.sources.store import write_once

LENGTH, END = 2048, 0
#: Words that a Python worker remembers in each of two generations; pieces in one Arrow batch.
REMEMBERED, PIECES = 500_000, 2_000
#: Letters of Latin-1, and marks, that need nothing of a normaliser but lower case.
PLAIN, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?"
#: Byte-level vocabularies write a byte that is no visible character of Latin-1 as the next free one after it.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTES = {b: 256 + k for k, b in enumerate(_HIDDEN)}
_PIECE = "part int, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
_encoders: dict[str, object] = {}


def _splits_at_space(tokenizer: Path) -> bool:
    """True if no token, and no step before tokens, looks across white space: the encoding of a text is then that of its
    words, one after the other. Known for one form of normaliser and splitter only."""
    config = json.loads(tokenizer.read_text())
    normalizers = (config["normalizer"] or {}).get("normalizers", [])
    splitters = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    added = [t for t in config["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() or c in MARKS for c in t["content"])]
    return (
        config["model"]["type"] == "BPE" and not added and config["post_processor"] is None
        and [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and (normalizers[1]["pattern"], normalizers[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in splitters] == ["Split", "ByteLevel"]
        and splitters[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (splitters[0]["behavior"], splitters[0]["invert"]) == ("Removed", True)
        and not splitters[1]["add_prefix_space"] and not splitters[1]["use_regex"]
    )


class Words(dict):
    """Ids of words between white space, as bytes. Two generations keep memory bounded and frequent words known."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}
        self.model._resize_cache(0)  # words that come again are remembered here

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            text = word.decode()
            if PLAIN.fullmatch(text):  # lower case is all that the normaliser does to these, and they are one word
                ids = as_bytes([t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(BYTES))])
            elif text[-1] in MARKS and PLAIN.fullmatch(text[-2:-1]):  # a mark after a letter is a word of its own
                ids = self[word[:-1]] + self[word[-1:]]
            else:
                ids = as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Texts to the bytes of their ids, little-endian and four for each, as the library gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words = Words(self.tokenizer) if _splits_at_space(Path(path)) else None

    def __call__(self, text: str) -> bytes:
        if self.words is None:
            return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.encode().split()))  # splits at ASCII white space only


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Stored pieces of at most ``length`` tokens: part, nth, doc_id, piece, start, length, ids (four bytes each).

    ``tokenizer`` must lie at the same path on every machine. Runs at once, over each text once.
    """
    mark, schema = as_bytes([end]), pa.schema([
        ("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), Counter()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + mark
                    for at in range(0, len(ids), 4 * length):
                        own = ids[at : at + 4 * length]
                        n = len(own) // 4
                        yield part, seen[n], doc.as_py(), at // (4 * length), at // 4, n, own
                        seen[n] += 1

        made = rows()
        while some := list(itertools.islice(made, PIECES)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.selectExpr(f"cast({id_col} AS bigint) AS doc_id", f"coalesce({text_col}, '') AS text")
    return write_once(rows.mapInArrow(cut, _PIECE), "pieces")


class Complements:
    """How many pieces of each length are left, and which sums two of the lengths may have."""

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.left = np.zeros(length + 1, dtype=np.int64)
        for size, n in counts.items():
            self.left[size] = n
        there = self.left > 0
        self.paired = np.zeros(length + 1, dtype=bool)  # sums of two lengths; cleared when one is found to be used up
        for total in range(2, length + 1):
            self.paired[total] = (there[1:total] & there[total - 1 : 0 : -1]).any()

    def _pair(self, total: int, left: np.ndarray) -> int:
        """The longer part of a pair with this sum, 0 if there is none. Pieces only get fewer, so no sum comes back."""
        longer = np.arange(total - 1, (total - 1) // 2, -1)
        for counts in (left, self.left):
            found = np.flatnonzero((counts[longer] > 0) & (counts[total - longer] > (2 * longer == total)))
            if len(found):
                return int(longer[found[0]]) if counts is left else 0
        self.paired[total] = False
        return 0

    def use(self, sizes: tuple[int, ...], times: int) -> None:
        np.subtract.at(self.left, list(sizes), times)

    def filling(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...]:
        """At most three lengths whose sum is the gap; empty if there are none. ``held`` is in use already."""
        left = self.left.copy()
        np.subtract.at(left, list(held), 1)
        if left[gap] > 0:
            return (gap,)
        if self.paired[gap] and (longer := self._pair(gap, left)):
            return longer, gap - longer
        first = np.arange(gap - 2, 0, -1)
        for a in first[(left[first] > 0) & self.paired[gap - first]].tolist():
            left[a] -= 1
            if longer := self._pair(gap - a, left):
                return a, longer, gap - a - longer
            left[a] += 1
        return ()

    def longest(self, most: int, held: tuple[int, ...] = ()) -> tuple[int, ...]:
        """The longest length that fits, as one of one."""
        left = self.left[: most + 1].copy()
        np.subtract.at(left, [size for size in held if size <= most], 1)
        fits = np.flatnonzero(left > 0)
        return (int(fits[-1]),) if len(fits) else ()


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences); all pieces are used, none twice."""
    lengths, out = Complements(counts, length), []
    while sizes := lengths.longest(length):
        while gap := length - sum(sizes):
            more = lengths.filling(gap, sizes) or lengths.longest(gap, sizes)
            if not more:
                break
            sizes += more
        times = min(int(lengths.left[size]) // n for size, n in Counter(sizes).items())
        lengths.use(sizes, times)
        out.append((sizes, times))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the n-th piece of a length: sorted keys (length, first n), and the sequence and offset that belong to each."""
    rows, used, sequence = [], Counter(), 0
    for sizes, times in patterns:
        offset = 0
        for size in sizes:
            rows.append(((size << 44) + used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    keys, sequences, offsets = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3).T
    return keys, sequences, offsets


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces`` (part, nth, length, and any other columns).

    Sequences are numbered from 0. Each is filled from offset 0 without gaps. Only the columns given are moved.
    """
    sums = write_once(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # At most ``length`` rows.
    counts = {row["length"]: row["n"] for row in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, sequences, offsets = _places(plan(counts, length))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rows = pieces.join(before, ["part", "length"]).selectExpr("* EXCEPT (part, nth, _before)", "_before + nth AS _number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_number").to_numpy()
            key = (batch.column("length").to_numpy() << 44) + number
            at = np.searchsorted(keys, key, side="right") - 1
            columns = [batch.column(name) for name in batch.schema.names if name != "_number"]
            names = [name for name in batch.schema.names if name != "_number"]
            columns += [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_number")
    return rows.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, docs (doc_id of each piece in order), starts (their offsets), ids."""
    inside = F.expr("array_sort(collect_list(struct(offset, doc_id, hex(ids) AS ids))) AS inside")
    return placed.groupBy("sequence_id").agg(inside).selectExpr(
        "sequence_id", "inside.doc_id AS docs", "inside.offset AS starts", "unhex(array_join(inside.ids, '')) AS ids"
    )


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, sequences of 2,048 tokens."""
    import public_tokenizers

    stored = pieces(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    thin = stored.selectExpr("part", "nth", "doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32")
    return packed(thin).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
