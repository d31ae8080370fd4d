"""Collocations: phrases of two to four words that come up more often than their parts suggest.

Texts are lower-cased (A to Z), cut into pieces at marks and line ends, and pieces into words. numpy hashes every n-gram
of a batch by differences of prefix polynomials (Rabin-Karp) modulo 2^64: a fingerprint over one digest of each word, and
a check number over another. A task counts the n-grams of some ``BATCH`` words at a time; a shuffle adds up counts, the
smallest document that holds the n-gram (the pointer to its text) and the lowest and highest check number by fingerprint.
Words are counted first, then pairs, then all longer n-grams: an n-gram can only be frequent if all its words and pairs
are, so only those are sent whose words, then pairs, are marked in a bitmap of fixed size (``BITMAP`` bits) of the frequent
fingerprints. Other fingerprints that share a bit cost a row more and change nothing.

Fingerprints whose check numbers differ stand for several texts; these are read again from the documents and counted
as texts. Of the others only the frequent ones become text, found again by both numbers in the documents pointed to.
Counts of parts, scores, the dropping of phrases inside longer ones and the ranking are joins on the frequent texts.

Null texts are empty, a null language is ``und``. Repeated rows count again. Rows without an id are pointed to by their
text. Texts may be of any length; they are taken in parts that end with a piece. Other columns are left out. No documents
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returns_risk.llm.common import documents, row_id
from returns_risk.llm.hashing import mixed
from returns_risk.sources.store import write_once

LONGEST, LEAST, COVERED, TOP, FACTOR = 4, 30, 80, 2000, 2_000_000
#: Words counted at a time, bytes of a text taken at a time, words remembered by a Python worker, bits of the bitmap.
BATCH, PART, REMEMBERED, BITMAP = 500_000, 4_000_000, 300_000, 1 << 26
#: Lanes that a language's phrases are ranked in before the first of each are ranked together.
RANK_LANES = 256
#: Documents pointed to whose ids are sent to every executor; beyond, the texts are shuffled to them.
MOST_SENT = 500_000

_UPPER = bytes(range(65, 91))
_CLEAN = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b".........." + b" ")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words(dict):
    """Numbers of words; ``digests`` holds two digests for each, ``names`` the words. Number 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.names, self.digests = [b"."], np.zeros((2, 1 << 12), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == self.digests.shape[1]:
            self.digests = np.concatenate([self.digests, np.zeros_like(self.digests)], axis=1)
        both = xxhash.xxh3_128_intdigest(word)
        self.digests[:, number] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        self.names.append(word)
        return number


_words = Words()


def parts(text: str, most: int) -> Iterator[list[bytes]]:
    """The words of a text in parts of about ``most`` bytes that end with a piece; ``.`` stands after each piece."""
    clean = text.encode().translate(_CLEAN)
    at = 0
    while at < len(clean):
        end = clean.rfind(b".", at, at + most) + 1 or clean.find(b".", at + most) + 1 or len(clean)
        if len(clean) - at <= most:
            end = len(clean)
        yield [*clean[at:end].replace(b".", b" . ").split(), b"."]
        at = end


class Grams:
    """All n-grams of some texts, from the numbers of their words: prefix polynomials over a digest of each word."""

    def __init__(self, words: Words, numbers: list[np.ndarray], seeds: np.ndarray) -> None:
        own = np.concatenate(numbers)
        kept = own > 0
        self.words, self.numbers, self.seeds = words, own[kept], seeds
        self.piece = np.cumsum(~kept, dtype=np.int32)[kept]
        self.text = np.repeat(np.arange(len(numbers), dtype=np.int32), [len(n) for n in numbers])[kept]
        self.powers, self.inverse = _powers(_BASE, len(self.numbers)), _powers(_INVERSE, len(self.numbers))
        self.sums: dict[int, np.ndarray] = {}

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one piece."""
        places = max(0, len(self.numbers) - n + 1)
        return self.piece[:places] == self.piece[n - 1 : n - 1 + places]

    def hashes(self, n: int, digest: int, first: np.ndarray | None = None) -> np.ndarray:
        """Polynomials over the n words from each place on, or from the places ``first`` on; language and n are in them."""
        if digest not in self.sums:
            self.sums[digest] = np.zeros(len(self.numbers) + 1, dtype=np.uint64)
            np.cumsum(self.words.digests[digest][self.numbers] * self.powers, out=self.sums[digest][1:])
        sums, places = self.sums[digest], max(0, len(self.numbers) - n + 1)
        if first is None:
            value = (sums[n : n + places] - sums[:places]) * self.inverse[:places] + self.seeds[self.text[:places]]
        else:
            value = (sums[first + n] - sums[first]) * self.inverse[first] + self.seeds[self.text[first]]
        return mixed(value + np.uint64(n))

    def phrase(self, first: int, n: int) -> str:
        return b" ".join(self.words.names[k] for k in self.numbers[first : first + n]).decode()


def _texts(batches: Iterator[pa.RecordBatch], batch_words: int, part: int) -> Iterator[tuple[Grams, np.ndarray, list]]:
    """Batches (rid, lang, text) as n-grams of about ``batch_words`` words, with rid and language of each text."""
    global _words
    numbers, rids, langs, total = [], [], [], 0

    def made():
        seeds = np.array([xxhash.xxh3_64_intdigest(lang) for lang in langs], dtype=np.uint64)
        return Grams(_words, numbers, seeds), np.array(rids, dtype=np.int64), langs

    for batch in batches:
        for rid, lang, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            for own in parts(text.as_py(), part):
                if not numbers and len(_words) > REMEMBERED:
                    _words = Words()
                numbers.append(np.fromiter(map(_words.__getitem__, own), dtype=np.int32, count=len(own)))
                rids.append(rid.as_py())
                langs.append(lang.as_py())
                total += len(own)
                if total >= batch_words:
                    yield made()
                    numbers, rids, langs, total = [], [], [], 0
    if numbers:
        yield made()


def _marked(fps: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = mixed(fps) % np.uint64(8 * len(bitmap))
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(fps: DataFrame, bits: int) -> np.ndarray:
    """Bit ``mixed(fp) % bits`` of each fingerprint. At most ``bits`` / 8 bytes come back, whatever the number of them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = mixed(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(np.uint64(1) << (bit & np.uint64(63))).view(pa.int64())], names=["at", "bits"])

    rows = fps.select("fp").mapInArrow(places, "at bigint, bits bigint").groupBy("at").agg(F.expr("bit_or(bits) AS bits"))
    found = rows.toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _survivors(grams: Grams, n: int, bitmap: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and fingerprints of the n-grams in one piece; with a bitmap, of words or, from n = 3 on, of pairs of
    words, only those of which all words or pairs are marked."""
    whole = grams.whole(n)
    if bitmap is not None:
        size = min(n - 1, 2)
        marked = _marked(grams.hashes(size, 0) >> np.uint64(64 - bits), bitmap)
        for k in range(n - size + 1):
            whole &= marked[k : k + len(whole)]
    first = np.flatnonzero(whole)
    return first, grams.hashes(n, 0, first) >> np.uint64(64 - bits)


def _counted(rows: DataFrame, sizes: Sequence[int], sent, bits: int, batch: int, part: int) -> DataFrame:
    """Counts of n-grams of some sizes by fingerprint: size, fp, f, lowest and highest check number (mark, last), smallest
    document (rid)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value if sent is not None else None
        for grams, rids, _ in _texts(batches, batch, part):
            for n in sizes:
                first, fp = _survivors(grams, n, bitmap, bits)
                if not len(first):
                    continue
                order = np.argsort(fp)
                first, fp = first[order], fp[order]
                mark, new = grams.hashes(n, 1, first), np.ones(len(fp), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (mark[1:] != mark[:-1])
                at = np.flatnonzero(new)
                rid = np.minimum.reduceat(rids[grams.text[first]], at)
                sums = np.diff(np.append(at, len(fp)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), n, dtype=np.int32)),
                    *(pa.array(c) for c in (fp[at].view(np.int64), mark[at].view(np.int64), sums, rid)),
                ], names=["size", "fp", "mark", "n", "rid"])

    return rows.mapInArrow(count, "size int, fp bigint, mark bigint, n bigint, rid bigint").groupBy("size", "fp").agg(
        F.sum("n").alias("f"), F.min("mark").alias("mark"), F.max("mark").alias("last"), F.min("rid").alias("rid")
    )


def _recounted(rows: DataFrame, sizes: Sequence[int], sent, collided: DataFrame, bits: int, batch: int, part: int) -> DataFrame:
    """The n-grams with ``collided`` fingerprints, counted as texts: size, lang, phrase, f."""
    wanted = rows.sparkSession.sparkContext.broadcast(_bitmap(collided, BITMAP))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value if sent is not None else None
        for grams, _, langs in _texts(batches, batch, part):
            for n in sizes:
                first, fp = _survivors(grams, n, bitmap, bits)
                hit = _marked(fp, wanted.value)
                first, fp = first[hit], fp[hit]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(fp), n, dtype=np.int32)), pa.array(fp.view(np.int64)),
                    pa.array([langs[t] for t in grams.text[first]], type=pa.string()),
                    pa.array([grams.phrase(i, n) for i in first], type=pa.string()),
                ], names=["size", "fp", "lang", "phrase"])

    texts = rows.mapInArrow(read, "size int, fp bigint, lang string, phrase string").groupBy("size", "fp", "lang", "phrase")
    texts = texts.agg(F.count("*").alias("f")).join(collided.select("size", "fp"), ["size", "fp"], "left_semi")
    return texts.select("size", "lang", "phrase", "f")


def _read(rows: DataFrame, wanted: DataFrame, bits: int, batch: int, part: int) -> DataFrame:
    """The texts of ``wanted`` fingerprints (size, fp, mark, f, rid) from the documents they point to: size, lang, phrase, f."""
    wanted = write_once(wanted.groupBy("rid").agg(F.expr("collect_list(struct(size, fp, mark, f)) AS wanted")), "phrase-pointers")
    ids = wanted.select("rid")
    if ids.limit(MOST_SENT + 1).count() <= MOST_SENT:
        rows = rows.join(F.broadcast(ids), "rid", "left_semi")
    rows = rows.join(wanted, "rid").select("rid", "lang", "text", "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in range(some.num_rows):
                left = {(w["size"], w["fp"]): (w["mark"], w["f"]) for w in some.column(3)[row].as_py()}
                out = []
                for grams, _, langs in _texts([some.slice(row, 1)], batch, part):
                    for n in sorted({size for size, _ in left}):
                        own = np.array([fp for size, fp in left if size == n], dtype=np.int64)
                        first, fp = _survivors(grams, n, None, bits)
                        hit = np.isin(fp.view(np.int64), own)
                        found, at = np.unique(fp[hit].view(np.int64), return_index=True)
                        first = first[hit][at]
                        for fp_, at_, mark in zip(found.tolist(), first.tolist(), grams.hashes(n, 1, first).view(np.int64).tolist(), strict=True):
                            if left[n, fp_][0] == mark:
                                out.append((n, langs[0], grams.phrase(at_, n), left.pop((n, fp_))[1]))
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["size", "lang", "phrase", "f"])

    return rows.mapInArrow(read, "size int, lang string, phrase string, f bigint").dropDuplicates(["lang", "phrase"])


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64, bitmap: int = BITMAP,
    batch: int = BATCH, part: int = PART, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Every phrase of up to ``longest`` words that a language has ``least`` times: size (words), lang, phrase, f.

    The phrase of 0 words stands for the language's number of words. Runs at once: three passes over the texts, and one
    over the documents pointed to. ``bits`` of a fingerprint may be fewer; the result is the same.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(
        f"{row_id(id_col, text_col)} AS rid", f"coalesce({lang_col}, 'und') AS lang", f"coalesce({text_col}, '') AS text"
    )
    sent, wanted, texts = None, None, []
    for sizes in [[1], [2], list(range(3, longest + 1))][:longest]:
        name = f"phrases-{sizes[0]}"
        counts = write_once(_counted(rows, sizes, sent, bits, batch, part).where(f"f >= {least} OR mark <> last"), name)
        collided = counts.where("mark <> last")
        if collided.limit(1).count():
            read = _recounted(rows, sizes, sent, collided, bits, batch, part)
            texts.append(write_once(read.where(f"f >= {least}"), f"{name}-read"))
        own = counts.where("mark = last").drop("last")
        wanted = own if wanted is None else wanted.unionByName(own)
        if sizes[-1] < min(longest, 3):
            sent = spark.sparkContext.broadcast(_bitmap(counts, bitmap))
    words = F.expr(r"sum(regexp_count(text, '[^\\x20\\x09.,;:!?\\x0A-\\x0D]+'))")
    out = _read(rows, wanted, bits, batch, part)
    out = out.unionByName(rows.groupBy("lang").agg(words.alias("f")).selectExpr("0 AS size", "lang", "'' AS phrase", "f"))
    for more in texts:
        out = out.unionByName(more)
    return write_once(out, "phrases")


def collocations(frequent: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Ranked phrases of two words or more, from all :func:`frequent_phrases`: lang, rank, phrase, a, l, r, n, score.

    A phrase scores floor(2,000,000 a / (l + r)) at its worst cut. Phrases inside a longer one that has ``covered``
    percent of their count go. The first ``top`` of each language are returned.
    """
    names = frequent.selectExpr("lang", "phrase AS part", "f")
    cuts = frequent.where("size > 1").selectExpr("lang", "size", "phrase", "f AS a", "explode(sequence(1, size - 1)) AS k").selectExpr(
        "*", "substring_index(phrase, ' ', k) AS part", "substring_index(phrase, ' ', k - size) AS rest"
    )
    cuts = cuts.join(names.withColumnRenamed("f", "l"), ["lang", "part"]).drop("part")
    cuts = cuts.join(names.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]).drop("rest")
    score = f"(cast(a AS decimal(20, 0)) * {FACTOR}) div (cast(l AS decimal(20, 0)) + r)"
    worst = cuts.selectExpr("*", f"{score} AS score").groupBy("lang", "phrase", "a").agg(
        F.expr("min(struct(score, k, l, r)) AS cut")
    )
    longer = frequent.where("size > 2").selectExpr("lang", "size AS n", "f", "split(phrase, ' ') AS words")
    inner = longer.selectExpr("lang", "n", "f", "words", "explode(sequence(2, n - 1)) AS size").selectExpr(
        "lang", "f", f"explode(transform(sequence(1, n - size + 1), i -> array_join(slice(words, i, size), ' '))) AS phrase"
    ).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * cast(longer AS decimal(20, 0)) < {covered} * cast(a AS decimal(20, 0))"
    )
    # The first of a language are among the first of each of its lanes, so no task ranks all its phrases.
    kept = kept.withColumn("lane", F.expr(f"pmod(xxhash64(phrase), {RANK_LANES})"))
    order = (F.desc("cut.score"), F.desc("a"), "phrase")
    for keys in (("lang", "lane"), ("lang",)):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"rank <= {top}")
    ranked = kept
    totals = frequent.where("size = 0").selectExpr("lang", "f AS words")
    return ranked.join(totals, "lang").selectExpr(
        "lang", "cast(rank AS bigint) AS rank", "phrase", "a", "cut.l AS l", "cut.r AS r", "words AS n", "cut.score AS score"
    )


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``, phrases found 30 times or more, the first 2,000 of each language."""
    return collocations(frequent_phrases(documents(spark, folder)))
