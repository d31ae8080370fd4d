"""Masked pseudo-likelihood scores.

Each word of a text is hidden in turn and predicted from the two words on either side; the conditional log-probabilities
add up to the text's score. Word counts come from all documents. Words that occur ``LEAST`` times or more, ``MOST_OWN`` of
them at most, the most frequent first, have vectors and an output of their own; one more class stands for all others.
The classes are the leaves of a Huffman tree of their counts. The network adds a vector for each of the four neighbours,
takes tanh, and decides at every inner node on the way to a leaf by a dot product; so the probabilities of all classes
sum up to one, and a word costs as many short dot products as its way has nodes. The nodes' biases start at the
counts' log-odds: untrained, the network gives each class its share of all words. Words without an output of their own
are spelled: the probability of the class is multiplied with that of the word's bytes, each given the byte before, by
counts over all such words, as a share of what spelling leaves to words that have no output of their own.

Training reads the windows of all words of all documents once. Texts become class numbers, two bytes each, which are
stored in pieces of ``PIECE`` words. The pieces are dealt into ``ROUNDS`` parts. In a round every task starts from the
present weights and trains on its pieces of one part, in batches of ``BATCH`` windows, with updates for the rows that a
batch touches, each at a rate that falls with the gradients the row has seen (in this task: these sums begin anew in every
task and round). The ``TOP`` nodes next to the root, which most ways pass, are trained as one small matrix, the others one
by one. Then the changes of the rows that a task has touched are averaged, weighed by windows, in ``LANES`` streams and a
last one, so the driver gets one set of weights, whose size is bounded by ``MOST_OWN``. Averages depend on how the pieces are dealt over tasks, so
scores vary a little with the size of the cluster; reruns with the same tasks agree.

The pieces are scored as they are stored: texts are read twice, for counts and for classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import documents
from returns_risk.sources.store import write_once

LEAST, MOST_OWN, SIDE, DIM = 5, 32_000, 2, 8
PIECE, ROUNDS, BATCH, TOP, RATE, SEED, LANES = 1 << 16, 4, 2048, 31, 0.1, 5, 16
#: Distinct words that a task counts before it sends the counts on; texts whose pieces are collected before they are cut.
MOST_COUNTED, TEXTS = 300_000, 512
BYTES = 257  # values of a byte, and 256 for the start and the end of a word
_PIECES = "uid bigint, n bigint, turn int, classes binary, ends binary, uids binary"


@dataclass
class Tree:
    """The way from each class to the root: nodes and signs (1 to the left, -1 to the right) from ``start`` on.

    Nodes are numbered upwards. Those from ``cut`` on are the top: ``low`` nodes of a way come before them, and ``top``
    has the signs of the others, a column for each top node, 0 for those that aren't on the way.
    """

    nodes: np.ndarray
    signs: np.ndarray
    start: np.ndarray
    length: np.ndarray
    bias: np.ndarray
    cut: int
    low: np.ndarray
    top: np.ndarray


def tree_of(counts: np.ndarray) -> Tree:
    """Huffman tree of positive counts, at least two of them; of equal counts the first, then leaves before nodes."""
    n = len(counts)
    order, total = np.argsort(counts, kind="stable").tolist(), [*map(int, counts), *[0] * (n - 1)]
    parent, side = np.zeros(2 * n - 1, dtype=np.int64), np.ones(2 * n - 1, dtype=np.float32)
    leaf, inner, bias = 0, n, np.zeros(n - 1, dtype=np.float32)
    for node in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if leaf < n and (inner >= node or total[order[leaf]] <= total[inner]):
                pair.append(order[leaf])
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        total[node] = total[pair[0]] + total[pair[1]]
        parent[pair], side[pair] = node, (1, -1)
        bias[node - n] = np.log(total[pair[0]] / total[pair[1]])
    leaves, nodes, signs = [], [], []
    at = now = np.arange(n)
    while len(now):
        leaves.append(at)
        nodes.append(parent[now] - n)
        signs.append(side[now])
        now = parent[now]
        open_ = now != 2 * n - 2
        at, now = at[open_], now[open_]
    flat = np.concatenate(leaves)
    order = np.argsort(flat, kind="stable")
    length, nodes, signs, cut = np.bincount(flat, minlength=n), np.concatenate(nodes)[order], np.concatenate(signs)[order], max(0, n - 1 - TOP)
    top, high = np.zeros((n, n - 1 - cut), dtype=np.int8), nodes >= cut
    top[flat[order][high], nodes[high] - cut] = signs[high]
    low = np.bincount(flat[order][~high], minlength=n)
    return Tree(nodes.astype(np.uint16), signs, np.cumsum(length) - length, length, bias, cut, low, top)


def first_weights(tree: Tree, dim: int = DIM) -> list[np.ndarray]:
    """Vectors of the neighbours (side by side, one more for none), of the nodes, and the nodes' biases."""
    rows = 2 * SIDE * (len(tree.length) + 1)
    near = np.random.default_rng(SEED).normal(0, 0.1, (rows, dim)).astype(np.float32)
    return [near, np.zeros((len(tree.bias), dim), dtype=np.float32), tree.bias.copy()]


def windows(line: np.ndarray) -> np.ndarray:
    """(places, 2 SIDE): the neighbours of all places but the first and last ``SIDE``, from left to right."""
    n = len(line) - 2 * SIDE
    return np.stack([line[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


def _way(tree: Tree, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``length`` nodes (one at least) and signs on the ways from ``words``, and where each way starts."""
    starts = np.cumsum(length) - length
    at = np.repeat(tree.start.take(words) - starts, length)
    at += np.arange(len(at))
    return tree.nodes.take(at), tree.signs.take(at), starts


def _wide(weights: list[np.ndarray]) -> np.ndarray:
    """The nodes' vectors with their biases in a column behind, and one of zeros if that makes the width even."""
    dim = weights[1].shape[1]
    wide = np.zeros((len(weights[1]), (dim + 2) // 2 * 2), dtype=weights[1].dtype)
    wide[:, :dim], wide[:, dim] = weights[1], weights[2]
    return wide


def _hidden(vectors: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """What the nodes' wide rows are multiplied with: the hidden values, 1 for the bias, and 0."""
    rows, dim = len(vectors) // (2 * SIDE), vectors.shape[1]
    out = np.zeros((len(near), width), dtype=vectors.dtype)
    out[:, dim] = 1
    total = vectors.take(near[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        total += vectors[k * rows : (k + 1) * rows].take(near[:, k], axis=0)
    np.tanh(total, out=out[:, :dim])
    return out


def log_probabilities(weights: list[np.ndarray], tree: Tree, words: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of each class in ``words``, given its neighbours."""
    out, wide = np.empty(len(words), dtype=np.float64), _wide(weights)
    for first in range(0, len(words), BATCH):
        part = slice(first, first + BATCH)
        length = tree.length.take(words[part])
        nodes, signs, starts = _way(tree, words[part], length)
        hidden = _hidden(weights[0], near[part], wide.shape[1])
        logits = np.einsum("md,md->m", np.repeat(hidden, length, axis=0), wide.take(nodes, axis=0))
        logits *= -signs
        np.exp(np.minimum(logits, 25, out=logits), out=logits)  # so the product of a way stays above the smallest number
        logits += 1
        out[part] = -np.log(np.multiply.reduceat(logits, starts, dtype=np.float64))
    return out


def _runs(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows. Columns are added two at a time, as complex numbers: half as many steps."""
    pairs = rows.view(np.complex64) if rows.shape[1] % 2 == 0 else rows
    return np.add.reduceat(pairs, starts, axis=0).view(np.float32)


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys.take(order)
    new = np.empty(len(keys), dtype=bool)
    new[0], new[1:] = True, keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys.take(at).astype(np.int64), _runs(rows.take(order, axis=0), at)


def _less(rows: np.ndarray, keys: np.ndarray, slope: np.ndarray) -> None:
    """Takes the slopes off the rows of distinct keys. Rows are written as one item each, not number by number."""
    item = f"V{rows.shape[1] * rows.itemsize}"
    rows.view(item)[keys] = (rows.take(keys, axis=0) - slope).view(item)


def train(weights: list[np.ndarray], seen: list[np.ndarray], tree: Tree, words: np.ndarray, near: np.ndarray) -> None:
    """One pass over windows, in place. ``seen`` has the squared gradients so far of the neighbours' and the nodes' rows."""
    vectors, nodes_, biases = weights
    rows, order, top = len(vectors) // (2 * SIDE), np.random.default_rng(len(words)).permutation(len(words)), slice(tree.cut, None)
    wide, dim = _wide(weights), nodes_.shape[1]
    for first in range(0, len(words), BATCH):
        part = order[first : first + BATCH]
        low = tree.low.take(words.take(part)) > 0
        some = int(low.sum())
        part = np.concatenate([part[low], part[~low]])  # those with low nodes first
        own, beside = words.take(part), near.take(part, axis=0)
        hidden = _hidden(vectors, beside, wide.shape[1])
        error = _error(hidden @ wide[top].T, tree.top.take(own, axis=0).astype(np.float32))
        back = error @ wide[top, :dim]
        above = error.T @ hidden
        if some:
            length = tree.low.take(own[:some])
            nodes, signs, starts = _way(tree, own[:some], length)
            mine, theirs = np.repeat(hidden[:some], length, axis=0), wide.take(nodes, axis=0)
            error = _error(np.einsum("md,md->m", mine, theirs), signs)[:, None]
            theirs *= error
            back[:some] += _runs(theirs, starts)[:, :dim]
            mine *= error
            keys, slope = _sums(nodes, mine)
            slope *= _rates(seen[1], keys, slope, dim + 1)
            _less(wide, keys, slope)
        above *= _rates(seen[1], top, above, dim + 1)
        wide[top] -= above
        back *= 1 - hidden[:, :dim] * hidden[:, :dim]
        for k in range(2 * SIDE):
            keys, slope = _sums(beside[:, k], back)
            keys += k * rows
            slope *= _rates(seen[0], keys, slope, dim)
            _less(vectors, keys, slope)
    nodes_[:], biases[:] = wide[:, :dim], wide[:, dim]


def _error(logits: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Slope of the negative log-probability of turning as ``signs`` say; 0 where the sign is."""
    logits *= signs
    np.exp(np.minimum(logits, 60, out=logits), out=logits)
    logits += 1
    return np.divide(-signs, logits, out=logits)


def _rates(seen: np.ndarray, keys: np.ndarray | slice, slope: np.ndarray, width: int) -> np.ndarray:
    """Adds the mean squares of the slopes' ``width`` numbers to what the rows have seen, and gives the rate of each row."""
    sums = seen[keys] + np.einsum("md,md->m", slope, slope) / width
    seen[keys] = sums
    return (RATE / np.sqrt(sums + 1e-6))[:, None]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as bytes, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().cast(pa.binary())
    there = pc.binary_length(words).to_numpy() > 0  # white space at either end of a text leaves an empty word there
    if there.all():
        return words, n
    return words.filter(pa.array(there)), np.bincount(np.repeat(np.arange(len(n)), n)[there], minlength=len(n))


def word_counts(docs: DataFrame) -> DataFrame:
    """The counts of all words: word (bytes), n. A task sends counts of some words at a time, not words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                counts = _split(batch.column(0).slice(first, TEXTS))[0].value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                rows += len(counts)
                if rows >= 2 * MOST_COUNTED:
                    held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    rows = len(held[0])
                if rows >= MOST_COUNTED and len(held) == 1:
                    yield from held.pop().to_batches()
                    rows = 0
        for table in held:
            yield from table.to_batches()

    rows = docs.select("text").mapInArrow(count, "word binary, n bigint")
    return write_once(rows.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def _transitions(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Steps from byte to byte (``BYTES`` times the one before, plus the next) of words in a row, and their starts."""
    length = pc.binary_length(words).to_numpy().astype(np.int64) + 1
    line = np.full(int(length.sum()) + 1, 256, dtype=np.int64)
    ends = np.cumsum(length)
    inside = np.ones(len(line), dtype=bool)
    inside[0], inside[ends] = False, False
    line[inside] = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"")[0].as_py(), dtype=np.uint8)
    return line[:-1] * BYTES + line[1:], ends - length


class Spelling:
    """Log-probability of a word byte after byte. ``excluded``: words that are never spelled."""

    def __init__(self, cells: np.ndarray, excluded: list[bytes]) -> None:
        table = cells.reshape(BYTES, BYTES) + 1.0
        self.table = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
        self.rest = 0.0
        self.rest = float(np.log1p(-min(np.exp(self(pa.array(excluded, pa.binary()))).sum(), 0.999))) if excluded else 0.0

    def __call__(self, words: pa.Array) -> np.ndarray:
        steps, starts = _transitions(words)
        return np.add.reduceat(self.table[steps], starts) - self.rest


def vocabulary(counts: DataFrame, least: int = LEAST, most_own: int = MOST_OWN) -> tuple[list[bytes], np.ndarray, Spelling]:
    """The words with an output of their own (ties by word), the counts of all classes, and the spelling of the others."""
    own = counts.where(f"n >= {least}").orderBy(F.desc("n"), "word").limit(most_own).collect()
    others = counts.where(f"n < {least}")
    if len(own) == most_own:
        last = own[-1]
        others = counts.where((F.col("n") < last.n) | (F.col("n") == last.n) & (F.col("word") > F.lit(last.word)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BYTES * BYTES, dtype=np.int64)
        for batch in batches:
            words = batch.column(0)
            if len(words):
                steps, starts = _transitions(words)
                np.add.at(cells, steps, np.repeat(batch.column(1).to_numpy(), np.diff(np.append(starts, len(steps)))))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    cells = np.zeros(BYTES * BYTES)
    for cell, n in others.select("word", "n").mapInArrow(spell, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        cells[cell] = n
    rest = others.agg(F.sum("n")).first()[0] or 0
    words = [bytes(row.word) for row in own]
    return words, np.array([*(row.n for row in own), max(rest, 1)], dtype=np.int64), Spelling(cells, words)


def classified(docs: DataFrame, own: list[bytes], spelling: Spelling, piece: int) -> tuple[DataFrame, DataFrame]:
    """Stored texts (uid, doc_id, n_tokens, spelled) and pieces of their classes.

    A piece has the classes of words in a row, ``SIDE`` times none between texts and at both ends or else the neighbours
    there; ``ends`` and ``uids`` tell which text each word belongs to. A uid is made of the task and the text's number.
    """
    sent = docs.sparkSession.sparkContext.broadcast((own, spelling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spelling = sent.value
        known, rest, none = pa.array(own, pa.binary()), len(own), len(own) + 1
        part, done, cut = TaskContext.get().partitionId() << 36, 0, 0
        for batch in batches:
            ids = batch.column(0)
            for first in range(0, batch.num_rows, TEXTS):
                words, n = _split(batch.column(1).slice(first, TEXTS))
                found = pc.index_in(words, value_set=known).fill_null(rest).to_numpy()
                text = np.repeat(np.arange(len(n)), n)
                unknown = found == rest
                spelled = spelling(words.filter(pa.array(unknown))) if unknown.any() else np.zeros(0)
                uids = part + done + np.arange(len(n))
                done += len(n)
                yield _batch(
                    uid=uids, n=n, turn=[-1] * len(n), classes=[None] * len(n), ends=[None] * len(n), uids=[None] * len(n),
                    doc_id=ids.slice(first, TEXTS), spelled=np.bincount(text[unknown], weights=spelled, minlength=len(n)),
                )
                at = np.arange(len(found)) + SIDE * text
                line, owner = np.full(len(found) + SIDE * (len(n) + 1), none, dtype=np.uint16), np.full(len(found) + SIDE * len(n), -1)
                line[at + SIDE], owner[at] = found, text
                for start in range(0, len(owner), piece):
                    mine = owner[start : start + piece]
                    real = mine >= 0
                    if real.any():
                        at = np.flatnonzero(np.concatenate([[True], mine[real][1:] != mine[real][:-1]]))
                        yield _batch(
                            uid=[int(uids[0])], n=[int(real.sum())], turn=[cut % ROUNDS],
                            classes=[line[start : start + len(mine) + 2 * SIDE].tobytes()], ends=[at.astype("<i8").tobytes()],
                            uids=[uids[mine[real][at]].astype("<i8").tobytes()], doc_id=[None], spelled=[0.0],
                        )
                        cut += 1

    rows = docs.select("doc_id", "text").mapInArrow(run, f"{_PIECES}, doc_id bigint, spelled double")
    stored = write_once(rows, "lm-classes")
    return (
        stored.where("turn < 0").selectExpr("uid", "doc_id", "n AS n_tokens", "spelled"),
        stored.where("turn >= 0").selectExpr("n", "turn", "classes", "ends", "uids"),
    )


def _batch(**columns) -> pa.RecordBatch:
    kinds = {"uid": pa.int64(), "n": pa.int64(), "turn": pa.int32(), "classes": pa.binary(), "ends": pa.binary(), "uids": pa.binary(), "doc_id": pa.int64(), "spelled": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[name], type=kind) for name, kind in kinds.items()], names=list(kinds))


def _piece(raw: bytes, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a piece's words, and their neighbours."""
    line = np.frombuffer(raw, dtype=np.uint16)
    own = line[SIDE:-SIDE]
    at = np.flatnonzero(own != none)
    return own.take(at), windows(line).take(at, axis=0)


def fitted(pieces: DataFrame, tree: Tree, none: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The weights after training on all pieces, one part of them in each round. ``none``: the class of no neighbour."""
    context = pieces.sparkSession.sparkContext
    weights = first_weights(tree)
    shape = (len(weights[0]) + len(weights[1]), weights[0].shape[1] + 1)
    schema = "lane int, n bigint, rows binary, changes binary"

    def flat(weights: list[np.ndarray]) -> np.ndarray:
        """All weights as rows of one matrix: the neighbours' vectors, then the nodes' with their biases in a last column."""
        wide = np.concatenate([weights[1], weights[2][:, None]], axis=1)
        return np.concatenate([np.pad(weights[0], ((0, 0), (0, 1))), wide])

    def packed(lane: int, total: int, rows: np.ndarray, changes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "lane": pa.array([lane], pa.int32()), "n": [total], "rows": [rows.astype("<i4").tobytes()],
            "changes": [changes.astype("<f4").tobytes()],
        })

    for turn in range(rounds):
        start = context.broadcast((tree, weights))

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            tree, given = start.value
            own, total = [w.copy() for w in given], 0
            seen = [np.zeros(len(w), dtype=np.float32) for w in own[:2]]
            for batch in batches:
                for raw in batch["classes"].to_pylist():
                    words, near = _piece(raw, none)
                    train(own, seen, tree, words, near)
                    total += len(words)
            if total:
                rows = np.flatnonzero(np.concatenate(seen))
                yield packed(TaskContext.get().partitionId() % LANES, total, rows, (flat(own) - flat(given))[rows])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = 0, np.zeros(shape)
            for batch in batches:
                for n, rows, changes in zip(batch["n"].to_pylist(), batch["rows"].to_pylist(), batch["changes"].to_pylist(), strict=True):
                    total += n
                    sums[np.frombuffer(rows, "<i4")] += np.frombuffer(changes, "<f4").reshape(-1, shape[1]) * float(n)
            if total:
                rows = np.flatnonzero(sums.any(axis=1))
                yield packed(0, total, rows, sums[rows] / total)

        parts = pieces.where(f"turn = {turn}").select("classes").mapInArrow(local, schema)
        parts = parts.repartition(LANES, "lane").mapInArrow(averaged, schema).repartition(1).mapInArrow(averaged, schema)
        if row := parts.first():
            after = flat(weights)
            after[np.frombuffer(row.rows, "<i4")] += np.frombuffer(row.changes, "<f4").reshape(-1, shape[1])
            near, nodes = np.split(after, [len(weights[0])])
            weights = [np.ascontiguousarray(near[:, :-1]), np.ascontiguousarray(nodes[:, :-1]), nodes[:, -1].copy()]
        start.unpersist()
    return weights


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least: int = LEAST,
    most_own: int = MOST_OWN, piece: int = PIECE,
) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (natural logarithms, summed over all words), mean_log_prob.

    Null and empty texts have no words, a log_prob of 0 and a null mean. Rows without an id and repeated rows are counted,
    trained on and scored like others; very long texts are cut into pieces whose windows overlap, so no neighbour is lost.
    Other columns are left out. No rows give no rows. Runs at once, but for the scoring.
    """
    docs = docs.selectExpr(f"cast({id_col} AS bigint) AS doc_id", f"{text_col} AS text")
    own, counts, spelling = vocabulary(word_counts(docs), least, most_own)
    tree, none = tree_of(counts if own else np.append(counts, 1)), len(own) + 1  # a tree has two leaves at least
    texts, pieces = classified(docs, own, spelling, piece)
    sent = docs.sparkSession.sparkContext.broadcast((tree, fitted(pieces, tree, none, rounds)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights = sent.value
        for batch in batches:
            for raw, ends, uids in zip(*(batch[name].to_pylist() for name in ("classes", "ends", "uids")), strict=True):
                found = log_probabilities(weights, tree, *_piece(raw, none))
                sums = np.add.reduceat(found, np.frombuffer(ends, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(uids, "<i8")), pa.array(sums)], names=["uid", "part"])

    sums = pieces.select("classes", "ends", "uids").mapInArrow(score, "uid bigint, part double").groupBy("uid").agg(F.sum("part").alias("of_classes"))
    out = texts.join(sums, "uid", "left").selectExpr("doc_id", "n_tokens", "coalesce(of_classes, 0D) + spelled AS log_prob")
    return out.selectExpr("*", "CASE WHEN n_tokens > 0 THEN log_prob / n_tokens END AS mean_log_prob")


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``."""
    return lm_scores(documents(spark, folder))
