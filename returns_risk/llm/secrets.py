"""Secret scans: fixed rules, and a character network over every other candidate with its context.

Rules find assignments to telling names, access keys and long hex numbers. Every other run of 16 or more key characters
that holds a digit is a candidate. A convolutional network in numpy reads it with the characters around it; long
candidates are read in overlapping windows, of which the highest counts, in calibration and threshold as in scanning.
It is trained on labelled findings: the access keys and hex numbers that the rules find in ``SAMPLE`` documents (secret;
``FINDINGS`` of each kind at most, by hash, and ``LONGEST`` characters of each), and ``MADE`` findings of each label in
well-known formats, set into contexts from those documents. Assignments are left out: a value need not look like a key.
The candidates that the rules leave have no label, so they are not trained on. A third of the findings is held back: half
of it fits the calibration (a logistic curve over the network's output), the other half sets the threshold, the highest
that keeps ``RECALL`` of the secrets of every format. The share of held-back harmless findings that reach it is kept
beside it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returns_risk.llm.common import documents, per_batch, row_id

#: Fixed patterns of the rules; kinds in the order in which spans with one start are listed.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "learned")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Holds every access key and hex number as well.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
DIGIT = re.compile(r"[0-9]")

SAMPLE, MADE, RECALL, SEED = 4000, 2400, 0.98, 7
FINDINGS, LONGEST = 4000, 1024
LEFT, BODY, RIGHT, STRIDE = 24, 64, 8, 48
LENGTH, WIDTH, FILTERS, HIDDEN = LEFT + BODY + RIGHT, 5, 32, 16
ALPHABET = 97  # printable ASCII, other, none; the candidate's own characters have numbers of their own


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, leftmost and without overlap for each kind, in order."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for run in CANDIDATE.finditer(text):
        for kind, rule, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
            found += [(m.start(), kind, m.end()) for m in rule.finditer(text, *run.span()) if len(m[0]) >= least]
    return sorted(found)


def candidates(text: str, rules: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates that no rule's span touches."""
    runs = [m.span() for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])]
    return [(s, e) for s, e in runs if not any(a < e and s < b for a, _, b in rules)]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character numbers of the windows that cover the candidate."""
    out = []
    for at in range(start, max(start + 1, end - BODY + STRIDE), STRIDE):
        row = np.full(LENGTH, ALPHABET - 1, dtype=np.int64)
        stop = min(at + BODY, end)
        first = max(0, at - LEFT)
        codes = np.frombuffer(text[first : stop + RIGHT].encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        codes = np.where((codes >= 32) & (codes < 127), codes - 32, ALPHABET - 2)
        codes[at - first : stop - first] += ALPHABET
        row[LEFT - (at - first) : LEFT - (at - first) + len(codes)] = codes
        out.append(row)
    return out


class Network:
    """Characters, a convolution, the highest output of each filter, a hidden layer, one number."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.weights = [
            rng.normal(0, 0.1, (WIDTH, 2 * ALPHABET, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.25, (FILTERS, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, 0.25, HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        ]
        self.curve, self.threshold, self.false_share = (1.0, 0.0), 0.5, 0.0

    def _forward(self, rows: np.ndarray) -> tuple:
        table, bias, w1, b1, w2, b2 = self.weights
        places = LENGTH - WIDTH + 1
        found = table[0][rows[:, :places]]
        for k in range(1, WIDTH):
            found += table[k][rows[:, k : k + places]]
        best = found.argmax(axis=1)
        top = np.take_along_axis(found, best[:, None, :], axis=1)[:, 0, :] + bias
        pooled = np.maximum(top, 0)
        hidden = pooled @ w1 + b1
        active = np.maximum(hidden, 0)
        return best, top, pooled, hidden, active, active @ w2 + b2[0]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        parts = [self._forward(rows[k : k + 512])[-1] for k in range(0, len(rows), 512)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def train(self, rows: np.ndarray, secret: np.ndarray, rounds: int = 8, rate: float = 0.004) -> None:
        """Adam on the logistic loss, both labels weighing the same."""
        rng = np.random.default_rng(SEED)
        weigh = np.where(secret, 0.5 / max(1, secret.sum()), 0.5 / max(1, (~secret).sum())) * len(secret)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 64):
                take = order[k : k + 64]
                best, top, pooled, hidden, active, out = self._forward(rows[take])
                error = ((1 / (1 + np.exp(-out)) - secret[take]) * weigh[take] / len(take)).astype(np.float32)
                grad_active = np.outer(error, self.weights[4]) * (hidden > 0)
                grad_top = (grad_active @ self.weights[2].T) * (top > 0)
                grad_table = np.zeros_like(self.weights[0])
                filters = np.broadcast_to(np.arange(FILTERS), best.shape)
                for w in range(WIDTH):
                    chars = np.take_along_axis(rows[take], best + w, axis=1)
                    np.add.at(grad_table[w], (chars, filters), grad_top)
                grads = [
                    grad_table, grad_top.sum(0), pooled.T @ grad_active, grad_active.sum(0), active.T @ error,
                    error.sum(keepdims=True),
                ]
                step += 1
                for w, g, m, v in zip(self.weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * raw + self.curve[1], -30, 30)))

    def calibrate(self, raw: np.ndarray, secret: np.ndarray) -> None:
        """Fits the logistic curve over the raw output (Newton steps, slightly held to slope 1)."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            error, spread = p - secret, p * (1 - p)
            grad = np.array([(error * raw).sum() + 0.1 * (a - 1), error.sum() + 0.01 * b])
            cross = (spread * raw).sum()
            curve = np.array([[(spread * raw * raw).sum() + 0.1, cross], [cross, spread.sum() + 0.01]])
            a, b = np.array([a, b]) - np.linalg.solve(curve, grad)
        self.curve = (float(a), float(b))

    def highest(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """The highest output over the windows of each candidate."""
        if not found:
            return np.empty(0)
        raw = self.raw(np.array([row for rows in found for row in rows])).astype(np.float64)
        starts = np.cumsum([0, *(len(rows) for rows in found)])[:-1]
        return np.maximum.reduceat(raw, starts)

    def scores(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """Calibrated probability of each candidate, given as its windows."""
        return self.probability(self.highest(found))


def made_findings(contexts: list[str], rng: np.random.Generator, n: int) -> list[tuple[str, int, int, str]]:
    """(text, start, end, format) of ``n`` secrets and as many harmless findings, in well-known formats."""
    upper, alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    number = lambda lo, hi: int(rng.integers(lo, hi))
    coded = lambda k: base64.b64encode(rng.bytes(k)).decode().rstrip("=")
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", number(3, 9))
    secret = {
        "access key": lambda: "AKIA" + pick(upper, 16),
        "prefixed": lambda: str(rng.choice(["ghp_", "sk_live_", "glpat-", "xoxb-", "pk_live_", "npm_"])) + pick(alnum, number(20, 41)),
        "base64": lambda: coded(number(20, 64)),
        "alphanumeric": lambda: pick(alnum, number(20, 65)),
        "signed": lambda: "eyJ" + coded(24).replace("/", "_").replace("+", "-"),
        "hex": lambda: rng.bytes(number(12, 33)).hex(),
    }
    plain = {
        "number": lambda: pick("0123456789", number(16, 22)),
        "joined numbers": lambda: "-".join(pick("0123456789", 4) for _ in range(number(4, 6))),
        "date": lambda: f"20{number(10, 30)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}-{number(10, 60)}",
        "name": lambda: "_".join(word() for _ in range(number(2, 5))) + f"_{number(0, 999)}_{word()}",
        "path": lambda: "/".join(["", *(word() for _ in range(number(3, 6))), f"{word()}{number(0, 99)}"]),
        "camel case": lambda: "".join(word().title() for _ in range(number(3, 5))) + str(number(0, 999)),
        "uuid": lambda: "-".join(rng.bytes(k).hex() for k in (4, 2, 2, 2, 6)),
        "repeated": lambda: word() * 4 + str(number(0, 99)),
    }
    out = []
    for kinds, label in ((secret, 1), (plain, 0)):
        for k in range(n):
            name = list(kinds)[k % len(kinds)]
            value = kinds[name]()
            value = value if len(value) >= 16 else value + "0" * (16 - len(value))
            before = str(contexts[number(0, len(contexts))])[:LEFT] if contexts else ""
            lead = str(rng.choice(["", " ", ": ", "= ", '"', "key ", "id="]))
            out.append((f"{before}{lead}{value} {before[::-1]}", len(before + lead), len(before + lead + value), f"{label}{name}"))
    return out


def sample_findings(docs: DataFrame, bound: int = SAMPLE, most: int = FINDINGS) -> list[tuple[str, int, int, str]]:
    """Findings (cut-out, start, end, format) in the ``bound`` documents with the smallest hashes; equal rows are one.

    Of each format the ``most`` findings with the smallest hashes, however many a document holds.
    """
    hashed = docs.selectExpr("rid", "text", "xxhash64(rid, text, 17) AS h")
    last = hashed.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def find(rids: list, texts: list) -> dict:
        out = {"cut": [], "start": [], "end": [], "format": []}
        for text in texts:
            found = [(s, e, f"1{KINDS[k]}") for s, k, e in rule_spans(text or "") if k]
            for s, e, name in [*found, (0, 0, "-context")]:
                first, e = max(0, s - LEFT), min(e, s + LONGEST)
                for key, value in zip(out, (text[first : e + RIGHT + LEFT] if text else "", s - first, e - first, name), strict=True):
                    out[key].append(value)
        return out

    rows = per_batch(hashed.where(F.col("h") <= last).select("rid", "text").distinct(), find, "cut string, start int, `end` int, format string")
    rank = Window.partitionBy("format").orderBy(F.xxhash64("cut", "start", "end"), "cut", "start")
    few = rows.where("format = '-context'").unionByName(
        rows.where("format <> '-context'").withColumn("rank", F.row_number().over(rank)).where(f"rank <= {most}").drop("rank")
    )
    return sorted(tuple(r) for r in few.collect())  # at most ``bound`` contexts, and ``most`` findings of each kind


def trained(docs: DataFrame, bound: int = SAMPLE) -> Network:
    """The network, calibrated, with its threshold. ``docs``: rid, text."""
    found = sample_findings(docs, bound)
    contexts = [cut for cut, _, _, name in found if name == "-context" and cut]
    rng = np.random.default_rng(SEED)
    found = [f for f in found if f[3] != "-context"] + made_findings(contexts, rng, MADE)
    rows, formats = [windows(cut, s, e) for cut, s, e, _ in found], np.array([name for *_, name in found])
    secret, part = np.char.startswith(formats, "1"), rng.integers(0, 6, len(rows))
    held_back = {k: [own for own, p in zip(rows, part, strict=True) if p == k] for k in (0, 1)}
    network = Network(SEED)
    network.train(np.array([own[0] for own, p in zip(rows, part, strict=True) if p > 1]), secret[part > 1])
    network.calibrate(network.highest(held_back[0]), secret[part == 0])
    held = network.scores(held_back[1])
    lowest = [
        np.sort(held[formats[part == 1] == name])[int((1 - RECALL) * (formats[part == 1] == name).sum())]
        for name in set(formats[part == 1]) if name.startswith("1")
    ]
    network.threshold = float(min(lowest, default=0.5))
    harmless = held[~secret[part == 1]]
    network.false_share = float((harmless >= network.threshold).mean()) if len(harmless) else 0.0
    return network


def all_spans(texts: list[str], network: Network) -> list[list[tuple[int, int, int]]]:
    """Per text the spans (start, kind, end) of the rules and of the network, in order."""
    out, places, found = [rule_spans(text) for text in texts], [], []
    for k, text in enumerate(texts):
        for s, e in candidates(text, out[k]):
            places.append((k, s, e))
            found.append(windows(text, s, e))
    for (k, s, e), p in zip(places, network.scores(found), strict=True):
        if p >= network.threshold:
            out[k].append((s, 3, e))
    return [sorted(spans) for spans in out]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans. Positions count code points.

    Null and empty texts have no spans. Rows without an id and repeated rows are scanned like others. Other columns are
    left out. Two runs on the same rows agree.
    """
    rows = docs.selectExpr(f"{row_id(id_col, text_col)} AS rid", f"{text_col} AS text")
    network = trained(rows, bound)

    def scan(ids: list, texts: list) -> dict:
        found = all_spans([t or "" for t in texts], network)
        base = [[s for s in spans if s[1] < 3] for spans in found]
        out = {"doc_id": ids}
        for k, name in enumerate(KINDS):
            out[f"n_{name}"] = [sum(s[1] == k for s in spans) for spans in found]
        out["base_sha256"] = [hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]
        out["spans"] = [listed(spans) for spans in found]
        return out

    counts = ", ".join(f"n_{name} bigint" for name in KINDS)
    rows = docs.selectExpr(f"cast({id_col} AS bigint) AS doc_id", f"{text_col} AS text")
    return per_batch(rows, scan, f"doc_id bigint, {counts}, base_sha256 string, spans string")


def redacted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", bound: int = SAMPLE,
    mark: str = "[SECRET]",
) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, all columns and rows kept; ``length_col`` follows if there is one."""
    network = trained(docs.selectExpr(f"{row_id(id_col, text_col)} AS rid", f"{text_col} AS text"), bound)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        out = []
        for text, spans in zip(texts, all_spans([t or "" for t in texts], network), strict=True):
            if spans:
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, redact.asNondeterministic()(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``documents``."""
    return secrets(documents(spark, folder))
