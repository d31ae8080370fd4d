"""The five stages in a row against brute force, on a folder with nulls, repeated rows, copies and clashing names."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from test_operators import prose

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    ("rid", pa.string()), ("kept", pa.string()), ("size", pa.string()), ("label", pa.string()), ("taken", pa.string()),
])
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.A)


def corpus():
    rng = random.Random(31)
    items = [prose(rng, 40) for _ in range(5)]
    texts = [prose(rng, rng.randint(25, 200)) for _ in range(60)]
    for k in range(10):  # exact copies, and near ones with one word changed
        words = texts[k].split()
        words[3] = "changed"
        texts += [texts[k], " ".join([*words, *texts[k].split()[-2:]]) if k % 2 else " ".join(words)]
    texts += [f"{prose(rng, 30)} {items[k % 5]} {prose(rng, 5)}" for k in range(8)]  # leaked passages
    texts += [f"{prose(rng, 30)} password: hunter{k}twentytwo {prose(rng, 9)} AKIAQWERTYUIOPASDF{k}9" for k in range(6)]
    texts += ["too short", "", None, " ".join(["one two three four five six seven eight"] * 9), prose(rng, 8000)]
    rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 4}" if k % 7 else None) for k, t in enumerate(texts)]
    rows += [rows[2], (None, prose(rng, 30), "en", "s1"), (None, None, None, None)]
    return items, [(*r, len(r[1] or ""), "r", "k", "s", "l", "t") for r in rows]


def write(folder, rows, items):
    tables = {
        "documents": (SCHEMA, rows), "labels": (pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), [(k, k % 2, 0) for k in range(20)] if rows else []),
        "benchmark": (pa.schema([("item_id", pa.int64()), ("text", pa.string())]), list(enumerate(items))),
    }
    for name, (schema, data) in tables.items():
        columns = list(zip(*data)) or [[] for _ in schema]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), folder / f"{name}.parquet")


def good(text):
    """The base rules alone: twenty labels prove nothing, so no other threshold may reject."""
    words = (text or "").split()
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    marked = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
    return len(words) >= 20 and 100 * len(marked) <= 30 * len(words)


def one_of_each(rows):
    """Groups of similar sets, by all pairs; the smallest id of each stays, rows without one after all others."""
    sets = []
    for r in rows:
        words = r[1].lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    of = list(range(len(rows)))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                of[root(a)] = root(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root(k), []).append(r)
    return [min(group, key=lambda r: (r[0] is None, r[0])) for group in groups.values()]


def leaked(text, items):
    words = text.split()
    spans = {tuple(words[k : k + 12]) for k in range(len(words) - 11)}
    return any(tuple(item.split()[k : k + 12]) in spans for item in items for k in range(len(item.split()) - 11))


def clean(text):
    spans = [m.span() for m in ASSIGN.finditer(text)] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", text)]
    for start, end in sorted(spans, reverse=True):
        text = text[:start] + "[SECRET]" + text[end:]
    return text


def mixed(rows):
    """Sizes and targets by definition."""
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, left, open_, out = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(sizes.values()), set(names), {}
    while open_:
        shares = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = {s for s in open_ if shares[s] > 3 * sizes[s]}
        out |= {s: 3 * sizes[s] for s in above} if above else shares
        left -= sum(3 * sizes[s] for s in above)
        open_ = open_ - above if above else set()
    return sizes, out


def test_pipeline_by_brute_force(spark, tmp_path):
    items, rows = corpus()
    write(tmp_path, rows, items)
    stages = [
        [r for r in rows if good(r[1])], None, None, None,
    ]
    stages[1] = one_of_each(stages[0])
    stages[2] = [r for r in stages[1] if not leaked(r[1], items)]
    stages[3] = [(r[0], clean(r[1]), *r[2:4], len(clean(r[1])), *r[5:]) for r in stages[2]]
    assert [len(s) for s in stages] == sorted({len(s) for s in stages[:3]}, reverse=True) + [len(stages[2])]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # the next stage gets it written and read again
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, expected)), name
    sizes, targets = mixed(stages[3])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = {r[0]: r for r in stages[3]}
    taken = {}
    for r in got:
        text, source = by_id[r.doc_id][1], by_id[r.doc_id][3]
        assert (r.source, r["size"], r.source_size) == (source, len(text.split()), sizes[source])
        assert r.target == pytest.approx(targets[source]) and 0 < r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    assert len({r.doc_id for r in got}) == len(got)
    assert all(taken[s] == pytest.approx(t, abs=128) for s, t in targets.items())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pipeline_of_nothing(spark, tmp_path):
    write(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    (tmp_path / "one").mkdir()
    items, rows = corpus()
    write(tmp_path / "one", [rows[-1]], items)  # a row of nulls only
    assert corpus_pipeline.run(spark, str(tmp_path / "one")).count() == 0


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "mixing_sources"]
    assert corpus_pipeline.ORACLE_SQL is None
