"""Conversation tries, packing and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from returns_risk.llm import packing, phrases, trie
from test_operators import rows as document_rows

TURNS = "conv_id long, turn long, role string, text string, path string, depth int, key long"


def conversations():
    """Shared starts, copies, nulls, ties, repeated rows, a long one that two share and a longer one that nobody shares."""
    rng = random.Random(9)
    says = ["hello", "é𝒳", None, "", "why?", "thanks, bye"]
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            out.append((c * 3 - 20, t if t else None, rng.choice(["user", "assistant", None]), says[min(t, rng.randint(0, 5))], "p", 1, 2))
    for c, n in ((500, 45), (501, 45), (502, 70), (505, 20)):
        out += [(c, t, "user", f"turn {t}" if t < 30 else f"turn {t} of {c // 2}", "p", 1, 2) for t in range(n)]
    out += [(600, 1, "user", "b", "p", 1, 2), (600, 1, "user", "a", "p", 1, 2), (600, 1, "user", "a", "p", 1, 2)]
    return [*out, out[0], (None, 1, "user", "nobody", "p", 1, 2), (None,) * 7]


def own_turns(rows):
    found = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            size = len(role.encode())
            digest = hashlib.md5(f"{size}:{role}{text}".encode()).hexdigest()[:24]
            found[c].append(((t is not None, t or 0), digest, (role, text)))
    return {c: [turn for *_, turn in sorted(turns)] for c, turns in found.items()}


def all_nodes(turns):
    """By definition: every prefix of every conversation, with its members."""
    members = defaultdict(list)
    for c, steps in turns.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    saved, leaves = Counter(), Counter()
    for path, who in members.items():
        own = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in children
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(turns[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), up, len(who), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_trie_has_every_prefix(spark, partitions):
    turns = spark.createDataFrame(conversations(), TURNS).repartition(partitions)
    nodes = trie.conversation_trie(turns)
    assert as_rows(nodes) == all_nodes(own_turns(conversations()))
    expected = own_turns(conversations())
    for row in nodes.collect():
        if row.depth:
            assert (row.role, row.text) == expected[row.conv_id][row.depth - 1]


def test_rebuilt_conversations(spark, monkeypatch):
    own = own_turns(conversations())
    expected = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = int(c - np.fmod(c, 5))
        expected[c] = own.get(first, [])[:h] + own[c][h:]
    assert any(not steps for steps in expected.values())
    monkeypatch.setattr(trie, "CHUNK", 2)  # digests over several texts of ids
    turns = spark.createDataFrame(conversations(), TURNS)
    assert as_rows(trie.prefix_trie(trie.rebuilt(trie.paths(turns)))) == all_nodes(expected)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "same", "p", 1, 2) for c in range(5000) for t in range(2)]
    nodes = as_rows(trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(7)))
    assert nodes == all_nodes(own_turns(rows)) and len(nodes) == 3
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid long, part string, length string, piece int"
    odd = "Hello, WORLD.<|endoftext|>foo. bar's It's..! x́y ΑΣ. a\x1cb a\x85b a b İstanbul. 3.5! a,b;c 𝒳. naïve, Ünï! ﬁ ÿ"
    made = [(*r[:5], 7, "d", "l", 1) for r in document_rows()] + [(900, odd, "en", "s", 1, 7, "d", "l", 1)]
    return spark.createDataFrame(made, schema).repartition(3)


def best_fit(sizes, length):
    """Sequences that best fit decreasing takes."""
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= size]
        if fits:
            left[min(fits, key=left.__getitem__)] -= size
        else:
            left.append(length - size)
    return len(left)


@pytest.mark.parametrize(("name", "length"), [("word_bpe_49k.json", 64), ("word_bpe_49k.json", 2048), ("byte_bpe_50k.json", 100)])
def test_packing_loses_nothing(spark, docs, name, length):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    placed = packing.packed(packing.pieces(docs, path, length), length)
    got = placed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= length and r.start == r.piece * length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, ids))
    expected = defaultdict(list)
    for row in docs.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        expected[row.doc_id] += [(k, ids[at : at + length]) for k, at in enumerate(range(0, len(ids), length))]
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in expected.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert len(by_sequence) <= best_fit([r.length for r in got], length)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in got:
        ids = whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert bytes(ids) == bytes(r.ids) and whole[r.sequence_id].docs[whole[r.sequence_id].starts.index(r.offset)] == r.doc_id
    assert packing.packed(packing.pieces(docs.limit(0), path, length), length).count() == 0


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    for length, most, kinds in ((50, 5, 30), (97, 1, 97), (200, 25, 60)):
        counts = {rng.randint(1, length): rng.randint(1, most) for _ in range(kinds)}
        made = packing.plan(counts, length)
        used = Counter()
        for sizes, times in made:
            assert sum(sizes) <= length and times > 0
            for size in sizes:
                used[size] += times
        assert used == Counter(counts)
        assert sum(times for _, times in made) <= best_fit([size for size, n in counts.items() for _ in range(n)], length)
    assert packing.plan({60: 3, 40: 1, 20: 2, 13: 1, 7: 1}, 100) == [((60, 40), 1), ((60, 20, 13, 7), 1), ((60, 20), 1)]


def phrase_rows():
    rng = random.Random(5)
    common = ["strong tea", "of the", "new york city", "a b c d e", "é 𝒳 é"]
    texts = []
    for _ in range(120):
        words = [rng.choice(common) if rng.random() < 0.5 else rng.choice("xyzuvw") for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", ": ", " \r\n"]) for w in words))
    out = [(i, t.upper() if i % 7 == 0 else t, ("en", "de", None, "und")[i % 4], i, "f", 1) for i, t in enumerate(texts)]
    out += [(i, texts[0], "en", 0, "f", 1) for i in range(200, 260)]
    return [*out, out[3], (3, "another text of the id three, of the of the", "en", 1, "f", 1), (None, texts[4], "en", 1, "f", 1), (None, None, None, None, None, None), (400, "x " * 30_000, "en", 1, "f", 1)]


def brute_phrases(rows, least, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for words, a in f.items():
            if len(words) < 2 or a < least:
                continue
            inside = any(
                len(o) > len(words) and 100 * n >= covered * a and any(o[i : i + len(words)] == words for i in range(len(o)))
                for o, n in f.items() if n >= least
            )
            if not inside:
                cuts = [(2_000_000 * a // (f[words[:k]] + f[words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(words).encode(), f[words[:k]], f[words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


PHRASES = "doc_id long, text string, lang string, rid long, fp string, n int"


@pytest.mark.parametrize(("bits", "batch", "sent"), [(64, 1 << 20, 500_000), (64, 500, 0), (8, 500, 500_000)])
def test_phrases_by_definition(spark, monkeypatch, bits, batch, sent):
    """Also with texts in many parts, with documents shuffled, and with fingerprints that nearly all collide."""
    monkeypatch.setattr(phrases, "MOST_SENT", sent)
    docs = spark.createDataFrame(phrase_rows(), PHRASES).repartition(4)
    frequent = phrases.frequent_phrases(docs, least=20, bits=bits, bitmap=1 << 12, batch=batch, part=batch)
    got = sorted(tuple(r) for r in phrases.collocations(frequent, least=20, top=15).collect())
    expected = brute_phrases(phrase_rows(), 20, 80, 15)
    assert got == expected and len(got) > 20


def test_no_phrases(spark):
    assert phrases.collocations(phrases.frequent_phrases(spark.createDataFrame([], PHRASES))).count() == 0


def test_parts_end_with_a_piece():
    text = "Ab c, d\te.. f\n" * 50 + "x" * 300 + " y"
    whole = [w for part in phrases.parts(text, 1 << 20) for w in part]
    for most in (1, 7, 64, 100):
        cut = [w for part in phrases.parts(text, most) for w in part]
        assert [p.split() for p in b" ".join(cut).split(b".") if p.split()] == [p.split() for p in b" ".join(whole).split(b".") if p.split()]
