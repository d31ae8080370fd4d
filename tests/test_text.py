import random
import re

import pytest

from returns_risk import constants as c
from returns_risk.functions.text import keyword_count, may_overlap, whole_word_pattern, with_keyword_counts
from returns_risk.operators.text_features import score_text
from returns_risk.sources.tables import PHRASES

ALL_TERMS = c.REFUND_TERMS + c.DAMAGE_TERMS + c.MISSING_TERMS + c.POSITIVE_TERMS + c.NEGATIVE_TERMS
TEXTS = [
    "returned refunds unhappy unresolved", "Refund-credit", "money  back", "money back", "REFUND! Return?",
    "érefund refundé refund", "a_refund refund_ refund1 1refund", "where is my order where is my order",
    "thank you, thank you", "", "refund\nreturn\tcredit", "日本refund refund。", "refund́ x",
    "not working/not received", "great-great great", "Straße broken, BROKEN.",
]


def brute(text, terms):
    return sum(len(re.findall(r"\b" + re.escape(term) + r"\b", text.lower())) for term in terms)


def test_counts_match_one_search_per_term(spark):
    texts = TEXTS + [p for p in PHRASES if p]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lists = {"r": c.REFUND_TERMS, "d": c.DAMAGE_TERMS, "m": c.MISSING_TERMS, "p": c.POSITIVE_TERMS, "n": c.NEGATIVE_TERMS}
    for row in with_keyword_counts(df, "t", lists).collect():
        assert [row[name] for name in lists] == [brute(row.t, terms) for terms in lists.values()], row.t


def test_no_overlap_in_the_fixed_lists():
    assert not may_overlap(ALL_TERMS)


@pytest.mark.parametrize("terms, expected", [
    (("send back", "back order"), True), (("money back", "back"), True), (("refund", "return"), False),
    (("happy", "unhappy"), False), (("not working", "not received"), False), (("where is", "where is my order"), True),
])
def test_may_overlap(terms, expected):
    assert may_overlap(terms) is expected


def test_overlapping_and_repeated_terms_are_counted_one_by_one(spark):
    text = "please send back order 7, send back order"
    df = spark.createDataFrame([(text,)], "t string")
    for terms in (("send back", "back order"), ("back", "send back", "back"), ("c++", "order")):
        lists = {"n": terms, "other": ("send",)}
        assert with_keyword_counts(df, "t", lists).first().n == brute(text, terms)
        assert df.selectExpr(f"{keyword_count('t', terms)} AS n").first().n == brute(text, terms)


def test_random_lists_are_counted_as_one_search_per_term(spark):
    """Overlaps, prefixes, repeated terms, terms that overlap with themselves, marks at either end."""
    rng = random.Random(6)
    words = ["a", "b", "a b", "b a", "a b a", "aa", "a b c", "b c", "c", "c++", ".net", "+b", "a+b", "a-a", "a a", "b c a"]
    texts = ["".join(rng.choice(["a", "b", "c", "aa", "c++", ".net", " ", " ", " ", "-", "+"]) for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _ in range(12):
        lists = {name: rng.choices(words, k=rng.randint(1, 6)) for name in "xyz"}
        counted = with_keyword_counts(df, "t", lists).selectExpr("*", f"{keyword_count('t', lists['x'])} AS alone")
        for row in counted.collect():
            assert [row[name] for name in "xyz"] == [brute(row.t, terms) for terms in lists.values()], (row.t, lists)
            assert row.alone == row.x


def test_pattern_of_terms_with_other_edges(spark):
    text = "c++ and c++x and .net net"
    df = spark.createDataFrame([(text,)], "t string")
    for terms in (("c++",), (".net", "net")):
        assert df.selectExpr(f"{keyword_count('t', terms)} AS n").first().n == brute(text, terms)
    assert whole_word_pattern(("a", "b")).count("(?<!") == 1


# (refund, damage, missing, score, score with the short list) per phrase of FIXTURES.md
EXPECTED = [
    (3, 0, 0, -1, 0), (0, 2, 0, -1, -1), (0, 0, 3, -1, 0), (0, 0, 0, 0.5, 0.5), (0, 0, 0, 1, 1),
    (0, 0, 0, 0, 0), (0, 0, 0, -1, -1), (0, 0, 0, 0, 0), (4, 2, 0, -1, 0), (0, 0, 1, 0, 0),
]


def test_phrases_of_the_fixture(spark):
    df = spark.createDataFrame(list(enumerate(PHRASES)), "id int, TicketDescription string")
    full = score_text(df).withColumnRenamed("TicketSentimentScore", "full")
    both = score_text(full, keyword_lists={}, negative=c.NEGATIVE_TERMS_SHORT).orderBy("id").collect()
    got = [(*[r[k] for k in c.KEYWORD_LISTS], r.full, r.TicketSentimentScore) for r in both]
    assert got == EXPECTED
