"""Whole-word term counts and lexicon sentiment, without Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from returns_risk.functions.numeric import sql_text

# A word character is a letter, a number or an underscore in any script. Spelled out because
# Java's own \b also counts combining marks.
WORD = r"[\p{L}\p{N}_]"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _at_boundary(text: str, position: int) -> bool:
    before = position > 0 and _is_word(text[position - 1])
    after = position < len(text) and _is_word(text[position])
    return before != after


def whole_word_pattern(terms: Iterable[str]) -> str:
    """One regular expression that matches any of ``terms`` between word boundaries."""
    branches = []
    for term in terms:
        left = f"(?<!{WORD})" if _is_word(term[0]) else f"(?<={WORD})"
        right = f"(?!{WORD})" if _is_word(term[-1]) else f"(?={WORD})"
        branches.append((left, re.escape(term), right))
    frames = {(left, right) for left, _, right in branches}
    if len(frames) == 1:
        ((left, right),) = frames
        return f"{left}(?:{'|'.join(body for _, body, _ in branches)}){right}"
    return "|".join("".join(branch) for branch in branches)


def may_overlap(terms: Iterable[str]) -> bool:
    """True if matches of two different terms can share characters in some text."""
    terms = list(dict.fromkeys(terms))
    for first in terms:
        for second in terms:
            if first == second:
                continue
            for start in range(len(first)):
                shared = min(len(first) - start, len(second))
                if first[start:start + shared] != second[:shared]:
                    continue
                starts_on_edge = start == 0 or _at_boundary(first, start)
                inner, outer = (start + shared, first) if start + shared < len(first) else (shared, second)
                ends_on_edge = inner == len(outer) or _at_boundary(outer, inner)
                if starts_on_edge and ends_on_edge:
                    return True
    return False


def _self_overlaps(term: str) -> bool:
    """True if two matches of ``term`` can share characters, so that only every other one counts."""
    return any(
        term[start:] == term[: len(term) - start] and _at_boundary(term, start) and _at_boundary(term, len(term) - start)
        for start in range(1, len(term))
    )


def _also_there(found: str, term: str) -> bool:
    """True if ``term`` begins where ``found`` does whenever ``found`` is the longest term there."""
    return found.startswith(term) and (found == term or _at_boundary(found, len(term)))


def _hit_array(text: str, terms: list[str]) -> str:
    """SQL text: the hits in order. Free of overlaps, they are matches in a row; else, at every position, the longest
    term that begins there, found without using the text up."""
    if not may_overlap(terms):
        return f"regexp_extract_all(lower({text}), {sql_text(whole_word_pattern(terms))}, 0)"
    longest_first = sorted(terms, key=len, reverse=True)
    return f"regexp_extract_all(lower({text}), {sql_text(f'(?=({whole_word_pattern(longest_first)}))')}, 1)"


def _count_of(hits: str, listed: list[str], terms: list[str]) -> str:
    """SQL text: number of hits of ``listed`` (a term that is listed twice counts twice) in an array of ``terms``."""
    overlap = may_overlap(terms)
    times: dict[int, list[str]] = {}
    for found in terms:
        n = sum(_also_there(found, term) if overlap else found == term for term in listed)
        times.setdefault(n, []).append(found)
    counts = [
        f"{f'{n} * ' if n > 1 else ''}size(filter({hits}, hit -> hit IN ({', '.join(map(sql_text, found))})))"
        for n, found in times.items() if n
    ]
    return f"coalesce({' + '.join(counts)}, 0)" if counts else "0"


def keyword_count(text: str, terms: Iterable[str]) -> str:
    """SQL text: number of whole-word hits of all ``terms`` in ``text``, ignoring case.

    Every term counts by itself: overlapping hits of different terms all count, repeated terms count again. Only terms
    that can overlap with themselves take a pass of their own.
    """
    terms = list(terms)
    alone = [term for term in terms if _self_overlaps(term)]
    together = [term for term in terms if term not in alone]
    distinct = list(dict.fromkeys(together))
    parts = [f"regexp_count(lower({text}), {sql_text(whole_word_pattern([term]))})" for term in alone]
    if distinct and len(distinct) == len(together) and not may_overlap(distinct):
        parts.append(f"regexp_count(lower({text}), {sql_text(whole_word_pattern(distinct))})")
    elif distinct:
        hits = _hit_array(text, distinct)
        parts.append(f"transform(array({hits}), hits -> {_count_of('hits', together, distinct)})[0]")
    return " + ".join(parts) or "0"


def with_keyword_counts(df: DataFrame, text: str, lists: Mapping[str, Iterable[str]]) -> DataFrame:
    """Adds one count column per word list, reading each text once for all lists together.

    The hits of the union of the lists are extracted in one pass, overlaps included, and then sorted into the lists. Terms
    that can overlap with themselves take a pass of their own.
    """
    lists = {name: list(terms) for name, terms in lists.items()}
    alone = {term for terms in lists.values() for term in terms if _self_overlaps(term)}
    union = list(dict.fromkeys(term for terms in lists.values() for term in terms if term not in alone))
    hits = _hit_array(text, union) if union else "array()"
    counts = []
    for name, terms in lists.items():
        own = [f"coalesce({keyword_count(text, [term])}, 0)" for term in terms if term in alone]
        shared = _count_of("_hits", [term for term in terms if term not in alone], union)
        counts.append(f"{' + '.join([shared, *own])} AS {name}")
    return df.selectExpr("*", f"{hits} AS _hits").selectExpr("* EXCEPT (_hits)", *counts)


def sentiment(positive: str, negative: str) -> str:
    """SQL text: (positive - negative) / (positive + negative), and 0 where there is no hit at all."""
    return f"coalesce(try_divide(double({positive} - {negative}), {positive} + {negative}), 0D)"
