"""Keyword counts and sentiment per ticket."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from returns_risk.constants import KEYWORD_LISTS, NEGATIVE_TERMS, POSITIVE_TERMS
from returns_risk.functions.text import sentiment, with_keyword_counts


def score_text(
    tickets: DataFrame,
    text: str = "TicketDescription",
    keyword_lists: Mapping[str, Iterable[str]] = KEYWORD_LISTS,
    positive: Iterable[str] = POSITIVE_TERMS,
    negative: Iterable[str] = NEGATIVE_TERMS,
    score: str = "TicketSentimentScore",
) -> DataFrame:
    """Adds one hit count per keyword list and the lexicon sentiment in -1..1."""
    lists = {**keyword_lists, "_positive": positive, "_negative": negative}
    return with_keyword_counts(tickets, text, lists).selectExpr(
        "* EXCEPT (_positive, _negative)", f"{sentiment('_positive', '_negative')} AS {score}"
    )
