"""The steps put together: raw tables in, feature rows and scores out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from returns_risk import constants as c
from returns_risk.operators import features as f
from returns_risk.operators.clean import clean_retail, clean_tickets
from returns_risk.operators.link import SLOT, email_slot, number_customers
from returns_risk.operators.scoring import score_features
from returns_risk.operators.text_features import score_text
from returns_risk.sources.store import write_once


def numbered_summary(clean: DataFrame, ranges: int | None = None) -> tuple[DataFrame, int]:
    """The retail summary with the slot of each customer, and the number of customers.

    Runs at once: the invoice lines are read here, once; the numbering works on the stored customer rows.
    """
    summary = f.retail_summary(clean).withColumnRenamed("CustomerID", c.CUSTOMER)
    stored = write_once(summary, "retail_summary")
    customers = stored.count()
    return number_customers(stored, c.CUSTOMER, ranges), customers


def build_features(
    retail: DataFrame,
    tickets: DataFrame,
    links: DataFrame | None = None,
    date_formats: Sequence[str] = c.MONTH_FIRST,
    on_bad_date: str = "drop",
    negative_terms: Sequence[str] = c.NEGATIVE_TERMS,
    ranges: int | None = None,
) -> DataFrame:
    """Raw invoice lines and tickets to one feature row per customer.

    With ``links`` (CustomerEmail, Simulated_CustomerID) nothing runs until the result is used.
    Without, tickets go to pseudo-random customers, which takes the number of customers: the retail
    summary is then computed and stored at once.
    """
    clean = clean_retail(retail, date_formats, on_bad_date)
    scored = score_text(clean_tickets(tickets), negative=negative_terms)
    if links is not None:
        summary = f.retail_summary(clean).withColumnRenamed("CustomerID", c.CUSTOMER)
        return f.combine(summary, f.ticket_summary(scored, links))
    summary, customers = numbered_summary(clean, ranges)
    by_slot = f.ticket_summary_by_slot(scored, email_slot("CustomerEmail", customers), SLOT)
    return f.combine(summary, by_slot, SLOT)


def score_new(
    retail: DataFrame,
    tickets: DataFrame,
    links: DataFrame | None = None,
    scorer: PipelineModel | DataFrame | Mapping[str, float] = c.SCORE_WEIGHTS,
) -> DataFrame:
    """Feature rows of new raw tables with probability and class of a saved or linear scorer."""
    return score_features(build_features(retail, tickets, links), scorer)
