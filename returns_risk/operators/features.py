"""Customer summaries and the seventeen-feature row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from returns_risk.constants import (
    CUSTOMER, DATES, FEATURES, KEYWORD_LISTS, TICKET_COUNTS, TICKET_SCORES, TICKET_TYPES,
)
from returns_risk.functions.numeric import finite_or_zero, safe_ratio, sql_text

# Feature name of each keyword column, in the same order.
KEYWORD_FEATURES = dict(zip(TICKET_COUNTS[4:], KEYWORD_LISTS, strict=True))


def _value_sums(df: DataFrame) -> tuple[str, str]:
    """Sums of the positive and of the negative line values, as doubles.

    Decimal prices are summed exactly, with 38 digits: the result does not depend on the order of rows,
    and no sum of real prices comes near the limit.
    """
    price = df.schema["UnitPrice"].dataType
    line = "Quantity * UnitPrice"
    if isinstance(price, DecimalType):
        line = f"CAST({line} AS decimal(38, {price.scale}))"
    return f"double(sum(greatest({line}, 0)))", f"double(sum(greatest(-({line}), 0)))"


def account_age(first: str, last: str) -> str:
    """SQL text: whole periods of 24 hours between two times; 0 where either is missing."""
    return f"coalesce(timestampdiff(DAY, {first}, {last}), 0L)"


def retail_summary(clean: DataFrame, key: str = "CustomerID") -> DataFrame:
    """One row per customer: seven aggregates, two refund rates and the account age.

    The distinct count makes Spark aggregate by (customer, invoice) first, so the lines of one very
    large customer are spread by invoice before they meet.
    """
    bought, refunded = _value_sums(clean)
    totals = {
        "TotalUniqueOrders": "count(DISTINCT InvoiceNo)",
        "TotalItemsPurchased": "coalesce(sum(bigint(PurchaseQuantity)), 0L)",
        "TotalItemsReturned": "coalesce(sum(bigint(ReturnQuantity)), 0L)",
        "TotalPurchaseValue": f"coalesce({bought}, 0D)",
        "TotalRefundValue": f"coalesce({refunded}, 0D)",
        "FirstTransactionDate": "min(InvoiceDate)",
        "LastTransactionDate": "max(InvoiceDate)",
    }
    return with_rates(clean.groupBy(key).agg(*[F.expr(total).alias(name) for name, total in totals.items()]))


def with_rates(summary: DataFrame) -> DataFrame:
    """Adds the two refund rates and the account age to the seven aggregates."""
    return summary.selectExpr(
        "*",
        f"{safe_ratio('TotalItemsReturned', 'TotalItemsPurchased')} AS RefundRate_by_Items",
        f"{safe_ratio('TotalRefundValue', 'TotalPurchaseValue')} AS RefundRate_by_Value",
        f"{account_age(*DATES)} AS AccountAgeDays",
    )


def ticket_totals(scored: DataFrame, key: str) -> DataFrame:
    """Mergeable ticket sums per ``key``: counts, score sum and number of scores, lowest score."""
    totals = {"TotalTickets": "count(TicketID)"}
    totals |= {name: f"count_if(TicketType = {sql_text(kind)})" for name, kind in TICKET_TYPES.items()}
    totals |= {name: f"sum(bigint({source}))" for name, source in KEYWORD_FEATURES.items()}
    totals |= {
        "_score_sum": "sum(TicketSentimentScore)",
        "_scores": "count(TicketSentimentScore)",
        "MinTicketSentimentScore": "min(TicketSentimentScore)",
    }
    return scored.groupBy(key).agg(*[F.expr(total).alias(name) for name, total in totals.items()])


def _finish(totals: DataFrame, key: str) -> DataFrame:
    mean = "try_divide(_score_sum, _scores) AS AvgTicketSentimentScore"
    return totals.selectExpr(key, *TICKET_COUNTS, mean, "MinTicketSentimentScore")


def ticket_summary(scored: DataFrame, links: DataFrame) -> DataFrame:
    """Nine ticket aggregates per customer, by a link table with one row per address.

    Tickets are summed per address before the join, so one address with very many tickets is one
    row there; addresses without a customer fall out.
    """
    return linked_totals(ticket_totals(scored.where("CustomerEmail IS NOT NULL"), "CustomerEmail"), links)


def linked_totals(per_email: DataFrame, links: DataFrame) -> DataFrame:
    """The ticket aggregates per customer from the sums per address.

    Both sides are shuffled, whatever their size: a link table grows with the customers, and if it is derived (a row of
    a file made into many) it is far larger than Spark estimates, too large to be sent around.
    """
    linked = per_email.join(links.where(f"{CUSTOMER} IS NOT NULL").hint("merge"), "CustomerEmail")
    merged = linked.groupBy(CUSTOMER).agg(
        *[F.sum(name).alias(name) for name in (*TICKET_COUNTS, "_score_sum", "_scores")],
        F.min("MinTicketSentimentScore").alias("MinTicketSentimentScore"),
    )
    return _finish(merged, CUSTOMER)


def ticket_summary_by_slot(scored: DataFrame, slot: str, name: str) -> DataFrame:
    """The ticket aggregates per simulated customer slot: one shuffle, no join."""
    slotted = scored.selectExpr("*", f"{slot} AS {name}").where(f"{name} IS NOT NULL")
    return _finish(ticket_totals(slotted, name), name)


def combine(summary: DataFrame, tickets: DataFrame, on: str = CUSTOMER) -> DataFrame:
    """The feature row of every retail customer; customers without tickets get zeros.

    Both sides have one row per key. Counts stay long.
    """
    zeros = {name: "0L" for name in TICKET_COUNTS} | {name: "0D" for name in TICKET_SCORES}
    features = [f"coalesce({name}, {zeros[name]}) AS {name}" if name in zeros else name for name in FEATURES]
    return summary.join(tickets, on, "left").selectExpr(CUSTOMER, *DATES, *features)


def sanitize(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Null, NaN and infinite feature values become 0; integer columns keep their type."""

    def cleaned(name: str, kind: str) -> str:
        if name not in columns:
            return f"`{name}`"
        value = finite_or_zero(name) if kind in ("double", "float") else f"coalesce({name}, {kind}(0))"
        return f"{value} AS {name}"

    return df.selectExpr(*[cleaned(name, kind) for name, kind in df.dtypes])
