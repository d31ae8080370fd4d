"""The rule label, readable reasons and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from returns_risk import constants as c
from returns_risk.functions.numeric import fill_template, sql_text

# Every condition by name, as SQL text. NaN counts as no value: Spark would hold it for larger than any limit.
_ITEMS_RATE = f"nanvl(RefundRate_by_Items, NULL) > {c.ITEMS_RATE_LIMIT}D"
_VALUE_RATE = f"nanvl(RefundRate_by_Value, NULL) > {c.VALUE_RATE_LIMIT}D"
_REFUND_TICKETS = f"Tickets_TypeRefundRequest >= {c.REFUND_TICKETS_MIN}"
_SENTIMENT = f"MinTicketSentimentScore < {c.SENTIMENT_LIMIT}D"
_RETURNED_ITEMS = f"TotalItemsReturned > {c.RETURNED_ITEMS_LIMIT}"
_MISSING = "Tickets_KeywordMissingCount > 0"
_DAMAGE = "Tickets_KeywordDamageCount > 0"
CONDITIONS = {
    "items_rate": _ITEMS_RATE,
    "value_rate": _VALUE_RATE,
    "refund_tickets": _REFUND_TICKETS,
    "sentiment": _SENTIMENT,
    "returned_items": _RETURNED_ITEMS,
    "missing": _MISSING,
    "damage": _DAMAGE,
    "missing_or_damage": f"({_MISSING} OR {_DAMAGE})",
    "rule_a": f"({_ITEMS_RATE} AND {_REFUND_TICKETS})",
    "rule_b": f"({_VALUE_RATE} AND ({_MISSING} OR {_DAMAGE}))",
    "rule_c": f"({_SENTIMENT} AND {_RETURNED_ITEMS})",
}
RULES = ("rule_a", "rule_b", "rule_c")


def abuse_label(features: DataFrame) -> DataFrame:
    """Adds the three rules as booleans and the 0/1 label: any rule holds."""
    held = {rule: f"coalesce({CONDITIONS[rule]}, false)" for rule in RULES}
    return features.selectExpr(
        "*", *[f"{condition} AS {rule}" for rule, condition in held.items()],
        f"int({' OR '.join(held.values())}) AS {c.LABEL}",
    )


def reasons(texts: tuple[tuple[str, str], ...]) -> str:
    """SQL text: the texts whose condition holds, in the order of the list, as ``array<string>``."""
    cases = [f"if({CONDITIONS[name]}, {fill_template(text)}, NULL)" for name, text in texts]
    return f"array_compact(array({', '.join(cases)}))"


def reasons_rules(df: DataFrame, texts=c.RULE_REASONS_BATCH, name: str = "reasons") -> DataFrame:
    """One text per satisfied rule; ``RULE_REASONS_FORM`` has the wording for single customers."""
    return df.selectExpr("*", f"{reasons(texts)} AS {name}")


def reasons_factors(df: DataFrame, name: str = "reasons") -> DataFrame:
    """Up to five single-factor texts; missing and damaged items share one."""
    return df.selectExpr("*", f"{reasons(c.FACTOR_REASONS_BATCH)} AS {name}")


def reasons_factors7(df: DataFrame, name: str = "reasons") -> DataFrame:
    """Up to seven single-factor texts, with the value rate and with missing and damaged apart."""
    return df.selectExpr("*", f"{reasons(c.FACTOR_REASONS_FORM)} AS {name}")


def _cases(style: str, given: str) -> list[tuple[str, str, str]]:
    """(condition, category, text) in order of precedence; the last one is unconditional."""
    none, flagged = f"size({given}) = 0", f"{c.PREDICTION} = 1"
    if style == "rules":
        return [(none, "none", c.NO_REASON_BATCH_RULES), ("true", "reasons", "")]
    if style == "factors":
        return [(none, "none", c.NO_REASON_BATCH_FACTORS), ("true", "reasons", "")]
    if style == "likelihood":
        return [
            (f"size({given}) > 0", "reasons", ""),
            (f"{c.PROBABILITY} > {c.LIKELY_ABOVE}D", "likely", c.LIKELY_TEXT),
            (f"{c.PROBABILITY} < {c.UNLIKELY_BELOW}D", "unlikely", c.UNLIKELY_TEXT),
            ("true", "neutral", c.NEUTRAL_TEXT),
        ]
    if style == "prediction":
        return [
            (f"{flagged} AND size({given}) > 0", "flagged_with_reasons", c.FLAGGED_WITH_REASONS_TEXT),
            (flagged, "flagged_no_reasons", c.FLAGGED_NO_REASONS_TEXT),
            (none, "clear_no_reasons", c.CLEAR_NO_REASONS_TEXT),
            ("true", "clear_with_reasons", c.CLEAR_WITH_REASONS_TEXT),
        ]
    raise ValueError(f"unknown style {style!r}")


def verdict(df: DataFrame, style: str, reasons_column: str = "reasons") -> DataFrame:
    """Adds ``verdict`` (flagged or not), ``category`` and the ``explanation`` that goes with it.

    Styles: "rules" and "factors" give a text only where no reason was found; "likelihood" goes by
    the probability where no reason was found; "prediction" goes by class and by having reasons.
    """
    cases = _cases(style, reasons_column)
    categories = " ".join(f"WHEN {condition} THEN {sql_text(name)}" for condition, name, _ in cases)
    explanations = " ".join(f"WHEN {condition} THEN {fill_template(text)}" for condition, _, text in cases)
    return df.selectExpr(
        "*",
        f"if({c.PREDICTION} = 1, {sql_text(c.FLAGGED_TEXT)}, {sql_text(c.NOT_FLAGGED_TEXT)}) AS verdict",
        f"CASE {categories} END AS category",
        f"CASE {explanations} END AS explanation",
    )


def flagged(df: DataFrame, by: str = c.LABEL) -> DataFrame:
    """The rows with 1 in the label or prediction column ``by``."""
    return df.where(f"{by} = 1")


def first_customers(df: DataFrame, n: int, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """The ``n`` lowest customer numbers: a top-k per task, never a full sort."""
    return df.orderBy(c.CUSTOMER).limit(n).select(*columns)
