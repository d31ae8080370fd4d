"""Typing and cleaning of the two inputs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from returns_risk.constants import MONTH_FIRST
from returns_risk.functions.numeric import sql_text

# Rows read, rows without customer, and rows with customer but without a valid date.
DROP_COUNTS = {
    "rows_read": "count(1)",
    "missing_customer": "count_if(CustomerID IS NULL)",
    "bad_date": "count_if(CustomerID IS NOT NULL AND InvoiceDate IS NULL)",
}


def _numbers(fmt: str) -> tuple[str, dict[str, int]] | None:
    """A regular expression for the shapes (digits as 0) of texts that ``fmt`` can read, and the place of each letter's
    number, if the format is all numbers."""
    widths = {"yyyy": "0{4}", "MM": "0{2}", "dd": "0{2}", "HH": "0{2}", "mm": "0{2}", "ss": "0{2}", "M": "0{1,2}",
              "d": "0{1,2}", "H": "0{1,2}"}
    shape, places, first = "", {}, int(not fmt[:1].isalpha())
    for letter, more, other in re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", fmt):
        if other:
            shape += re.escape(other)
        elif letter + more in widths:
            shape += widths[letter + more]
            places[letter] = first + len(places)
        else:
            return None
    return f"^{shape}$", places


def _attempt(text: str, fmt: str) -> str:
    if fmt == "iso":
        return f"try_cast({text} AS timestamp_ntz)"
    numbers = _numbers(fmt)
    if numbers is None:
        return f"CAST(try_to_timestamp({text}, {sql_text(fmt)}) AS timestamp_ntz)"
    # Built from the parts of the text: no session time zone has a say, and no failed parse costs an exception.
    shape, places = numbers
    parts = [f"int(cut.parts[{places[letter]}])" if letter in places else "0" for letter in "yMdHms"]
    return f"if(cut.shape RLIKE {sql_text(shape)}, try_make_timestamp_ntz({', '.join(parts)}), NULL)"


def parse_date(text: str, formats: Sequence[str] = MONTH_FIRST) -> str:
    """SQL text: wall-clock time from ``text`` in any of ``formats``; null where none fits.

    Formats of numbers only, and ISO, are read without any time zone. Others go through the session's. The text is cut
    into its numbers once for all formats of numbers that stand next to each other in the list.
    """
    attempts: list[str] = []
    for together, group in groupby(formats, lambda fmt: fmt != "iso" and _numbers(fmt) is not None):
        tries = [_attempt(text, fmt) for fmt in group]
        if together:
            cut = f"struct(translate({text}, '123456789', '000000000') AS shape, split({text}, '[^0-9]+') AS parts)"
            tries = [f"transform(array({cut}), cut -> coalesce({', '.join(tries)}))[0]"]
        attempts += tries
    return f"coalesce({', '.join(attempts)})"


def parse_date_strict(text: str, formats: Sequence[str] = MONTH_FIRST) -> str:
    """As :func:`parse_date`, but text that fits no format fails the query."""
    failure = f"CAST(raise_error(concat('Not a date: ', {text})) AS timestamp_ntz)"
    return f"coalesce({parse_date(text, formats)}, if({text} IS NULL, NULL, {failure}))"


def type_retail(
    df: DataFrame, date_formats: Sequence[str] = MONTH_FIRST, on_bad_date: str = "drop"
) -> DataFrame:
    """Customer number as long, invoice date as timestamp, a price that is no number as null; no row is dropped."""
    kinds = dict(df.dtypes)
    customer, date = "bigint(CustomerID)", "CAST(InvoiceDate AS timestamp_ntz)"
    if kinds["CustomerID"] in ("double", "float"):
        customer = "bigint(nanvl(CustomerID, NULL))"
    if kinds["InvoiceDate"] == "string":
        parse = parse_date_strict if on_bad_date == "raise" else parse_date
        date = parse("InvoiceDate", date_formats)
    columns = {"CustomerID": F.expr(customer), "InvoiceDate": F.expr(date)}
    if kinds["UnitPrice"] in ("double", "float"):
        columns["UnitPrice"] = F.expr("nanvl(UnitPrice, NULL)")
    return df.withColumns(columns)


def clean_retail(
    df: DataFrame,
    date_formats: Sequence[str] = MONTH_FIRST,
    on_bad_date: str = "drop",
    counts: Observation | None = None,
) -> DataFrame:
    """Typed invoice lines with customer, plus return flag, split quantities and line value.

    ``on_bad_date``: "drop" the row, "keep" it with a null date, or "raise". ``counts`` collects
    ``DROP_COUNTS`` while the rows pass by, so that the counts cost no extra scan.
    """
    if on_bad_date not in ("drop", "keep", "raise"):
        raise ValueError(f"on_bad_date must be 'drop', 'keep' or 'raise', not {on_bad_date!r}")
    typed = type_retail(df, date_formats, on_bad_date)
    if counts is not None:
        typed = typed.observe(counts, *[F.expr(count).alias(name) for name, count in DROP_COUNTS.items()])
    dated = "" if on_bad_date == "keep" else " AND InvoiceDate IS NOT NULL"
    return typed.where(f"CustomerID IS NOT NULL{dated}").selectExpr(
        "*",
        "coalesce(startswith(InvoiceNo, 'C'), false) OR coalesce(Quantity < 0, false) AS IsReturn",
        "if(Quantity > 0, Quantity, 0) AS PurchaseQuantity",
        "if(Quantity < 0, -Quantity, 0) AS ReturnQuantity",
        "Quantity * UnitPrice AS LineTotal",
    )


def dropped_rows(df: DataFrame, date_formats: Sequence[str] = MONTH_FIRST) -> DataFrame:
    """One row with the ``DROP_COUNTS`` of raw invoice lines."""
    counts = [f"{count} AS {name}" for name, count in DROP_COUNTS.items()]
    return type_retail(df, date_formats).selectExpr(*counts)


def unreadable_dates(df: DataFrame) -> DataFrame:
    """One row: tickets read, and tickets whose purchase date is there but cannot be read."""
    bad = f"DateOfPurchase IS NOT NULL AND {parse_date('DateOfPurchase')} IS NULL"
    return df.selectExpr("count(1) AS tickets", f"count_if({bad}) AS bad_purchase_date")


def clean_tickets(df: DataFrame, parse_purchase_date: bool = True, on_bad_date: str = "raise") -> DataFrame:
    """Tickets with a parsed purchase date and with empty text instead of none.

    ``on_bad_date``: "raise" where the date is used, or "keep" the row with a null date. A query that
    never uses the date does not look at it; :func:`unreadable_dates` counts what would fail.
    """
    if on_bad_date not in ("raise", "keep"):
        raise ValueError(f"on_bad_date must be 'raise' or 'keep', not {on_bad_date!r}")
    parse = parse_date_strict if on_bad_date == "raise" else parse_date
    columns = {"TicketDescription": F.expr("coalesce(TicketDescription, '')")}
    if parse_purchase_date and dict(df.dtypes)["DateOfPurchase"] == "string":
        columns["DateOfPurchase"] = F.expr(f"date({parse('DateOfPurchase')})")
    return df.withColumns(columns)
