"""The two CSV inputs: invoice lines and support tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, DecimalType

from returns_risk.constants import MISSING_CELLS, TICKET_COLUMNS
from returns_risk.functions.numeric import sql_text
from returns_risk.sources.split_csv import read_split_csv

# Wide enough that prices of a CSV file keep all their decimals.
PRICE = DecimalType(18, 6)


def read_text_columns(
    spark: SparkSession, path: str | list[str], encoding: str, multiline: bool
) -> DataFrame:
    """All columns as text under their header names, missing cells as null.

    The names come from the header row, and every file's header is checked against them. A missing
    path raises ``AnalysisException`` (PATH_NOT_FOUND).
    """
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )


def _present(name: str) -> str:
    missing = ", ".join(map(sql_text, MISSING_CELLS))
    return f"if(`{name}` IN ({missing}), NULL, `{name}`)"


def _whole_number(name: str, kind: str) -> str:
    """Text such as ``17850`` or ``17850.0`` as an integer; other text raises under ANSI mode."""
    return f"CAST(regexp_replace(trim({_present(name)}), '[.]0*$', '') AS {kind})"


def read_retail(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "ISO-8859-1",
    multiline: bool = False,
    price_type: DataType = PRICE,
) -> DataFrame:
    """Invoice lines: the five columns in use, dates still as text.

    Invoice lines hold no line breaks inside cells, so Spark may split large files. With ``multiline``
    each file is read by one task.
    """
    raw = read_text_columns(spark, path, encoding, multiline)
    return raw.selectExpr(
        f"{_present('InvoiceNo')} AS InvoiceNo",
        f"{_whole_number('Quantity', 'int')} AS Quantity",
        f"{_present('InvoiceDate')} AS InvoiceDate",
        f"CAST(trim({_present('UnitPrice')}) AS {price_type.simpleString()}) AS UnitPrice",
        f"{_whole_number('CustomerID', 'bigint')} AS CustomerID",
    )


def read_tickets(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "UTF-8",
    multiline: bool = True,
    split: bool = False,
) -> DataFrame:
    """Support tickets under space-free names, purchase dates still as text.

    Ticket texts may hold line breaks, so by default each file is read by one task. ``split`` reads large files by many
    tasks all the same, in two passes, the first at once: see :mod:`split_csv`.
    """
    raw = read_split_csv(spark, path, encoding) if split else read_text_columns(spark, path, encoding, multiline)
    cells = {old: _present(old) for old in TICKET_COLUMNS}
    cells["Ticket ID"] = _whole_number("Ticket ID", "bigint")
    return raw.selectExpr(*[f"{cells[old]} AS {new}" for old, new in TICKET_COLUMNS.items()])
