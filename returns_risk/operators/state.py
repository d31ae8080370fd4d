"""Feature state that is kept between batches: new lines and tickets are added without reading old ones again.

A state holds sums by customer, the distinct (customer, invoice) pairs for the exact count of orders, ticket sums by
address, and the names of the batches in it. All of these merge: adding a batch reads the state and the batch, not the
history, and gives the features of all lines and tickets so far. A batch is named by the caller; one that is in the
state already changes nothing. A state is a folder of versions (``sources.store``), so a reader sees one batch wholly or
not at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from returns_risk import constants as c
from returns_risk.operators import features as f
from returns_risk.operators.clean import clean_retail, clean_tickets
from returns_risk.operators.scoring import score_features
from returns_risk.operators.text_features import score_text
from returns_risk.sources.store import newest_version, new_path, open_version, publish_version

_ADDED = ("TotalItemsPurchased", "TotalItemsReturned", "TotalPurchaseValue", "TotalRefundValue")
_TICKETS = (*c.TICKET_COUNTS, "_score_sum", "_scores")


def _customers(clean: DataFrame) -> DataFrame:
    """Mergeable sums by customer; money stays decimal, exact to the last digit."""
    price = clean.schema["UnitPrice"].dataType
    line = "Quantity * UnitPrice"
    if isinstance(price, DecimalType):
        line = f"CAST({line} AS decimal(38, {price.scale}))"
    return clean.groupBy("CustomerID").agg(
        F.expr("coalesce(sum(bigint(PurchaseQuantity)), 0L) AS TotalItemsPurchased"),
        F.expr("coalesce(sum(bigint(ReturnQuantity)), 0L) AS TotalItemsReturned"),
        F.expr(f"sum(greatest({line}, 0)) AS TotalPurchaseValue"), F.expr(f"sum(greatest(-({line}), 0)) AS TotalRefundValue"),
        F.min("InvoiceDate").alias(c.DATES[0]), F.max("InvoiceDate").alias(c.DATES[1]),
    )


def _parts(
    retail: DataFrame, tickets: DataFrame, date_formats: Sequence[str], on_bad_date: str, negative_terms: Sequence[str]
) -> dict[str, DataFrame]:
    clean = clean_retail(retail, date_formats, on_bad_date)
    scored = score_text(clean_tickets(tickets), negative=negative_terms).where("CustomerEmail IS NOT NULL")
    return {
        "customers": _customers(clean),
        "invoices": clean.where("InvoiceNo IS NOT NULL").select("CustomerID", "InvoiceNo").distinct(),
        "addresses": f.ticket_totals(scored, "CustomerEmail"),
    }


def _merged(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    both = {name: old[name].unionByName(new[name]) for name in new}
    first, last = c.DATES
    sums = [F.sum(name).alias(name) for name in _ADDED]
    return {
        "customers": both["customers"].groupBy("CustomerID").agg(*sums, F.min(first).alias(first), F.max(last).alias(last)),
        "invoices": both["invoices"].distinct(),
        "addresses": both["addresses"].groupBy("CustomerEmail").agg(
            *[F.sum(name).alias(name) for name in _TICKETS], F.min("MinTicketSentimentScore").alias("MinTicketSentimentScore")
        ),
    }


def _read(spark: SparkSession, version: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{version}/{name}") for name in ("customers", "invoices", "addresses", "batches")}


def add_batch(
    state: str, batch: str, retail: DataFrame, tickets: DataFrame, date_formats: Sequence[str] = c.MONTH_FIRST,
    on_bad_date: str = "drop", negative_terms: Sequence[str] = c.NEGATIVE_TERMS,
) -> bool:
    """Adds raw lines and tickets to the state in the folder ``state``, which is made if it isn't there.

    False, and nothing is read or written, if a batch of this name is in the state. Batches may come in any order; they
    must not be added at the same time. Customers, invoices and addresses may come up in any number of batches.
    """
    spark = retail.sparkSession
    try:
        old = _read(spark, newest_version(spark, state))
    except FileNotFoundError:
        old = None
    if old and old["batches"].where(F.col("batch") == batch).limit(1).count():
        return False
    parts = _parts(retail, tickets, date_formats, on_bad_date, negative_terms)
    names = spark.createDataFrame([(batch,)], "batch string")
    if old:
        parts, names = _merged(old, parts), old["batches"].unionByName(names)
    folder = open_version(spark, state)
    for name, df in {**parts, "batches": names.coalesce(1)}.items():
        df.write.parquet(f"{folder}/{name}")
    publish_version(spark, folder)
    return True


def state_features(spark: SparkSession, state: str, links: DataFrame) -> DataFrame:
    """The feature row of every customer in the state: what :func:`plans.compose.build_features` gives for all batches."""
    found = _read(spark, newest_version(spark, state))
    orders = found["invoices"].groupBy("CustomerID").agg(F.count("*").alias("TotalUniqueOrders"))
    money = [f"coalesce(double({name}), 0D) AS {name}" for name in _ADDED[2:]]
    summary = found["customers"].join(orders, "CustomerID", "left").selectExpr(
        f"CustomerID AS {c.CUSTOMER}", "coalesce(TotalUniqueOrders, 0L) AS TotalUniqueOrders", *_ADDED[:2], *money, *c.DATES
    )
    return f.combine(f.with_rates(summary), f.linked_totals(found["addresses"], links))


def score_state(
    spark: SparkSession, state: str, links: DataFrame, scorer: PipelineModel | DataFrame | Mapping[str, float] = c.SCORE_WEIGHTS
) -> DataFrame:
    """Scores of all customers so far. The cost grows with customers and addresses, not with lines and tickets."""
    return score_features(state_features(spark, state, links), scorer)
