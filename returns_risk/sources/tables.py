"""Invoice lines and tickets derived from the order and event tables of the test data.

The expressions are fixed by the recipe in FIXTURES.md, section 4; the SQL twins are in
plans/oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.functions.numeric import sql_text

# Ticket text by phrase number.
PHRASES = (
    "I want a refund. Please cancel and give my money back.",
    "The item arrived damaged and broken, this is a problem.",
    "My parcel is missing; it never arrived. Where is my order?",
    "Great service, thank you. Issue resolved.",
    "Happy and satisfied with the excellent product.",
    "How do I change my delivery address?",
    "Returned goods were refunded; unresolved ticket about unhappy returns.",
    None,
    "REFUND refund Refund-credit: not working, faulty.",
    "Thank you, but the box was poor and not received.",
)
# Ticket type by event type; any other event has none.
TYPE_OF_EVENT = {
    "error": "Refund request",
    "click": "Delivery issue",
    "view": "Product inquiry",
    "purchase": "Billing inquiry",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines meet their orders by shuffle on the order number, whatever the size: orders grow with lines, so a broadcast
    would not last, and all that follows runs in as many tasks as the shuffle has, even if the lines are one file."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").hint("merge")
    parts = table(spark, folder, "part")
    returned = """CASE WHEN o_custkey % 50 = 3 THEN true
                       WHEN o_custkey % 4 = 0 THEN false
                       ELSE l_returnflag = 'R' AND l_linestatus = 'F' END AS ret"""
    return (
        lines.join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(parts, F.expr("l_partkey = p_partkey"))
        .selectExpr(
            "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "p_retailprice", "o_custkey", returned
        )
        .selectExpr(
            """concat(if((ret AND l_orderkey % 29 <> 0) OR l_orderkey % 31 = 0, 'C', ''),
                      string(l_orderkey)) AS InvoiceNo""",
            "int(if(ret, -l_quantity, l_quantity)) AS Quantity",
            """if(l_orderkey % 41 = 0, 'not a date',
                  concat(substr(string(l_shipdate), 1, 10), ' ',
                         lpad(string(l_linenumber * 3), 2, '0'), ':15:00')) AS InvoiceDate""",
            "CAST(p_retailprice AS decimal(12,2)) AS UnitPrice",
            "if(l_orderkey % 37 = 0, NULL, o_custkey) AS CustomerID",
        )
    )


def support_tickets(spark: SparkSession, folder: str, long_text: bool = False) -> DataFrame:
    """Tickets from events; ``long_text`` appends the document with the number of the event."""
    source = table(spark, folder, "events")
    types = " ".join(f"WHEN {sql_text(event)} THEN {sql_text(kind)}" for event, kind in TYPE_OF_EVENT.items())
    phrases = " ".join(f"WHEN {i} THEN {sql_text(p)}" for i, p in enumerate(PHRASES) if p is not None)
    phrase = f"CASE (event_id * 7919) % 10 {phrases} END"
    if long_text:
        documents = table(spark, folder, "documents").hint("merge")  # texts are too large to send around, as above
        source = source.join(documents, F.expr("event_id = doc_id"), "left")
        phrase = f"concat(coalesce({phrase}, ''), ' ', coalesce(text, ''))"
    return source.selectExpr(
        "event_id AS TicketID",
        """if(event_id % 97 = 0, NULL,
              concat('user', user_id, '.', event_id % 20, '@example.com')) AS CustomerEmail""",
        f"CASE event_type {types} END AS TicketType",
        f"{phrase} AS TicketDescription",
        "substr(string(ts), 1, 10) AS DateOfPurchase",
    )


def long_ticket_bytes(spark: SparkSession, folder: str) -> int:
    """About how many bytes the tickets with documents take as text. Only numbers and lengths are joined, no texts."""
    lengths = table(spark, folder, "documents").selectExpr("doc_id", "octet_length(text) AS n").hint("merge")
    tickets = table(spark, folder, "events").join(lengths, F.expr("event_id = doc_id"), "left")
    return tickets.selectExpr("coalesce(sum(150L + coalesce(n, 0)), 0L) AS bytes").first().bytes


def account_links(spark: SparkSession, folder: str) -> DataFrame:
    """A link table from the customer table: ten addresses per customer, (CustomerEmail, Simulated_CustomerID).

    Tickets also use ten more addresses per user, which stay without a customer.
    """
    return table(spark, folder, "customer").selectExpr("c_custkey", "explode(sequence(0, 9)) AS k").selectExpr(
        "concat('user', c_custkey, '.', k, '@example.com') AS CustomerEmail",
        "c_custkey AS Simulated_CustomerID",
    )
