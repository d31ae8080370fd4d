"""Tickets to customers: by a given link table, or by a reproducible simulated one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returns_risk.constants import CUSTOMER
from returns_risk.operators.ranks import dense_index
from returns_risk.sources.store import write_once

SLOT = "_slot"
# Share of all rows that one address may bring to a task; no smaller one is accepted.
HOT_SHARE = 0.001


def email_slot(email: str, customers: int) -> str:
    """SQL text: a number in 0..customers-1 from the first 15 digits of the hash of the address.

    Null for a null address and where there are no customers.
    """
    if customers == 0:
        return "CAST(NULL AS bigint)"
    return f"bigint(conv(substr(md5({email}), 1, 15), 16, 10)) % {customers}L"


def number_customers(customers: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Adds the slot of each customer: its position by ascending number. ``customers`` is a stored table."""
    return dense_index(customers, key, SLOT, ranges)


def simulated_links(tickets: DataFrame, numbered: DataFrame, rows: int) -> DataFrame:
    """(CustomerEmail, Simulated_CustomerID): every distinct address gets a pseudo-random customer.

    Both sides of the join are free of hot keys: addresses are distinct and slots are drawn evenly.
    Tickets without address get no customer.
    """
    emails = tickets.select("CustomerEmail").where("CustomerEmail IS NOT NULL").distinct()
    slots = emails.selectExpr("*", f"{email_slot('CustomerEmail', rows)} AS {SLOT}")
    return slots.join(numbered.select(SLOT, CUSTOMER), SLOT).select("CustomerEmail", CUSTOMER)


def link_tickets(
    tickets: DataFrame, links: DataFrame, how: str = "inner", hot_share: float = HOT_SHARE
) -> DataFrame:
    """Each ticket with its customer. "inner" drops tickets without one, "left" keeps them.

    ``links`` has one row per address; rows without an address or a customer link nothing. Tickets are
    counted per address first, in a job of its own. An address with more than ``hot_share`` of all
    tickets is dealt out by its count, so that no lane holds more than that share. There are at most
    1 / ``hot_share`` such addresses, 1,000 with the least share accepted: their list is broadcast.
    Tickets without an address never meet the join. Links meet the tickets by shuffle, whatever their size: they
    grow with the customers, and derived ones are far larger than Spark estimates.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    if hot_share < HOT_SHARE:
        raise ValueError(f"hot_share must be at least {HOT_SHARE}")
    addressed = tickets.where("CustomerEmail IS NOT NULL")
    links = links.where(f"CustomerEmail IS NOT NULL AND {CUSTOMER} IS NOT NULL")
    per_email = write_once(addressed.groupBy("CustomerEmail").agg(F.expr("count(1) AS _n")), "tickets_per_address")
    most = per_email.agg(F.expr(f"{float(hot_share)}D * sum(_n)")).scalar()
    hot = F.broadcast(
        per_email.withColumn("_most", most).where("_n > _most")
        .selectExpr("CustomerEmail", "int(ceil(_n / _most)) AS _lanes")
    )
    lane = "coalesce(int(pmod(xxhash64(TicketID, TicketDescription), _lanes)), 0) AS _lane"
    lanes = "explode(sequence(0, coalesce(_lanes, 1) - 1)) AS _lane"
    dealt = addressed.join(hot, "CustomerEmail", "left").selectExpr("* EXCEPT (_lanes)", lane)
    dealt_links = links.join(hot, "CustomerEmail", "left").selectExpr("* EXCEPT (_lanes)", lanes)
    linked = dealt.join(dealt_links.hint("merge"), ["CustomerEmail", "_lane"], how).drop("_lane")
    if how == "inner":
        return linked
    return linked.unionByName(tickets.where("CustomerEmail IS NULL"), allowMissingColumns=True)
