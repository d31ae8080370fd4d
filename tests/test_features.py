from datetime import datetime
from decimal import Decimal

import pytest

from returns_risk import build_features, constants as c, score_new
from returns_risk.operators import rules
from returns_risk.operators.clean import clean_retail
from returns_risk.operators.features import account_age, retail_summary, sanitize, ticket_summary
from returns_risk.operators.text_features import score_text

RETAIL = "InvoiceNo string, Quantity int, InvoiceDate string, UnitPrice decimal(12,2), CustomerID long"
TICKETS = "TicketID long, CustomerEmail string, TicketType string, TicketDescription string, DateOfPurchase string"


def lines(spark, rows):
    return spark.createDataFrame([(a, b, d, Decimal(p), k) for a, b, d, p, k in rows], RETAIL)


LINES = [
    ("1", 10, "2020-01-01 23:00:00", "2.50", 1), ("1", 5, "2020-01-01 23:00:00", "0.00", 1),
    ("C2", -6, "2020-01-03 01:00:00", "2.50", 1), (None, 1, "2020-01-02 01:00:00", "1.00", 1),
    ("C3", -4, "2020-01-01 00:00:00", "1.00", 2), ("4", 3, "2020-01-01 00:00:00", "1.00", 3),
]
TICKET_ROWS = [
    (1, "a@x", "Refund request", "refund please, item missing", "2020-01-01"),
    (2, "a@x", "Refund request", "Great, thank you", "2020-01-01"),
    (None, "b@x", "refund request", None, "2020-01-01"),
    (4, "c@x", None, "broken", "2020-01-01"),
    (5, None, "Delivery issue", "broken", "2020-01-01"),
]
LINKS = [("a@x", 1), ("b@x", 1), ("c@x", 99), ("unused@x", 2)]


@pytest.fixture(scope="module")
def linked(spark):
    links = spark.createDataFrame(LINKS, "CustomerEmail string, Simulated_CustomerID long")
    features = build_features(lines(spark, LINES), spark.createDataFrame(TICKET_ROWS, TICKETS), links)
    assert features.columns == [c.CUSTOMER, *c.DATES, *c.FEATURES]
    return {r[0]: r for r in features.collect()}


def test_customer_with_tickets(linked):
    row = linked[1]
    assert row.FirstTransactionDate == datetime(2020, 1, 1, 23) and row.LastTransactionDate == datetime(2020, 1, 3, 1)
    assert list(row[3:]) == [2, 16, 6, 26.0, 15.0, 6 / 16, 15 / 26, 1, 2, 2, 0, 0, 1, 0, 1, (-1 + 1 + 0) / 3, -1.0]


def test_customer_without_tickets_and_without_purchases(linked):
    assert set(linked) == {1, 2, 3}
    assert list(linked[2][3:]) == [1, 0, 4, 0.0, 4.0, 0.0, 0.0, 0] + [0] * 7 + [0.0, 0.0]
    assert list(linked[3][3:10]) == [1, 3, 0, 3.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("ranges", [1, 2, 50])
def test_simulated_links_are_reproducible(spark, ranges):
    import hashlib

    features = build_features(
        lines(spark, LINES).repartition(3), spark.createDataFrame(TICKET_ROWS, TICKETS).repartition(4),
        ranges=ranges,
    )
    expected = {1: 0, 2: 0, 3: 0}
    for number, email, *_ in TICKET_ROWS:
        if email and number:
            expected[[1, 2, 3][int(hashlib.md5(email.encode()).hexdigest()[:15], 16) % 3]] += 1
    assert {r[0]: r.TotalTickets for r in features.collect()} == expected


def test_empty_inputs(spark):
    none, tickets = lines(spark, []), spark.createDataFrame(TICKET_ROWS, TICKETS)
    assert build_features(none, tickets).count() == 0
    assert score_new(none, tickets).collect() == []
    without = build_features(lines(spark, LINES), spark.createDataFrame([], TICKETS))
    assert without.count() == 3 and without.agg({"TotalTickets": "sum"}).first()[0] == 0


def test_all_dates_missing_gives_age_zero(spark):
    kept = clean_retail(lines(spark, [("1", 1, "nope", "1.00", 5)]), on_bad_date="keep")
    row = retail_summary(kept).first()
    assert (row.AccountAgeDays, row.FirstTransactionDate) == (0, None)


def test_value_sums_are_the_same_for_every_price_type(spark):
    typed = clean_retail(lines(spark, LINES))
    expected = retail_summary(typed).orderBy("CustomerID").collect()
    for kind in ("double", "decimal(18,6)", "decimal(30,4)"):
        other = typed.selectExpr("* EXCEPT (UnitPrice)", f"CAST(UnitPrice AS {kind}) AS UnitPrice")
        assert retail_summary(other).orderBy("CustomerID").collect() == expected


def test_account_age_counts_whole_days(spark):
    got = spark.sql(f"""SELECT {account_age("timestamp_ntz'2020-01-01 23:00'", "timestamp_ntz'2020-01-03 01:00'")},
                               {account_age("timestamp_ntz'2020-01-01 23:00'", "CAST(NULL AS timestamp_ntz)")}""").first()
    assert tuple(got) == (1, 0)


def test_sanitize(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, v, n) for v, n in ((inf, 1), (-inf, None), (nan, 2), (None, 3), (0.5, 4))], "k int, x double, n long")
    got = [tuple(r) for r in sanitize(df, ("x", "n")).collect()]
    assert got == [(1, 0.0, 1), (1, 0.0, 0), (1, 0.0, 2), (1, 0.0, 3), (1, 0.5, 4)]


def test_hot_customer_is_split_by_invoice(spark):
    plan = retail_summary(clean_retail(lines(spark, LINES)))._jdf.queryExecution().executedPlan().toString()
    assert "CustomerID" in plan and plan.count("Exchange hashpartitioning") == 2 and "Expand" not in plan


@pytest.mark.parametrize("kind", ["double", "decimal(12,2)"])
def test_a_price_that_is_no_number_flags_nobody(spark, kind):
    rows = [("1", 5, "12/1/2010 8:26", 10.0, 1), ("C2", -1, "12/2/2010 8:26", float("nan") if kind == "double" else None, 1)]
    retail = spark.createDataFrame(rows, "InvoiceNo string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID long")
    retail = retail.withColumn("UnitPrice", retail.UnitPrice.cast(kind))
    tickets = spark.createDataFrame([(1, "a@x", "Refund request", "item missing", None)], "TicketID long, CustomerEmail string, TicketType string, TicketDescription string, DateOfPurchase string")
    row = rules.abuse_label(build_features(retail, tickets)).first()
    assert (row.TotalPurchaseValue, row.TotalRefundValue, row.RefundRate_by_Value, row.rule_b) == (50.0, 0.0, 0.0, False)
    broken = spark.createDataFrame([(float("nan"), float("nan"))], "RefundRate_by_Items double, RefundRate_by_Value double")
    assert broken.selectExpr(rules.CONDITIONS["items_rate"], rules.CONDITIONS["value_rate"]).first()[:] == (None, None)


def test_large_values_do_not_overflow(spark):
    rows = [("1", 2_000_000_000, "12/1/2010 8:26", 10_000, 1)] * 5
    retail = spark.createDataFrame(rows, "InvoiceNo string, Quantity int, InvoiceDate string, UnitPrice long, CustomerID long")
    retail = retail.withColumn("UnitPrice", retail.UnitPrice.cast("decimal(18,6)"))
    tickets = spark.createDataFrame([], "TicketID long, CustomerEmail string, TicketType string, TicketDescription string, DateOfPurchase string")
    assert build_features(retail, tickets).first().TotalPurchaseValue == 1e14


def test_links_are_not_sent_around(spark):
    """A row of a small file made into many: Spark's estimate is that of the file."""
    links = spark.range(1000).selectExpr("id", "explode(sequence(0, 9)) AS k").selectExpr(
        "concat('u', id, '.', k, '@x') AS CustomerEmail", f"id AS {c.CUSTOMER}"
    )
    tickets = spark.range(300).selectExpr(
        "id AS TicketID", "concat('u', id * 7, '.', id % 20, '@x') AS CustomerEmail", "'t' AS TicketType", "'d' AS TicketDescription"
    )
    out = ticket_summary(score_text(tickets), links)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r[0]: r.TotalTickets for r in out.collect()} == {i * 7: 1 for i in range(143) if i % 20 < 10}
