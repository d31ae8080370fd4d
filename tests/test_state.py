import random
from decimal import Decimal

import pytest

from returns_risk import constants as c
from returns_risk.operators.scoring import score_features
from returns_risk.operators.state import add_batch, score_state, state_features
from returns_risk.plans.compose import build_features
from returns_risk.sources.store import new_path, newest_version
from returns_risk.sources.tables import PHRASES

RETAIL = "InvoiceNo string, Quantity int, InvoiceDate string, UnitPrice decimal(12,2), CustomerID long"
TICKETS = "TicketID long, CustomerEmail string, TicketType string, TicketDescription string, DateOfPurchase string"


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(8)
    lines = [
        (f"{rng.choice(['C', ''])}{rng.randint(1, 60)}" if rng.random() < 0.97 else None, rng.randint(-5, 9),
         rng.choice(["2020-01-05 10:00:00", "3/4/2021 8:26", "no date", "2021-12-31 23:59:00"]), Decimal(rng.randint(0, 999)) / 100,
         rng.randint(1, 25) if rng.random() < 0.95 else None)
        for _ in range(900)
    ]
    tickets = [
        (k, f"u{rng.randint(1, 40)}@x.org" if k % 9 else None, rng.choice(list(c.TICKET_TYPES.values()) + [None]), rng.choice(PHRASES), "2021-03-22")
        for k in range(500)
    ]
    links = spark.createDataFrame([(f"u{k}@x.org", k % 20 + 1 if k % 4 else None) for k in range(1, 41)], f"CustomerEmail string, {c.CUSTOMER} long")
    return spark.createDataFrame(lines, RETAIL), spark.createDataFrame(tickets, TICKETS), links


def rounded(df):
    rows = df.selectExpr("* EXCEPT (AvgTicketSentimentScore)", "round(AvgTicketSentimentScore, 9) AS AvgTicketSentimentScore")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_batches_add_up_to_the_whole(spark, history):
    retail, tickets, links = history
    state = new_path(spark, "state")
    batches = [(name, f"pmod(crc32(binary(coalesce(InvoiceNo, ''))), 3) = {k}", f"TicketID % 3 = {k}") for k, name in enumerate("abc")]
    for name, lines, own in batches:
        assert add_batch(state, name, retail.where(lines), tickets.where(own))
        assert not add_batch(state, name, retail.where(lines), tickets.where(own))  # counts once
    expected = build_features(retail, tickets, links)
    got = state_features(spark, state, links)
    assert got.columns == expected.columns and got.dtypes == expected.dtypes
    assert rounded(got) == rounded(expected) and got.count() == 25
    assert not add_batch(state, "a", retail, tickets)
    scored = {r[0]: r[1] for r in score_state(spark, state, links).select(c.CUSTOMER, c.PROBABILITY).collect()}
    assert scored == pytest.approx({r[0]: r[1] for r in score_features(expected).select(c.CUSTOMER, c.PROBABILITY).collect()})


def test_an_unfinished_batch_does_not_count(spark, history):
    retail, tickets, links = history
    state = new_path(spark, "state")
    with pytest.raises(FileNotFoundError):
        state_features(spark, state, links)
    add_batch(state, "a", retail.limit(0), tickets.limit(0))
    assert state_features(spark, state, links).count() == 0
    before = newest_version(spark, state)
    bad = retail.selectExpr("* EXCEPT (Quantity)", "int(raise_error('lost')) AS Quantity")
    with pytest.raises(Exception, match="lost"):
        add_batch(state, "b", bad, tickets)
    assert newest_version(spark, state) == before
    assert add_batch(state, "b", retail, tickets)
    assert rounded(state_features(spark, state, links)) == rounded(build_features(retail, tickets, links))
