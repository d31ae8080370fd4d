import pytest

from returns_risk.operators.link import email_slot, link_tickets
from returns_risk.operators.ranks import dense_index, totals_before
from returns_risk.sources.store import remove_tables, shared_folder, write_once

TICKETS = "TicketID long, CustomerEmail string, TicketType string, TicketDescription string"


@pytest.mark.parametrize("ranges", [1, 2, 50])
def test_dense_index_is_the_sorted_position(spark, ranges):
    keys = [i * i - 500 for i in range(997)] + [2**40, 2**41]
    table = write_once(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "keys")
    indexed = dense_index(table, "k", "i", ranges)
    assert {r.k: r.i for r in indexed.collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_totals_before_with_several_sums(spark):
    table = write_once(spark.range(500).selectExpr("id", "id % 7 AS a", "id % 3 AS b"), "sums")
    got = {r.id: (r.x, r.y) for r in totals_before(table, "id", {"x": "a", "y": "b"}, 6).collect()}
    assert got == {n: (sum(i % 7 for i in range(n)), sum(i % 3 for i in range(n))) for n in range(500)}


def test_slots(spark):
    df = spark.createDataFrame([(f"u{i}@x",) for i in range(2000)] + [(None,)], "e string")
    counts = df.selectExpr(f"{email_slot('e', 4)} AS s").groupBy("s").count().collect()
    got = {r.s: r["count"] for r in counts}
    assert got.pop(None) == 1 and set(got) == {0, 1, 2, 3} and min(got.values()) > 400
    assert df.selectExpr(f"{email_slot('e', 0)} AS s").where("s IS NOT NULL").count() == 0
    big = df.selectExpr(f"{email_slot('e', 2**40)} AS s").where("s >= 4294967296").count()
    assert big > 1000


def test_link_tickets_with_a_hot_address(spark):
    rows = [(i, "hot@x", None, f"text {i}") for i in range(300)]
    rows += [(1000 + i, f"u{i}@x", None, "t") for i in range(50)] + [(2000, None, None, "t"), (2001, "no@x", None, "t")]
    tickets = spark.createDataFrame(rows, TICKETS)
    links = spark.createDataFrame([("hot@x", 7)] + [(f"u{i}@x", i) for i in range(50)], "CustomerEmail string, Simulated_CustomerID long")
    for hot_share in (0.1, 1.0):
        inner = link_tickets(tickets, links, hot_share=hot_share)
        assert inner.columns == ["CustomerEmail", "TicketID", "TicketType", "TicketDescription", "Simulated_CustomerID"]
        got = sorted((r.TicketID, r.Simulated_CustomerID) for r in inner.collect())
        assert got == [(i, 7) for i in range(300)] + [(1000 + i, i) for i in range(50)]
        left = {r.TicketID: r.Simulated_CustomerID for r in link_tickets(tickets, links, "left", hot_share).collect()}
        assert len(left) == 352 and left[2000] is None and left[2001] is None


def test_stored_tables_lie_in_the_shared_folder(spark):
    stored = write_once(spark.range(3), "three")
    assert stored.count() == 3
    assert all(shared_folder(spark) in name for name in stored.inputFiles())


class Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.settings, self.folder = {"spark.master": master, "spark.app.id": "app-1", "spark.sql.warehouse.dir": "file:/w"}, None
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_only_local_sessions_may_go_without_a_shared_folder():
    assert shared_folder(Unset("local[2]")).endswith("/returns_risk/app-1")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Unset("yarn"))


def test_tables_can_be_removed(spark):
    first = write_once(spark.range(3), "gone").inputFiles()[0]
    remove_tables(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first)


def test_links_without_customer_and_shares_below_the_least(spark):
    tickets = spark.createDataFrame([(1, "a@x", None, "t"), (2, "b@x", None, "t")], TICKETS)
    links = spark.createDataFrame([("a@x", None), ("b@x", 5), (None, 6)], "CustomerEmail string, Simulated_CustomerID long")
    assert [(r.TicketID, r.Simulated_CustomerID) for r in link_tickets(tickets, links).collect()] == [(2, 5)]
    left = {r.TicketID: r.Simulated_CustomerID for r in link_tickets(tickets, links, "left").collect()}
    assert left == {1: None, 2: 5}
    with pytest.raises(ValueError, match="hot_share"):
        link_tickets(tickets, links, hot_share=0.0001)


def test_null_and_hot_addresses_are_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tickets = spark.range(20_000).selectExpr(
            "id AS TicketID", "CASE WHEN id % 10 >= 8 THEN if(id % 10 = 8, 'hot@x', concat('u', id, '@x')) END AS CustomerEmail",
            "'t' AS TicketType", "string(id) AS TicketDescription",
        ).repartition(8)
        links = spark.createDataFrame([("hot@x", 7)], "CustomerEmail string, Simulated_CustomerID long")
        out = link_tickets(tickets, links, "left")
        sizes = [r.n for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / len(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_links_are_not_sent_around(spark, how):
    """A row of a small file made into many: Spark's estimate is that of the file."""
    links = spark.range(1000).selectExpr("id", "explode(sequence(0, 9)) AS k").selectExpr(
        "concat('u', id, '.', k, '@x') AS CustomerEmail", "id AS Simulated_CustomerID"
    )
    tickets = spark.range(300).selectExpr(
        "id AS TicketID", "concat('u', id * 7, '.', id % 20, '@x') AS CustomerEmail", "'t' AS TicketType", "'d' AS TicketDescription"
    )
    out = link_tickets(tickets, links, how)
    known = {i: i * 7 for i in range(143) if i % 20 < 10}
    got = {r.TicketID: r.Simulated_CustomerID for r in out.collect()}
    assert got == (known if how == "inner" else {i: known.get(i) for i in range(300)})
    plan = out._jdf.queryExecution().executedPlan().toString()  # as it was run, with what was changed on the way
    joins = [line for line in plan.splitlines() if "Join [" in line and "_lane" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
