from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from returns_risk.constants import DAY_FIRST, MONTH_FIRST
from returns_risk.operators.clean import clean_retail, clean_tickets, dropped_rows, parse_date, parse_date_strict
from returns_risk.sources.csv import read_retail, read_tickets

RAW = "InvoiceNo string, Quantity int, InvoiceDate string, UnitPrice decimal(12,2), CustomerID double"
ROWS = [
    ("536365", 6, "12/1/2010 8:26", 2.55, 17850.0),
    ("C536379", -1, "2010-12-01 09:41:00", 27.5, 14527.0),
    ("C1", 3, "12/1/2010 9:41", 1.0, 1.0),
    (None, -2, "12/1/2010 9:41", 1.0, 1.0),
    ("7", 0, "13/12/2010 9:00", 0.0, 1.0),
    ("8", 1, "not a date", 1.0, 1.0),
    ("9", 1, None, 1.0, 1.0),
    ("10", 1, "12/1/2010 9:41", 1.0, None),
    ("11", 1, "not a date", 1.0, float("nan")),
]


@pytest.fixture(scope="module")
def raw(spark):
    from decimal import Decimal

    rows = [(a, b, d, Decimal(str(p)), c) for a, b, d, p, c in ROWS]
    return spark.createDataFrame(rows, RAW)


def test_drop_policy_and_flags(raw):
    got = {r.InvoiceNo: r for r in clean_retail(raw).collect()}
    assert set(got) == {"536365", "C536379", "C1", None}
    assert got["536365"].InvoiceDate == datetime(2010, 12, 1, 8, 26)
    assert got["536365"].CustomerID == 17850
    flags = {k: (r.IsReturn, r.PurchaseQuantity, r.ReturnQuantity, float(r.LineTotal)) for k, r in got.items()}
    assert flags == {
        "536365": (False, 6, 0, 15.3), "C536379": (True, 0, 1, -27.5), "C1": (True, 3, 0, 3.0), None: (True, 0, 2, -2.0),
    }


def test_keep_and_raise_policies(raw):
    kept = clean_retail(raw, DAY_FIRST, "keep")
    assert kept.count() == 7
    assert {r.InvoiceNo: r.InvoiceDate for r in kept.collect()}["7"] == datetime(2010, 12, 13, 9, 0)
    with pytest.raises(PySparkException, match="Not a date"):
        clean_retail(raw, on_bad_date="raise").collect()
    with pytest.raises(ValueError):
        clean_retail(raw, on_bad_date="ignore")


def test_drop_counts_alone_and_while_cleaning(raw):
    expected = {"rows_read": 9, "missing_customer": 2, "bad_date": 3}
    assert dropped_rows(raw).first().asDict() == expected
    counts = Observation("drops")
    clean_retail(raw, counts=counts).write.format("noop").mode("overwrite").save()
    assert counts.get == expected


def test_month_first_and_day_first_differ(spark):
    df = spark.createDataFrame([("01/12/2010 8:26",), ("13/12/2010 9:00",), ("12/13/2010 9:00",), ("x",), (None,)], "t string")
    month, day = (
        [r[0] for r in df.selectExpr(parse_date("t", formats)).collect()] for formats in (MONTH_FIRST, DAY_FIRST)
    )
    assert month == [datetime(2010, 1, 12, 8, 26), None, datetime(2010, 12, 13, 9, 0), None, None]
    assert day == [datetime(2010, 12, 1, 8, 26), datetime(2010, 12, 13, 9, 0), None, None, None]
    assert df.where("t IS NULL").selectExpr(parse_date_strict("t")).first()[0] is None
    named = spark.createDataFrame([("3 Dec 2010",)], "t string").selectExpr(parse_date("t", ("d MMM yyyy",)))
    assert named.first()[0] == datetime(2010, 12, 3)


def test_tickets_text_and_strict_purchase_date(spark):
    schema = "TicketID long, CustomerEmail string, TicketType string, TicketDescription string, DateOfPurchase string"
    good = spark.createDataFrame([(1, "a", None, None, "2021-03-22")], schema)
    row = clean_tickets(good).first()
    assert (row.TicketDescription, str(row.DateOfPurchase)) == ("", "2021-03-22")
    bad = spark.createDataFrame([(1, "a", None, "x", "someday")], schema)
    with pytest.raises(PySparkException, match="Not a date"):
        clean_tickets(bad).collect()
    assert clean_tickets(bad, parse_purchase_date=False).first().DateOfPurchase == "someday"


def test_retail_csv(spark, tmp_path):
    path = tmp_path / "retail.csv"
    path.write_bytes(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,85123A,"CAFÉ ""SET"",\nred",6,12/1/2010 8:26,2.555,17850.0,Österreich\n'
        "C536379,D,Discount,-1,12/1/2010 9:41,27.5,,United Kingdom\n"
        "3,D,,0,,0,NaN,France\n".encode("ISO-8859-1")
    )
    got = read_retail(spark, str(path), multiline=True).collect()
    assert [(r.InvoiceNo, r.Quantity, r.InvoiceDate, float(r.UnitPrice), r.CustomerID) for r in got] == [
        ("536365", 6, "12/1/2010 8:26", 2.555, 17850), ("C536379", -1, "12/1/2010 9:41", 27.5, None), ("3", 0, None, 0.0, None),
    ]


def test_ticket_csv(spark, tmp_path):
    path = tmp_path / "tickets.csv"
    path.write_text(
        "Ticket ID,Customer Name,Customer Email,Ticket Type,Ticket Description,Date of Purchase\n"
        '1,Zoë,zoe@example.com,Refund request,"Line one\nsays ""broken"", déjà",2021-03-22\n'
        "2,Al,,NA,null,2021-05-22\n", encoding="utf-8",
    )
    got = [tuple(r) for r in read_tickets(spark, str(path)).collect()]
    assert got == [
        (1, "zoe@example.com", "Refund request", 'Line one\nsays "broken", déjà', "2021-03-22"),
        (2, None, None, None, "2021-05-22"),
    ]


def test_missing_file_and_bad_number(spark, tmp_path):
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        read_retail(spark, str(tmp_path / "none.csv"))
    path = tmp_path / "bad.csv"
    path.write_text("InvoiceNo,Quantity,InvoiceDate,UnitPrice,CustomerID\n1,many,12/1/2010 8:26,1,1\n")
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        read_retail(spark, str(path)).collect()


def test_dates_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("3/14/2010 2:30",), ("13/14/2010 2:30",), (None,)], "t string")
        got = [r[0] for r in df.selectExpr(f"string({parse_date('t', MONTH_FIRST)})").collect()]
        assert got == ["2010-03-14 02:30:00", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
