import csv
import random

import pytest

from returns_risk.plans import queries
from returns_risk.sources import csv as own_csv, tables
from returns_risk.sources.split_csv import _lines, _ranges, read_split_csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some 300 bytes, so that small files are read by many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "300")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def cells(rng):
    pool = ["plain", "with, comma", 'say "yes"', "two\nlines", "\n\nblank lines\n", '"', '""', '\n"\n', "", "é𝒳", " spaced ", "x" * 700,
            "long\n" * 200, "tab\there", "a\"\n,\"b"]
    return [rng.choice(pool) for _ in range(3)]


def write(path, rows, end, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(["Id", "Free Text", "c"])
        for row in rows:
            writer.writerow([cell.replace("\n", end) for cell in row])


def multiline(spark, path, encoding="UTF-8"):
    return own_csv.read_text_columns(spark, str(path), encoding, True)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_reader_of_whole_files(spark, small_ranges, tmp_path, end):
    rng = random.Random(len(end))
    for number in range(3):
        write(tmp_path / f"part{number}.csv", [cells(rng) for _ in range(150)], end)
    (tmp_path / "last.csv").write_bytes(b"Id,Free Text,c" + end.encode() + b'1,"no end' + end.encode() + b'of line",x')
    read = read_split_csv(spark, str(tmp_path))
    files, of, blocks, inside, crlf = _ranges(_lines(spark, str(tmp_path)))
    assert len(files) == 4 and len(of) > 100 and inside.any() and set(crlf) == {end == "\r\n"}
    assert read.columns == ["Id", "Free Text", "c"]
    got, expected = as_rows(read), as_rows(multiline(spark, tmp_path))
    assert got == expected and len(got) == 451


def test_cells_over_many_ranges(spark, small_ranges, tmp_path):
    rows = [["1", "line, \"x\"\n" * 500, "a"], ["2", "b", "\n" * 900], ["3", "", "end"]]
    write(tmp_path / "f.csv", rows, "\n")
    assert {r[0]: r for r in as_rows(read_split_csv(spark, str(tmp_path)))} == {r[0]: (r[0], r[1] or None, r[2]) for r in rows}


def test_encodings_headers_and_nothing(spark, small_ranges, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a/f.csv", [["1", "café\nÖ", "x"]] * 40, "\n", "iso-8859-1")
    got = as_rows(read_split_csv(spark, str(tmp_path / "a"), "ISO-8859-1"))
    assert got == [("1", "café\nÖ", "x")] * 40 == as_rows(multiline(spark, tmp_path / "a", "ISO-8859-1"))
    (tmp_path / "b").mkdir()
    write(tmp_path / "b/f.csv", [], "\n")
    assert as_rows(read_split_csv(spark, str(tmp_path / "b"))) == []
    (tmp_path / "b/g.csv").write_text("Id,Other,c\n1,2,3\n")
    with pytest.raises(ValueError, match="another header"):
        read_split_csv(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="UTF-16"):
        read_split_csv(spark, str(tmp_path / "a"), "UTF-16")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_split_csv(spark, str(tmp_path / "none"))


def test_tickets_either_way(spark, small_ranges, tmp_path):
    with open(tmp_path / "t.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["Ticket ID", "Customer Name", "Customer Email", "Ticket Type", "Ticket Description", "Date of Purchase"])
        for k in range(200):
            text = f'I want\na "refund" {k}\n\n{{product_purchased}}' * (k % 7)
            writer.writerow([f"{k}.0" if k % 2 else k, "n", f"u{k}@x.org" if k % 5 else "", "Refund request", text, "2021-03-22"])
    whole, split = (own_csv.read_tickets(spark, str(tmp_path), split=s) for s in (False, True))
    assert whole.schema == split.schema and as_rows(whole) == as_rows(split) and whole.count() == 200


def test_long_tickets_are_dealt_over_files(spark, small_ranges, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.001"
    size = tables.long_ticket_bytes(spark, folder)
    monkeypatch.setattr(queries, "TICKET_FILE", size // 3, raising=False)
    monkeypatch.setattr(queries, "new_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        read = queries.scan_tickets_split(spark, folder)
        files = [path.stat().st_size for path in (tmp_path / "tickets_long_csv").glob("*.csv")]
        assert 0.8 * size < sum(files) < 1.25 * size and len(files) > 1 and max(files) < 0.7 * size
        got = {r.TicketID: r.TicketDescription for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wanted = tables.support_tickets(spark, folder, long_text=True).collect()
    assert got == {r.TicketID: r.TicketDescription for r in wanted} and len(got) == len(wanted)
