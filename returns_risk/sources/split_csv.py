"""CSV files with line breaks inside cells, read by many tasks.

Two passes over byte ranges. The first counts the quotes of each range; whether a range begins inside a cell follows from
the parity of all quotes before it in its file, a prefix sum over one number for each range. In the second, every task
joins the lines of its ranges to records, beginning at the first line that starts one. What is left over at the ends of
ranges, at most two pieces for each, is put together by file. Records are then parsed by Spark's own CSV parser.

Files follow RFC 4180: cells that hold quotes, commas or line breaks are quoted, quotes inside are doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from returns_risk.functions.numeric import sql_text

_PIECES = "file string, block bigint, kind int, record string"
#: A whole record; the end of one that began in an earlier range; the start of one that a later range ends; the header.
WHOLE, END, START, HEADER = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of all files, as bytes, in the order of each byte range."""
    rows = spark.read.format("text").option("lineSep", "\n").load(path)
    return rows.selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS block", "binary(value) AS line")


def _ranges(lines: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """First pass: the files, and by byte range its file, its first byte and whether it begins inside a cell; whether a
    file's lines end with a carriage return. Some 17 bytes for each range, so they can go to every task."""
    quotes = "octet_length(line) - octet_length(replace(cast(line AS string), '\"', ''))"
    sums = lines.selectExpr("file", "block", f"({quotes}) AS n", "monotonically_increasing_id() AS at", "endswith(line, X'0D') AS crlf")
    rows = sums.groupBy("file", "block").agg(
        F.expr("cast(sum(n) % 2 AS int) AS odd"), F.expr("min_by(crlf, at) AS crlf")
    ).orderBy("file", "block").toArrow()
    names, blocks, odd = rows["file"].to_pylist(), rows["block"].to_numpy(), rows["odd"].to_numpy()
    files = list(dict.fromkeys(names))
    place = {name: k for k, name in enumerate(files)}
    of = np.array([place[name] for name in names], dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(odd)[:-1]]).astype(np.int64) if len(odd) else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(of, np.arange(len(files)))
    inside = (before - before[first][of]) % 2 == 1 if len(of) else np.zeros(0, dtype=bool)
    return files, of, blocks, inside, [rows["crlf"][int(k)].as_py() for k in first]


class _Range:
    """Joins the lines of one byte range. ``add`` and ``end`` give pieces (kind, record)."""

    def __init__(self, inside: bool, at_start: bool, crlf: bool, encoding: str) -> None:
        self.open, self.kind, self.header, self.crlf, self.encoding = inside, END if inside else WHOLE, at_start, crlf, encoding
        self.lines: list[bytes] = []

    def _piece(self, kind: int) -> tuple[int, str]:
        text = b"\n".join(self.lines).decode(self.encoding, "replace")
        self.lines = []
        return kind, text.replace("\r\n", "\n").removesuffix("\r") if self.crlf else text

    def add(self, line: bytes) -> Iterator[tuple[int, str]]:
        self.lines.append(line)
        self.open ^= line.count(b'"') % 2 == 1
        if self.open:
            return
        kind, text = self._piece(self.kind)
        self.kind = WHOLE
        if kind == END:
            yield END, text
        elif self.header and text:
            self.header = False
            yield HEADER, text.removeprefix("﻿")
        elif text:
            yield kind, text

    def end(self) -> Iterator[tuple[int, str]]:
        """What is open at the end of the range: it goes on in the next one. A piece in the middle of a cell stays open."""
        if self.lines:
            yield self._piece(START if self.kind == WHOLE else END)


def _pieces(lines: DataFrame, encoding: str) -> DataFrame:
    """Second pass: records, and pieces of records at the ends of ranges (file, block, kind, record)."""
    files, of, blocks, inside, crlf = _ranges(lines)
    place = {name: k for k, name in enumerate(files)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = None, None, []
        for batch in batches:
            for file, block, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (file, block) != now:
                    out += [(*now, *piece) for piece in own.end()] if own else []
                    now, number = (file, block), place[file]
                    lo, hi = np.searchsorted(of, [number, number + 1])
                    at = lo + int(np.searchsorted(blocks[lo:hi], block))
                    own = _Range(bool(inside[at]), at == lo, crlf[number], encoding)
                out += [(file, block, *piece) for piece in own.add(line)]
            yield _batch(out)
            out = []
        yield _batch([(*now, *piece) for piece in own.end()] if own else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "kind", "record"])

    return lines.mapInArrow(read, _PIECES)


def read_split_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text under the names of the header row, the rows in no order. Runs the first pass at once.

    The result is that of Spark's reader with ``multiLine`` and doubled quotes, which reads each file in one task. Every
    file must have the header of the first. ``encoding`` must write line breaks and quotes as single ASCII bytes, as
    UTF-8 and the ISO-8859 family do.
    """
    if encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        raise ValueError(f"{encoding} has no single-byte line breaks; read it with multiLine")
    options = {"header": True, "encoding": encoding, "multiLine": True, "escape": '"'}
    schema: StructType = spark.read.options(**options).csv(path).schema  # the first record of the first file
    pieces = _pieces(_lines(spark, path), encoding)
    ends = pieces.where(f"kind IN ({START}, {END})")
    before = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A range's leftovers in order: the end of an earlier record, then the start of one.
    numbered = ends.withColumn("of", F.sum(F.expr(f"int(kind = {START})")).over(before))
    joined = numbered.groupBy("file", "of").agg(F.expr("array_sort(collect_list(struct(block, kind, record))) AS parts"))
    joined = joined.selectExpr("array_join(parts.record, '\n') AS record")
    records = pieces.where(f"kind = {WHOLE}").select("record").unionByName(joined)
    names = ", ".join(sql_text(name) for name in schema.names)
    cells = F.from_csv("record", schema.toDDL(), {"escape": '"', "lineSep": "\n"}).alias("cells")
    wrong = pieces.where(f"kind = {HEADER}").select(cells, "file").where(
        f"NOT (array({', '.join(f'cells.`{name}`' for name in schema.names)}) <=> array({names}))"
    )
    if bad := wrong.select("file").first():
        raise ValueError(f"{bad.file} has another header than the first file")
    return records.select(cells).select("cells.*")
