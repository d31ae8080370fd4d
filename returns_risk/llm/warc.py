"""Deterministic sharded WARC writer, and the reader for its archives.

Pages are dealt into shards by ranges of (page id, hash) and sorted. Range limits come from the ``SAMPLE`` pages with
the smallest hashes, so they don't depend on how the input is partitioned, and files come out byte for byte the same on
a rerun. Each shard is a task, which writes one file after the other under temporary names and begins a new one when
the compressed size reaches ``file_bytes``. A second job renames the files that the first one reported; what it reports
is the manifest, a table in the folder itself, written last: without its ``_SUCCESS`` file nothing counts as written.
Files of lost or repeated tasks are in no manifest, and are deleted at the end; what a run that ended in between has left
is deleted by the next one. Readers, of any session, open what the manifest names (``archive``). An archive is never
written over.

The first of equal payloads (smallest page id) is a response, the others are revisits. The decision is made on digests
alone, with the digest of a hot payload reduced before the shuffle; it travels to the writer as a row that sorts just
before its page, so the html moves once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returns_risk.llm.common import LANES, table
from returns_risk.sources.store import new_path, write_once

SHARD_BYTES, FILE_BYTES, MOST_SHARDS, SAMPLE = 16 << 20, 4 << 20, 16384, 65536
#: Files that a reading task opens, on average.
READ_FILES = 4
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "name string, temporary string, bytes bigint, records bigint, sha256 string"
FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"
_NULL_ID = -(1 << 63)


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a folder in Spark's notation, and the path in it."""
    if re.match(r"file:|/", uri):
        return pa.fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", uri)
    return pa.fs.FileSystem.from_uri(uri)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields]
    head += [("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def _urn(page_id: int | None, digest: str, copy: int = 0) -> str:
    name = f"page:{page_id}:{digest}" + (f":{copy}" if copy else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, copy: int = 0) -> bytes:
    """``copy`` counts equal rows, so that each has a record id of its own."""
    payload = (html or "").encode()
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _urn(page_id, digest, copy)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if not revisit:
        return _record("response", fields, http + payload)
    fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields += [("WARC-Refers-To", _urn(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", fields, http)


class _Roll:
    """Files of one shard after the other, under temporary names."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder, self.file_bytes, self.shard, self.out = folder, file_bytes, None, None
        self.fs, self.path = filesystem(folder)

    def add(self, shard: int, record: bytes) -> Iterator[dict]:
        if shard != self.shard or self.size >= self.file_bytes:
            yield from self.close()
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.name = shard, f"part-{shard:05d}-{self.number:05d}.warc.gz"
            self.temporary, self.size, self.records = f"{self.name}.{uuid.uuid4().hex}", 0, 0
            self.out, self.hash = self.fs.open_output_stream(f"{self.path}/tmp/{self.temporary}", compression=None), hashlib.sha256()
            info = f"software: returns_risk\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            fields = [("WARC-Record-ID", _urn(None, self.name)), ("Content-Type", "application/warc-fields")]
            self._write(_record("warcinfo", fields, info))
        self.records += 1
        self._write(record)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> Iterator[dict]:
        if self.out:
            self.out.close()
            self.out = None
            yield {
                "name": self.name, "temporary": self.temporary, "bytes": self.size, "records": self.records,
                "sha256": self.hash.hexdigest(),
            }


def _with_shards(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``a``, ``b`` (sort key: id, hash) and ``shard`` to pages (page_id, url, html, n); the number of shards."""
    rows = pages.selectExpr("*", f"coalesce(page_id, {_NULL_ID}) AS a", "xxhash64(page_id, url, html) AS b")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, min(MOST_SHARDS, -(-total // shard_bytes)))
    drawn = rows.select("a", "b", "n", F.xxhash64("b").alias("h")).orderBy("h", "a").limit(SAMPLE).collect()
    drawn = sorted((r.a, r.b, r.n) for r in drawn)
    weight = np.cumsum([n + 1 for *_, n in drawn]) if drawn else np.zeros(0)
    cuts = [drawn[int(np.searchsorted(weight, weight[-1] * k / shards))][:2] for k in range(1, shards)] if drawn else []
    limits = np.array(sorted(set(cuts)), dtype=[("a", "i8"), ("b", "i8")])

    @F.pandas_udf("int")
    def shard_of(a: pd.Series, b: pd.Series) -> pd.Series:
        keys = np.empty(len(a), dtype=limits.dtype)
        keys["a"], keys["b"] = a, b
        return pd.Series(np.searchsorted(limits, keys, side="right").astype("int32"))

    return rows.withColumn("shard", shard_of("a", "b")), len(limits) + 1


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_revisit: int = 0,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Writes the archives into ``folder`` and returns their manifest. ``FileExistsError`` if there are archives in it.

    Null html is an empty payload; a null url leaves its header out. Payloads under ``least_revisit`` bytes are all
    responses. Pages without an id are revisits if the payload has a page with an id, else all responses. Repeated rows
    of the page that is the response are responses too. Other columns are left out. No page gives no file.
    """
    _prepare(folder)
    pages = pages.selectExpr(f"cast({id_col} AS bigint) AS page_id", f"{url_col} AS url", f"coalesce({html_col}, '') AS html")
    pages = pages.selectExpr("*", "cast(octet_length(html) AS bigint) AS n")
    thin = pages.selectExpr("page_id", "n", "sha2(html, 256) AS same", f"coalesce(page_id, {_NULL_ID}) AS a", "xxhash64(page_id, url, html) AS b")
    thin = write_once(thin, "warc-digests")
    several = thin.where(f"n >= {least_revisit}").groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    several = several.where("times > 1 AND first IS NOT NULL")
    several = several.selectExpr("same", "first", f"explode(sequence(0, {LANES - 1})) AS lane")
    revisits = thin.selectExpr("*", f"cast(pmod(b, {LANES}) AS int) AS lane").join(several, ["same", "lane"])
    revisits = revisits.where("NOT page_id <=> first").select("a", "b", "first").distinct()

    rows, shards = _with_shards(pages, shard_bytes)
    shard_of = rows.select("a", "b", "shard").distinct()
    notes = revisits.join(shard_of, ["a", "b"]).selectExpr(
        "shard", "a", "b", "0 AS is_page", "first", "cast(NULL AS string) AS url", "cast(NULL AS string) AS html"
    )
    rows = rows.selectExpr("shard", "a", "b", "1 AS is_page", "cast(NULL AS bigint) AS first", "url", "html")
    rows = rows.unionByName(notes).repartitionById(shards, "shard").sortWithinPartitions("a", "b", "is_page", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, noted, done, last, copy = _Roll(folder, file_bytes), None, [], None, 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                shard, a, b, is_page, first, url, html = row
                if not is_page:
                    noted = (a, b, first)
                    continue
                revisit = noted is not None and noted[:2] == (a, b)
                last, copy = (a, b), copy + 1 if last == (a, b) else 0
                record = page_record(None if a == _NULL_ID else a, url, html, noted[2] if revisit else None, revisit, copy)
                done += roll.add(shard, record)
            if done:
                yield pa.RecordBatch.from_pylist(done)
                done = []
        done = list(roll.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    written = write_once(rows.mapInArrow(write, MANIFEST), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, temporary in zip(batch["name"].to_pylist(), batch["temporary"].to_pylist(), strict=True):
                here = fs.get_file_info(f"{path}/tmp/{temporary}")
                if here.type == pa.fs.FileType.File:  # else an earlier attempt of this task has moved it
                    fs.move(here.path, f"{path}/{name}")
            yield batch

    written.mapInArrow(commit, MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    filesystem(folder)[0].delete_dir(f"{filesystem(folder)[1]}/tmp")
    return archive(pages.sparkSession, folder)


def _prepare(folder: str) -> None:
    """An empty folder for temporary files; what a run without a manifest has left in the folder is deleted."""
    fs, path = filesystem(folder)
    if fs.get_file_info(f"{path}/manifest/_SUCCESS").type == pa.fs.FileType.File:
        raise FileExistsError(f"{folder} holds a finished archive")
    for found in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if found.is_file and found.base_name.endswith(".warc.gz"):
            fs.delete_file(found.path)
        elif found.base_name in ("tmp", "manifest"):
            fs.delete_dir(found.path)
    fs.create_dir(f"{path}/tmp", recursive=True)


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a finished archive."""
    fs, path = filesystem(folder)
    if fs.get_file_info(f"{path}/manifest/_SUCCESS").type != pa.fs.FileType.File:
        raise FileNotFoundError(f"{folder} holds no finished archive")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every record; one record at a time is in memory."""
    unpacked = gzip.GzipFile(fileobj=stream)
    while line := unpacked.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no record where one should begin")
        head = {}
        while (line := unpacked.readline()) != b"\r\n":
            name, _, value = line.decode().partition(": ")
            head[name] = value.rstrip("\r\n")
        block = unpacked.read(int(head["Content-Length"]))
        if unpacked.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        yield head, block


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per page record of the archives in the manifest; every digest is checked again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
        ])
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(re.search(rb"Content-Length: ([0-9]+)", http)[1]), head["WARC-Payload-Digest"][5:]
                        if head["WARC-Type"] == "response" and (len(payload), sha1(payload)) != (size, digest):
                            raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
                        rows.append((number(head.get("Page-ID")), size, digest, head["WARC-Type"], number(head.get("Refers-To-Page-ID")), name))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    tasks = max(1, manifest.count() // READ_FILES)
    return manifest.select("name").repartition(tasks, "name").mapInArrow(read, FIELDS)


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All of ``pages``, written into the shared folder and read back; without the files' names."""
    out = new_path(spark, "warc")
    return read_warc(write_warc(table(spark, folder, "pages"), out), out).drop("file")
