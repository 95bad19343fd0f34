"""WARC archives as a PySpark Python data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Files are gzip with one member per record, and every member carries the standard's skip-length field, so a reader inflates
only the start of a record, parses its headers, and seeks to the next record if the pushed filters reject it or no payload
is asked for. Filters on the record type and on header columns are pushed down (equality, in-list, prefix, null tests);
``payload`` is decoded only when the read schema has it. Reading is planned in partitions of whole files of about
``PARTITION_BYTES``; the writer starts a new file at ``FILE_BYTES``. A manifest that is written on commit names the files
that count, so files of lost or repeated tasks are never read. Paths may have any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from flickpulse.operators.scale import stage

FILE_BYTES, PARTITION_BYTES = 64 << 20, 32 << 20
HEAD_BYTES, ROWS = 4096, 512
MANIFEST = "_MANIFEST.json"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "record_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2026-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path or URI; ``file:/x`` is taken like ``file:///x``."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with its compressed and uncompressed lengths in the skip-length field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body


def record(values: dict[str, str | None], payload: bytes | None) -> bytes:
    """A WARC record; without payload (a revisit) its block has the HTTP header only."""
    block = _HTTP % len(payload) + payload if payload is not None else _HTTP % 0
    lines = [f"{HEADERS[c]}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for c, v in values.items() if v is not None]
    if payload is None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def digest_header(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``SCHEMA``; a null payload makes a record without payload. Digests are computed where none are given."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files, out = [], None
        try:
            for batch in iterator:
                own = [c for c in HEADERS if c in batch.schema.names]
                columns = {c: batch.column(batch.schema.get_field_index(c)) for c in [*own, "payload"]}
                for i in range(len(batch)):
                    values = {c: columns[c][i].as_py() for c in own}
                    payload = columns["payload"][i].as_py()
                    values.setdefault("record_date", _DATE)
                    if payload is not None and values.get("payload_digest") is None:
                        values["payload_digest"] = digest_header(payload)
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")  # unique to this attempt of the task
                        out = store.open_output_stream(f"{root}/{files[-1]}", compression=None)
                    out.write(member(record(values, payload)))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = [f for f in _files(store, root) if f not in files] + files
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f"{root}/{f}")


def _files(store: pafs.FileSystem, root: str) -> list[str]:
    """Names of the archive files of a folder: those of its manifest, else all."""
    if store.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    names: list[str]


def _keeps(test: Filter, headers: dict[str, str | None]) -> bool:
    value = headers.get(test.attribute[0])
    if isinstance(test, EqualTo):
        return value is not None and value == test.value
    if isinstance(test, In):
        return value is not None and value in test.value
    if isinstance(test, StringStartsWith):
        return value is not None and value.startswith(test.value)
    return (value is None) == isinstance(test, IsNull)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.tests = path, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            known = isinstance(test, (EqualTo, In, StringStartsWith, IsNull, IsNotNull))
            if known and len(test.attribute) == 1 and test.attribute[0] in HEADERS:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        store, root = filesystem(self.path)
        infos = store.get_file_info([f"{root}/{n}" for n in _files(store, root)])
        out, size = [Files([])], 0
        for info in infos:
            if out[-1].names and size + (info.size or 0) > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].names.append(info.base_name)
            size += info.size or 0
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(self.path)
        kinds = [pa.binary() if c == "payload" else pa.string() for c in self.columns]
        rows: list[tuple] = []
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as f:
                for headers, payload in _records(f, self.tests, "payload" in self.columns):
                    rows.append(tuple(payload if c == "payload" else headers.get(c) for c in self.columns))
                    if len(rows) == ROWS:
                        yield _rows(rows, self.columns, kinds)
                        rows = []
        if rows:
            yield _rows(rows, self.columns, kinds)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _records(f: pa.NativeFile, tests: list[Filter], with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payload of every record that passes ``tests``, of a gzip file with a member per record or a plain one."""
    end, at = f.size(), 0
    while at < end:
        f.seek(at)
        head = f.read(HEAD_BYTES)
        packed = head[:2] == b"\x1f\x8b"
        raw, inflate = head, None
        if packed:
            inflate = zlib.decompressobj(31)
            raw = inflate.decompress(head)
        while b"\r\n\r\n" not in raw:
            more = f.read(HEAD_BYTES)
            if not more:
                return  # nothing but padding, or a record that was cut off
            raw += inflate.decompress(more) if packed else more
        top, rest = raw.split(b"\r\n\r\n", 1)
        headers = _headers(top)
        length = int(headers.get("content-length", 0))
        wanted = all(_keeps(t, headers) for t in tests)
        take = wanted and with_payload and headers.get("record_type") != "revisit"
        if not packed:
            begin = at + len(top) + 4
            at = begin + length + 4
            if take:
                f.seek(begin)
                rest = f.read(length)
        elif (skip := _skip(head)) and not take:
            at += skip  # the rest of the record stays compressed
        else:
            parts, got = [rest], len(rest)
            while not inflate.eof and (more := f.read(1 << 16)):
                parts.append(inflate.decompress(more))
                got += len(parts[-1])
            at = f.tell() - len(inflate.unused_data)
            rest = b"".join(parts)[:length] if take else b""
        if wanted:
            yield headers, rest[:length].split(b"\r\n\r\n", 1)[-1] if take else None


def _skip(head: bytes) -> int:
    """The compressed length of a member from its skip-length field; 0 if there is none."""
    if head[3] & 4 and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0]
    return 0


def _headers(top: bytes) -> dict[str, str]:
    """Header columns by their names here, and the content length."""
    lines = dict(line.split(":", 1) for line in top.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    low = {k.strip().lower(): v.strip() for k, v in lines.items()}
    out = {c: low[h.lower()] for c, h in HEADERS.items() if h.lower() in low}
    return out | {"content-length": low.get("content-length", "0")}


class WarcDataSource(DataSource):
    """Options: ``path``. Read and written columns: ``SCHEMA`` or any part of it."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def deduplicated(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least_bytes: int = 1000) -> DataFrame:
    """Records to write, one per page: of equal payloads of ``least_bytes`` or more, the page of the largest id has the
    response and the others revisit it, without payload.

    Defined cases: a null payload is empty; a page with null id never has the response of a group that has ids (a group of
    null ids only are responses all); rows that repeat the largest id are responses all. Empty tables give empty archives.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("target_uri"),
                        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    groups = (rows.filter("sha1 is not null").groupBy("sha1").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 and holder is not null").drop("n"))
    again = F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return rows.join(groups, "sha1", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), "target_uri",
        F.when(again, urn("holder")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def page_id(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record; revisits are resolved.

    Sizes and digests are taken from the payloads as they were read. Only responses are decoded, once; revisits are read
    by their headers alone.
    """
    read = spark.read.format("warc").option("path", path)
    responses = (read.schema("record_type string, record_id string, payload binary").load().filter("record_type = 'response'")
                 .select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")))
    responses = stage(responses)
    revisits = (read.schema("record_type string, record_id string, refers_to string").load().filter("record_type = 'revisit'")
                .select("record_id", "refers_to"))
    resolved = revisits.join(responses.dropDuplicates(["record_id"]).withColumnRenamed("record_id", "refers_to"), "refers_to")
    columns = ["payload_bytes", "payload_digest"]
    return (responses.select(page_id("record_id").alias("page_id"), *columns, F.lit("response").alias("record_type"),
                             F.lit(None).cast("long").alias("refers_to"))
            .unionByName(resolved.select(page_id("record_id").alias("page_id"), *columns, F.lit("revisit").alias("record_type"),
                                         page_id("refers_to").alias("refers_to"))))
