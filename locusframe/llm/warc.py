"""WARC archives as a Spark data source, reading and writing."""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from locusframe.llm.common import bounded_broadcast, documents, materialize, new_path

#: A task starts another file after so many bytes.
FILE_BYTES = 64 << 20
#: Files are read in partitions of about so many bytes.
SPLIT_BYTES = 32 << 20
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 100

# Fixed values of the format.
VERSION = b"WARC/1.1"
DIGEST = "sha256:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_files.json"
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload_bytes long, page_id long, refers_to long, content_length long, headers map<string,string>, payload binary"
#: Columns that come from one header each, and whether they are numbers.
_HEADERS = {
    "record_id": ("warc-record-id", False),
    "warc_type": ("warc-type", False),
    "target_uri": ("warc-target-uri", False),
    "warc_date": ("warc-date", False),
    "payload_digest": ("warc-payload-digest", False),
    "payload_bytes": ("x-payload-bytes", True),
    "page_id": ("x-page-id", True),
    "refers_to": ("x-refers-to-page", True),
    "content_length": ("content-length", True),
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    names: list[str]


class WarcDataSource(DataSource):
    """format("warc"): path is a folder of .warc and .warc.gz files, or one file.

    Options: payload=false reads headers alone; date sets WARC-Date of what is written. Written columns: warc_type, target_uri, payload_digest,
    payload_bytes, page_id, refers_to and payload.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    """Plans groups of whole files; tests pushed predicates on a record's headers before its block is read or skipped."""

    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        store, path = _store(self.path)
        top = store.get_file_info(path)
        if top.type == fs.FileType.File:
            return [_Files([path])]
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        manifest = store.get_file_info(f"{path}/{MANIFEST}")
        if manifest.type == fs.FileType.File:
            with store.open_input_stream(manifest.path) as f:
                found = sorted(tuple(x) for x in json.loads(f.read()))
            found = [(f"{path}/{n}", size) for n, size in found]
        else:
            found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        groups: list[list[str]] = []
        room = 0
        for name, size in found:
            if size > room or not groups:
                groups.append([])
                room = SPLIT_BYTES
            groups[-1].append(name)
            room -= size
        return [_Files(g) for g in groups] or [_Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            got = _value(headers, column)
            if kind == "EqualNullSafe":
                if got != value:
                    return False
            elif got is None or kind == "EqualTo" and got != value or kind == "In" and got not in value or kind == "StringStartsWith" and not got.startswith(value):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw:
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for headers, block in records(stream, self._wanted, self.payload):
                    rows.append((headers, block))
                    held += len(block or b"") + 500
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)


def _value(headers: dict[str, str], column: str):
    name, number = _HEADERS[column]
    text = headers.get(name)
    if text is not None and column == "payload_digest":
        return text.removeprefix(DIGEST)
    return int(text) if number and text is not None else text


def _batch(rows: list[tuple[dict, bytes | None]]) -> pa.RecordBatch:
    columns = [pa.array([_value(h, c) for h, _ in rows], pa.int64() if number else pa.string()) for c, (_, number) in _HEADERS.items()]
    headers = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([*columns, headers, pa.array([p for _, p in rows], pa.binary())], [*_HEADERS, "headers", "payload"])


def records(stream, wanted=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers by lower-case name, payload) of each wanted record; other blocks are skipped unread. The payload is what follows
    the HTTP headers of an HTTP block, else the block; null if it isn't asked for. Raises ValueError on what is no record.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the archive ends within headers")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
            else:
                last, _, value = text.partition(":")
                last = last.strip().lower()
                headers[last] = value.strip()
        if not headers.get("content-length", "").isdecimal():
            raise ValueError("a record without a Content-Length")
        length = int(headers["content-length"])
        take = wanted(headers)
        if not payload or not take:
            if length and (stream.seek(length - 1, io.SEEK_CUR) is None or len(stream.read(1)) < 1):
                raise ValueError("the archive ends within a block")
            if take:
                yield headers, None
            continue
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends within a block")
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


def _record(row: dict, date: str) -> bytes:
    body = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if revisit else http + body
    headers = {
        "WARC-Type": row["warc_type"], "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if revisit or row["page_id"] is None else record_id(row["page_id"]), "WARC-Date": date, "WARC-Target-URI": None if row["target_uri"] is None else quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": None if row["payload_digest"] is None else DIGEST + row["payload_digest"], "Content-Type": "application/http; msgtype=response", "X-Payload-Bytes": row["payload_bytes"], "X-Page-Id": row["page_id"],
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"]), "X-Refers-To-Page": row["refers_to"]} if revisit else {}), "Content-Length": len(block),
    }
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items() if v is not None) + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own; the manifest names those of the attempts that succeeded."""

    def __init__(self, options):
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc", 0
                        out = store.open_output_stream(f"{path}/{name}")
                    size += out.write(data := _record(row, self.date)) or len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = _store(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{path}/{name}")


def write_pages(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as WARC records into the folder path, one a row.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of REVISIT_BYTES or more the one with the
    smallest page_id is a response and others revisit it; rows that share that page_id are all responses. Rows with a null page_id revisit
    one that has an id, and are responses if there is none. Other columns are not written.
    """
    pages.sparkSession.dataSource.register(WarcDataSource)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    again = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.where("n > 1 and first is not null").select("payload_digest", "first"), "copies")
    joined = rows.join(bounded_broadcast(again, again.count(), 96), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri", "payload_digest", "payload_bytes", "page_id",
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in path, as SCHEMA; predicates on record type and other header columns are tested before payloads are read.

    Such predicates reach the source once spark.sql.python.filterPushdown.enabled is set, which this does for the session, as plans are made later; without it they
    are tested after reading, with the same rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(documents(spark, sf_dir, "pages"), path)
    whole = read_archives(spark, path).where("warc_type = 'response'")
    again = read_archives(spark, path, payload=False).where("warc_type = 'revisit'")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
    return whole.union(again.select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to"))


ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f
"""
QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": ORACLE_SQL}
