"""WARC archives as a Python data source: format("warc") reads and writes them.

A partition is one archive. Record types and header fields are filtered before a record's block is read, and a block
whose payload nobody wants is skipped undecoded. Records are gzip members of their own, as is usual.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from veilframe.llm.common import col, prepare, slices, write_table
from veilframe.session import shared_path

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
#: Columns that filters are pushed down for, and the header of each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a block in which its HTTP header must end.
HEADER_BYTES = 1 << 20
_CHUNK = 1 << 20
_S3 = re.compile("^s3[an]://")  # other engines' names for the same store


def _fs(path: str):
    from pyarrow import fs

    path = _S3.sub("s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _field(value: str) -> str:
    """A header value on one line; what would end it is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """One record, uncompressed: a response has the payload behind the HTTP header, a revisit the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_field(record_id)}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_field(uri)}"] if uri is not None else []
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head += [f"WARC-Refers-To: <{_field(refers_to)}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class _Stream:
    """Bytes of an archive, of gzip members one after another or plain."""

    def __init__(self, raw):
        self.raw, self.held, self.at, self.inflate = raw, b"", 0, None
        first = raw.read(_CHUNK)
        self.zipped = first[:2] == b"\x1f\x8b"
        self.waiting = first

    def _more(self) -> bool:
        data = self.waiting or self.raw.read(_CHUNK)
        self.waiting = b""
        if not data:
            return False
        if self.zipped:
            out = []
            while data:
                if self.inflate is None:
                    self.inflate = zlib.decompressobj(31)
                out.append(self.inflate.decompress(data))
                data = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = None
            data = b"".join(out)
        self.held, self.at = self.held[self.at :] + data, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to mark, which is taken too; None at the end."""
        start = self.at
        while (found := self.held.find(mark, start)) < 0:
            size = len(self.held) - self.at
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("a record ends in its header")
                return None
            start = max(0, size - len(mark))
        out = self.held[self.at : found]
        self.at = found + len(mark)
        return out

    def within(self, mark: bytes, size: int) -> bytes | None:
        """Bytes up to mark, which is taken too, if it ends within size bytes; else None, and nothing is taken."""
        while len(self.held) - self.at < size and self.held.find(mark, self.at) < 0 and self._more():
            pass
        found = self.held.find(mark, self.at, self.at + size)
        if found < 0:
            return None
        out = self.held[self.at : found]
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("a record is cut short")
        out = self.held[self.at : self.at + size]
        self.at += size
        return out

    def skip(self, size: int) -> None:
        while (there := len(self.held) - self.at) < size:
            size -= there
            self.held, self.at = b"", 0
            if not self._more():
                raise ValueError("a record is cut short")
        self.at += size


def records(raw, wanted: dict[str, set[str]] | None = None, payloads: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive. wanted: the values that a header may have, by its name in lower case."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        shown = {k: _bare(k, v) for k, v in fields.items()}
        size = int(fields["content-length"])
        if any(shown.get(k) not in values for k, values in (wanted or {}).items()):
            stream.skip(size + 4)
            continue
        length, left = size, size
        payload = None
        http = stream.within(b"\r\n\r\n", min(size, HEADER_BYTES)) if fields.get("content-type", "").startswith("application/http") else None
        if http is not None:  # a block without the end of a header is all payload
            left = size - len(http) - 4
            own = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
            told = own.get("content-length", "")
            length = int(told) if fields.get("warc-type") == "revisit" and told.isdigit() else left
        if payloads and fields.get("warc-type") != "revisit":
            payload = stream.take(left)
            stream.skip(4)
        else:
            stream.skip(left + 4)
        yield (*(shown.get(HEADERS[c]) for c in ("record_id", "record_type", "target_uri", "payload_digest")), length, shown.get(HEADERS["refers_to"]), payload)


def _bare(name: str, value: str) -> str:
    if name in ("warc-record-id", "warc-refers-to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcSource(DataSource):
    """Options: path, a folder of archives; payload, "false" to leave payloads in the archives."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        """Takes equality and membership of header columns; the rest is left to Spark."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else {*f.value}
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, root = _fs(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", "."))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _fs(self.path)
        names = [x.split()[0] for x in SCHEMA.split(",")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        with system.open_input_stream(partition.path, compression=None) as raw:
            for row in records(raw, self.wanted, self.payloads):
                rows.append(row)
                size += len(row[-1] or b"")
                if size > 4 * _CHUNK or len(rows) == 4096:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Each task writes an archive beside the folder's others under a hidden name; the driver's commit shows it."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        hidden, shown, out = posixpath.join(root, f"_{name}"), posixpath.join(root, name), None
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            order = ["record_type", "record_id", "target_uri", "payload_digest", "payload", "payload_length", "refers_to"]
            for part in slices(pa.RecordBatch.from_arrays([columns[n] for n in order], order), 4):
                for kind, key, uri, digest, payload, length, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out = out or system.open_output_stream(hidden, compression=None)
                    out.write(_member(record(kind, key, uri, digest, payload or b"", length, refers)))
        if out is None:
            return Written([])
        out.close()
        return Written([(hidden, shown)])

    def commit(self, messages: list) -> None:
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            for hidden, shown in m.files if m else ():
                system.move(hidden, shown)

    def abort(self, messages: list) -> None:
        system, _ = _fs(self.path)
        for m in messages:
            for hidden, _ in m.files if m else ():
                system.delete_file(hidden)


def _member(data: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session, and lets filters be pushed down to it."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows to be written, one for each row of pages: a response, or a revisit of the response with an equal payload.

    Of rows with equal payloads (SHA-1) of min_bytes or more the one with the largest id is the response. A null
    payload is empty. A row without an id is a response that none refers to; repeated rows of the largest id are all
    responses. Other columns are ignored. Payloads aren't shuffled unless revisits are too many to broadcast.
    """
    body = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(col(id_col).alias("id"), col(uri_col).cast("string").alias("target_uri"), body.alias("payload"), F.sha1(body).alias("sha1"))
    keys = rows.select("id", "sha1", F.octet_length("payload").alias("size")).where((F.col("size") >= min_bytes) & F.col("id").isNotNull())
    last = keys.groupBy("sha1").agg(F.max("id").alias("last"), F.min("id").alias("least")).where("last <> least").select("sha1", "last")
    again = write_table(keys.select("id", "sha1").distinct().join(last, "sha1").where("id <> last").select(F.col("id").alias("again"), F.col("sha1").alias("again_sha1"), "last"), "revisits")
    matched = rows.where("id IS NOT NULL").join(again, (F.col("id") == F.col("again")) & (F.col("sha1") == F.col("again_sha1")), "left").select(*rows.columns, "last")
    joined = matched.unionByName(rows.where("id IS NULL").withColumn("last", F.lit(None).cast(again.schema["last"].dataType)))
    revisit = F.col("last").isNotNull()
    name = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    return joined.select(
        F.coalesce(name(F.col("id")), F.lit("urn:x-page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        _base32(F.col("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        name(F.col("last")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(sha1):
    """Base 32 of 40 hexadecimal digits: each 20 bits, five digits, are four characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(sha1, i + 1, 5), 16, 10).cast("long")
        out += [F.substring(alphabet, (F.shiftright(bits, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_pages(pages: DataFrame, path: str, **options) -> None:
    register(pages.sparkSession)
    page_records(pages, **options).write.format("warc").mode("append").save(path)


def archive_and_read(pages: DataFrame, payload: bool = False, **options) -> DataFrame:
    """Writes pages to new archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path, **options)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
