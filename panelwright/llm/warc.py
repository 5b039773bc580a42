"""WARC archives as a Spark data source.

Reading plans one partition per file. Filters on record type and on the other header columns are taken over from Spark:
a record's header block is parsed first, and the payload of a record that fails them, or whose payload nobody asked for,
is sought past and never decoded. Writing makes one file per task under a name of its own attempt; only files of tasks
that Spark commits are given their final names, so lost executors leave no records behind.

Records are gzip members of their own, as is usual, and each says its length in an extra field of the gzip header ("sl"),
so that compressed records can be sought past too. Files without that field, and plain ones, are read as well.
"""

from __future__ import annotations

import base64
import gzip
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from io import BufferedReader, BytesIO

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .shared import fresh_path, gone_at_exit, hot_join, written

#: Column and the header field it is read from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to_id": "WARC-Refers-To",
    "payload_length": "WARC-Payload-Length",
    "content_length": "Content-Length",
}
LENGTHS = ("payload_length", "content_length")
SCHEMA = ", ".join(f"{c} {'long' if c in LENGTHS else 'string'}" for c in HEADERS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIP_BYTES = 1 << 16


#: Values that a header line can't hold as they are go as encoded words (RFC 2047), as do those that look like one.
_ENCODED = re.compile(r"=\?utf-8\?[bB]\?([A-Za-z0-9+/=]*)\?=")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def header_text(value: str) -> str:
    """A value on one line: control characters and white space at the ends would break the line or be lost."""
    if _CONTROL.search(value) or value != value.strip() or _ENCODED.fullmatch(value):
        return f"=?utf-8?B?{base64.b64encode(value.encode()).decode()}?="
    return value


def header_value(text: str) -> str:
    found = _ENCODED.fullmatch(text)
    return base64.b64decode(found[1]).decode("utf-8", "replace") if found else text


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    fields = "".join(f"{k}: {header_text(v)}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + fields.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def read_header(stream: BufferedReader) -> dict[str, str] | None:
    """Fields of the next record's header block by lower-case name; None at the end. The stream then stands at the block."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    last = None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    if "content-length" not in fields:
        raise ValueError("a WARC record without Content-Length")
    return fields


def column_values(fields: dict[str, str]) -> dict[str, str | int | None]:
    got = {c: header_value(fields[h.lower()]) if h.lower() in fields else None for c, h in HEADERS.items()}
    return got | {c: int(got[c]) if got[c] is not None else None for c in LENGTHS}


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, where it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member whose header has the member's and the record's length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, 24 + len(body) + 8, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record))


def _member_length(head: bytes) -> int | None:
    """Length of the gzip member that begins with these 24 bytes, where it has the extra field."""
    return struct.unpack_from("<I", head, 16)[0] if len(head) == 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[10:16] == b"\x0c\x00sl\x08\x00" else None


Wanted = Callable[[dict[str, str]], bool]


def scan_plain(stream: BufferedReader, wanted: Wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields of each record, and its block where it is wanted."""
    while (fields := read_header(stream)) is not None:
        size = int(fields["content-length"])
        if wanted(fields):
            yield fields, stream.read(size)
        else:
            _skip(stream, size)
            yield fields, None


def scan_members(stream: BufferedReader, wanted: Wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The same from gzip members with lengths: of an unwanted record only the beginning is inflated."""
    while head := stream.read(24):
        length = _member_length(head)
        if length is None:
            raise ValueError("a gzip member without its length among members with it")
        left, inflate, text = length - len(head), zlib.decompressobj(-15), b""
        while b"\r\n\r\n" not in text:
            chunk = inflate.unconsumed_tail
            if not chunk:
                chunk = stream.read(min(left, 1024))
                left -= len(chunk)
            if not chunk:
                raise ValueError("a WARC record that ends in its header")
            text += inflate.decompress(chunk, 4096)
        top = BufferedReader(BytesIO(text))
        fields = read_header(top)
        at = top.tell()
        if wanted(fields):
            rest = stream.read(left)
            try:
                text += inflate.decompress(inflate.unconsumed_tail + rest)
            except zlib.error as e:
                raise ValueError(f"a damaged record: {fields.get('warc-record-id')}") from e
            if len(inflate.unused_data) < 8 or zlib.crc32(text) != struct.unpack("<I", inflate.unused_data[:4])[0]:
                raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
            yield fields, text[at : at + int(fields["content-length"])]
        else:
            _skip(stream, left)
            yield fields, None


def scan(stream: BufferedReader, wanted: Wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    head = stream.peek(24)[:24]
    if head[:2] != b"\x1f\x8b":
        return scan_plain(stream, wanted)
    if _member_length(head) is None:
        return scan_plain(BufferedReader(gzip.GzipFile(fileobj=stream)), wanted)
    return scan_members(stream, wanted)


@dataclass
class WarcFile(InputPartition):
    path: str
    tests: tuple[tuple[str, str, object], ...] = ()
    payloads: bool = True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.payloads = "payload" in self.names and options.get("payloads", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and presence of header columns are tested here; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        return [WarcFile(p, tuple(self.tests), self.payloads) for p in files]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as raw, BufferedReader(raw, 1 << 18) as stream:
            passes = lambda row: all(row[c] in v if how == "in" else row[c] is not None for c, how, v in partition.tests)
            for fields, block in scan(stream, lambda f: partition.payloads and passes(column_values(f))):
                row = column_values(fields)
                if block is not None or passes(row):
                    payload = None if block is None else payload_of(fields, block)
                    yield tuple(payload if c == "payload" else row[c] for c in self.names)


def _skip(stream: BufferedReader, size: int) -> None:
    if size > _SKIP_BYTES:
        stream.seek(size, 1)
    else:
        stream.read(size)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceWriter):
    """Rows of SCHEMA's columns, of which payload, record_id, record_type, target_uri, refers_to_id are used."""

    def __init__(self, options: dict):
        self.path, self.packed = options["path"], options.get("compression", "gzip").lower() == "gzip"

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.warc{'.gz' * self.packed}"
        got = Written(f"{root}/_{name}.tmp", f"{root}/{name}")
        with system.open_output_stream(got.temporary) as out:
            for row in iterator:
                out.write(gzip_member(self.record(row)) if self.packed else self.record(row))
        return got

    def record(self, row: Row) -> bytes:
        payload = bytes(row.payload) if row.payload is not None else b""
        revisit = row.record_type == "revisit"
        fields = {"WARC-Type": row.record_type, "WARC-Record-ID": row.record_id, "WARC-Date": row.record_date}
        fields |= {"WARC-Target-URI": row.target_uri} if row.target_uri is not None else {}
        fields |= {"WARC-Payload-Digest": f"sha1:{row.payload_digest}", "WARC-Payload-Length": str(row.payload_length)}
        if revisit:
            return record_bytes(fields | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row.refers_to_id}, b"")
        return record_bytes(fields | {"Content-Type": "application/http; msgtype=response"}, http_block(payload))

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            system.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            if system.get_file_info(m.temporary).type == fs.FileType.File:
                system.delete_file(m.temporary)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); option payloads=false leaves payloads null and unread, and for writing
    compression=none leaves records plain."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1: every five of its hex digits make four digits of base 32."""
    five = lambda at: F.lpad(F.conv(F.substring(F.sha1(payload), at, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(five(at) for at in range(1, 41, 5))), *_DIGITS)


def _payload(html_col: str) -> Column:
    return F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))


_NO_ID = "<urn:page>"


def record_id(page_id: Column) -> Column:
    """URN of the record of a page; null ids share one."""
    return F.when(page_id.isNull(), F.lit(_NO_ID)).otherwise(F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")))


def write_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: datetime | None = None) -> None:
    """Archive pages: of equal payloads of at least min_revisit_bytes the one with the largest id is a response record and
    the others revisit it; smaller payloads are all responses.

    Null html is an empty payload, a null url leaves out WARC-Target-URI; urls and ids may hold any characters. Rows that
    repeat the largest id are all responses. Of equal payloads without any id all are responses. Ids are compared in
    their own type. An empty table writes no records. Only the three named columns are read.

    What decides is settled on digests and ids alone. Payloads then travel once, to the tasks that write; those of a very
    common page stay where they are, but for the one that is written.
    """
    spark = pages.sparkSession
    register(spark)
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = _payload(html_col)
    marks = pages.select(base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_length"), F.col(id_col).alias("id"))
    found = marks.filter(F.col("payload_length") >= min_revisit_bytes).groupBy("payload_digest", "payload_length").agg(F.max("id").alias("keeper"), F.count("*").alias("copies"))
    keepers, _ = written(found, "warc-keepers")
    read = pages.select(base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_length"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    revisits = lambda keeper: F.coalesce((F.col("id").isNull() & keeper.isNotNull()) | (F.col("id") < keeper), F.lit(False))
    joined = hot_join(read, keepers, ["payload_digest", "payload_length"], "copies", trim={"payload": lambda of: F.when(~revisits(of["keeper"]), F.col("payload"))})
    revisit = revisits(F.col("keeper"))
    records = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_id(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(when).alias("record_date"), "payload_digest", F.when(revisit, record_id(F.col("keeper"))).alias("refers_to_id"), "payload_length",
        F.lit(0).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def read_warc(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """Records of all archives in a folder, a row for each, repeated ones too; headers that a record lacks are null, and so
    are payloads of revisits, or all where payloads is false. A folder without archives, or none at all, gives no rows; a
    damaged record is an error that names it."""
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_records(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", **kw) -> DataFrame:
    """Write pages as an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, and size and digest are taken from these; revisits have neither payload nor
    need for one: their header has both, and nothing but headers is parsed. Ids have the type of id_col. For nulls, ties
    and repeated rows see write_pages; an empty table gives an empty one. Without path, archives go when the driver's
    process ends.
    """
    spark = pages.sparkSession
    own = path is None
    path = path or fresh_path(spark, "warc")
    write_pages(pages, path, id_col=id_col, **kw)
    if own:
        gone_at_exit(spark, path)
    kind = pages.schema[id_col].dataType.simpleString()
    own = lambda c: F.when(F.col(c) != _NO_ID, F.expr(f"try_cast(substring({c}, 11, length({c}) - 11) AS {kind})"))
    responses = read_warc(spark, path).filter("record_type = 'response'")
    payload = F.coalesce("payload", F.lit(b""))
    full = responses.select(own("record_id").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    revisits = read_warc(spark, path, payloads=False).filter("record_type = 'revisit'")
    seen = revisits.select(own("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", own("refers_to_id").alias("refers_to"))
    return full.unionByName(seen)
