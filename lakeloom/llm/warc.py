"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing. Each record is a gzip member of its own, as archives have it. The member's header carries its length and that of the record's
header in an extra field, so a reader can step over it. Tasks write into a folder that readers ignore; the
driver moves in the files of the tasks that succeeded, so a lost executor leaves nothing behind that is read.

Reading. The files are planned into partitions by size. Filters on the type and on other header fields are pushed into the
reader: it inflates a member as far as the record's header, drops the record there if a filter says so, and inflates the
payload only if the payload column is asked for. Plain archives, and gzip members without the extra field, are read too.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from lakeloom.operators.joins import shuffled_again

# Bytes of files per partition, bytes at which a task begins a new file, and how much is inflated to find a header.
PARTITION_BYTES = 32 * 1024 * 1024
FILE_BYTES = 256 * 1024 * 1024
HEAD_BYTES = 1024
TO_HEADER_END = -1
LEVEL = 4
# Identifier of the extra field: length of the member, length of the record's header.
EXTRA = b"LW"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_COLUMNS = (
    "record_type string, record_id string, row_id long, target_uri string, date string, payload_digest string, "
    "refers_to string, refers_to_row long, payload_bytes long"
)
SCHEMA = HEADER_COLUMNS + ", payload binary"


def payload_digest(payload: Column) -> Column:
    """SHA-1 of binary as 32 letters of base32. Each ten hex digits are eight letters."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_name(row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id}/{digest}')}>"


def _plain(value: str) -> str:
    """A header value on one line: control characters and spaces as percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(row: dict) -> tuple[bytes, bytes]:
    """Header and block of a row of ``row_id, target_uri, date, payload_digest, payload_bytes, refers_to_row, payload``.

    A row that refers to another is a revisit, and its block is the HTTP header alone.
    """
    revisit = row["refers_to_row"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(row['row_id'], row['payload_digest'])}"]
    if row["row_id"] is not None:
        lines.append(f"Row-ID: {row['row_id']}")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_plain(row['target_uri'])}")
    lines += [f"WARC-Date: {row['date']}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT}",
            f"WARC-Refers-To: {record_name(row['refers_to_row'], row['payload_digest'])}",
            f"Refers-To-Row-ID: {row['refers_to_row']}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode(), block


def member(head: bytes, block: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member that tells its own length."""
    data = head + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 4 + 16 + len(body) + 8
    extra = EXTRA + struct.pack("<HQQ", 16, size, len(head))
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's header in lower case. A line that begins with white space goes on the one before."""
    found, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def header_row(named: dict[str, str]) -> dict:
    """The header columns, all but the payload's length, which the block's HTTP header has."""
    whole = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
    return {
        "record_type": named.get("warc-type"),
        "record_id": named.get("warc-record-id"),
        "row_id": whole(named.get("row-id")),
        "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"),
        "payload_digest": named.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": named.get("warc-refers-to"),
        "refers_to_row": whole(named.get("refers-to-row-id")),
    }


def holds(pushed: Filter, row: dict) -> bool:
    value = row[pushed.attribute[0]]
    if isinstance(pushed, IsNull):
        return value is None
    if isinstance(pushed, IsNotNull):
        return value is not None
    if isinstance(pushed, EqualNullSafe):
        return value == pushed.value
    if value is None:
        return False
    if isinstance(pushed, In):
        return value in pushed.value
    return value.startswith(pushed.value) if isinstance(pushed, StringStartsWith) else value == pushed.value


class _Stream:
    """A file read from front to back, with steps over what is not wanted."""

    def __init__(self, file):
        self.file = io.BufferedReader(file, 1 << 20)

    def peek(self, size: int) -> bytes:
        at = self.file.tell()
        data = self.file.read(size)
        self.file.seek(at)
        return data

    def split_head(self, data: bytes) -> int:
        end = data.find(b"\r\n\r\n")
        return end + 4 if end >= 0 else -1

    def records(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """Header columns and block of each record; ``wanted(row)``: None to skip it, else how many bytes of the block are needed at
        least, or TO_HEADER_END: as many as its HTTP header has."""
        while first := self.peek(2):
            if first == b"\r\n":
                self.file.seek(2, os.SEEK_CUR)
            elif first == b"\x1f\x8b":
                yield from self.gzip_member(wanted)
            else:
                yield from self.plain_record(wanted)

    def plain_record(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        size = HEAD_BYTES
        while (end := self.split_head(data := self.peek(size))) < 0 and len(data) == size:
            size *= 4
        if end < 0:
            raise ValueError("a record's header has no end")
        named = fields(data[:end])
        row, length = header_row(named), int(named.get("content-length", 0))
        self.file.seek(end, os.SEEK_CUR)
        need = wanted(row)
        if need is not None:
            block = b""
            for upto in _sizes(need, length):
                block += self.file.read(upto - len(block))
                if need == TO_HEADER_END and header_ends(block):
                    break
            self.file.seek(length - len(block), os.SEEK_CUR)
            yield row, block
        else:
            self.file.seek(length, os.SEEK_CUR)

    def gzip_member(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        start = self.file.tell()
        head = self.file.read(12)
        own = head[3] == 4 and (extra := self.file.read(struct.unpack("<H", head[10:12])[0]))[:2] == EXTRA and len(extra) == 20
        self.file.seek(start)
        if not own:
            yield from self.foreign_member(wanted)
            return
        size, _ = struct.unpack("<QQ", extra[4:20])
        skipped = 12 + len(extra)
        self.file.seek(skipped, os.SEEK_CUR)
        inflate = zlib.decompressobj(-zlib.MAX_WBITS)
        left = size - skipped - 8
        fed = self.file.read(min(HEAD_BYTES, left))
        left -= len(fed)
        data = inflate.decompress(fed, HEAD_BYTES)
        while (end := self.split_head(data)) < 0 and not inflate.eof:
            if not inflate.unconsumed_tail and not left:
                raise ValueError("a record's header has no end")
            more = self.file.read(min(HEAD_BYTES, left)) if not inflate.unconsumed_tail else b""
            left -= len(more)
            data += inflate.decompress(inflate.unconsumed_tail + more, HEAD_BYTES)
        named = fields(data[:end])
        row, length = header_row(named), int(named.get("content-length", 0))
        need = wanted(row)
        if need is not None:
            block = data[end:]
            for upto in _sizes(need, length):
                parts, got = [block], len(block)
                while got < upto:
                    fed = inflate.unconsumed_tail
                    if not fed:
                        fed = self.file.read(min(1 << 16, left))
                        left -= len(fed)
                    part = inflate.decompress(fed, upto - got)
                    if not part and not left and not inflate.unconsumed_tail:
                        raise ValueError("a record ends early")
                    parts.append(part)
                    got += len(part)
                block = b"".join(parts)
                if need == TO_HEADER_END and header_ends(block[:length]):
                    break
            yield row, block[: length if need == TO_HEADER_END else min(need, length)]
        self.file.seek(start + size)

    def foreign_member(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """A member of unknown length: all of it is inflated, piece by piece, and may hold several records."""
        inflate, parts = zlib.decompressobj(zlib.MAX_WBITS | 16), []
        while not inflate.eof:
            fed = self.file.read(1 << 16)
            if not fed:
                raise ValueError("a gzip member ends early")
            parts.append(inflate.decompress(fed))
        self.file.seek(-len(inflate.unused_data), os.SEEK_CUR)
        yield from _Stream(io.BytesIO(b"".join(parts))).records(wanted)


def header_ends(block: bytes) -> bool:
    """Whether nothing more of a block is needed to know its HTTP header, or that it has none."""
    return not block.startswith(b"HTTP/"[: len(block)]) or b"\r\n\r\n" in block


def _sizes(need: int, length: int) -> Iterator[int]:
    """How far a block is read, step by step: at once, or ever further until its HTTP header has ended."""
    size = HEAD_BYTES if need == TO_HEADER_END else need
    while need == TO_HEADER_END and size < length:
        yield size
        size *= 4
    yield min(size, length)


def payload_of(block: bytes) -> tuple[int | None, int]:
    """What the block's HTTP header gives as the payload's length, and where the payload begins."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return None, 0
    length = fields(block[:end]).get("content-length", "")
    return int(length) if length.isdigit() else None, end + 4


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    # Spark's names of that store are not known to Arrow.
    system, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return system, inner.rstrip("/")


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {c.split()[0] for c in HEADER_COLUMNS.split(", ")} - {"payload_bytes"}
        for given in filters:
            kind = isinstance(given, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith))
            if kind and len(given.attribute) == 1 and given.attribute[0] in known:
                self.pushed.append(given)
            else:
                yield given

    def partitions(self) -> list[Files]:
        system, inner = file_system(self.path)
        files = [inner] if system.get_file_info(inner).type == pafs.FileType.File else None
        if files is None:
            listed = system.get_file_info(pafs.FileSelector(inner, recursive=False))
            found = sorted((f.path, f.size) for f in listed if f.type == pafs.FileType.File and f.base_name[:1] not in "._")
        else:
            found = [(inner, 0)]
        packed, room = [], 0
        for path, size in found:
            if not packed or room < size:
                packed.append([])
                room = max(self.size, size)
            packed[-1].append(path)
            room -= size
        return [Files(paths) for paths in packed or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        names = self.schema.names
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(f.name, kinds[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in self.schema])
        whole, some = "payload" in names, "payload_bytes" in names

        def wanted(row: dict) -> int | None:
            if not all(holds(f, row) for f in self.pushed):
                return None
            return 1 << 62 if whole else TO_HEADER_END if some else 0

        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row, block in _Stream(file).records(wanted):
                    length, begins = payload_of(block)
                    row["payload_bytes"] = length
                    if whole:
                        row["payload"] = None if row["record_type"] == "revisit" else block[begins:]
                        size += len(block)
                    rows.append({n: row[n] for n in names})
                    size += 512
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = file_system(self.path)
        folder = f"{inner}/{self.folder}"
        system.create_dir(folder, recursive=True)
        paths, file, size = [], None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if file is None or size >= self.file_bytes:
                        if file is not None:
                            file.close()
                        paths.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                        file, size = system.open_output_stream(paths[-1], buffer_size=1 << 20), 0
                    data = member(*record(row))
                    file.write(data)
                    size += len(data)
        finally:
            if file is not None:
                file.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(inner)):
                if old.type == pafs.FileType.File and old.base_name[:1] not in "._":
                    system.delete_file(old.path)
        number = 0
        for message in messages:
            for path in message.paths if message else ():
                system.move(path, f"{inner}/part-{number:06d}-{os.path.basename(path)}")
                number += 1

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for path in message.paths if message else ():
                system.delete_file(path)


class WarcSource(DataSource):
    """``path`` names a folder or, for reading, a file. Columns: SCHEMA; a reader's schema may name any of them."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per page into WARC files under ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the least id is a response and the others revisit it;
    smaller payloads are all responses. A null page is an empty payload. Rows that repeat the response's id are responses too;
    rows without an id revisit a row that has one, and are responses where their payload has none. No pages leave an empty folder.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": payload_digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("row_id").alias("first"))
    rows = rows.join(shuffled_again(first, "payload_digest"), "payload_digest", "left")
    other = F.when(~F.col("row_id").eqNullSafe(F.col("first")), F.col("first"))
    rows.select(
        "row_id", "target_uri", F.lit(date).alias("date"), "payload_digest", "payload_bytes", other.alias("refers_to_row"),
        F.when(other.isNull(), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``; without the payload column no payload is inflated."""
    register(spark)
    return spark.read.format("warc").schema(SCHEMA if payload else HEADER_COLUMNS).load(path)
