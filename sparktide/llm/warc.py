"""WARC archives as a PySpark Python data source.

``spark.read.format("warc").load(path)`` reads, ``df.write.format("warc")``
writes. The reader plans file partitions (files are packed into tasks of about
``split_bytes``), takes filters on record type and header columns from Spark,
parses headers first, and skips the payload of every record that a filter
turns away: it is neither decoded nor copied. With ``payload=false`` no payload
is decoded at all.

Each record is a gzip member of its own and its header tells the member's length,
so unwanted payloads are not even inflated. Paths: local (``file:``) or any file system that pyarrow opens.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from ._common import Workspace, new_path, read_table

SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id long, payload_digest string, payload_bytes long, refers_to long, content_type string, payload binary"
#: Column -> WARC header.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "page_id": "X-Page-ID",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "X-Refers-To-Page-ID", "content_type": "Content-Type",
}
LONGS = {"page_id", "payload_bytes", "refers_to"}
COLUMNS = [*HEADERS, "payload"]
LEVEL = 4
#: Packed bytes that are inflated at first: enough for a record's headers.
HEAD = 1024
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode(row: dict) -> bytes:
    """A record as one gzip member. Line ends in header values become spaces."""
    clean = lambda v: " ".join(str(v).split())
    payload = row.get("payload") or b""
    head = [f"{HEADERS[c]}: {clean(row[c]) if c != 'payload_digest' else 'sha1:' + clean(row[c])}" for c in HEADERS if row.get(c) is not None]
    if row.get("record_type") == "revisit":
        head.append(f"WARC-Profile: {REVISIT}")
    data = ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(payload)}\r\n\r\n").encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body)
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body


def skip_length(head: bytes) -> tuple[int, int] | None:
    """Sizes of a gzip member, packed and not, by the field ``sl`` of its header
    (annex D of the WARC standard); None without such a field."""
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= end:
        name, n = head[at : at + 2], int.from_bytes(head[at + 2 : at + 4], "little")
        if name == b"sl" and n == 8:
            return struct.unpack("<II", head[at + 4 : at + 12])
        at += 4 + n
    return None


def records(data: io.RawIOBase, wanted, payload: bool, chunk: int = 1 << 20):
    """Rows of a gzip or plain archive as tuples of COLUMNS.

    ``wanted(row)`` judges the parsed headers. Of a record that it turns away the
    payload is not inflated if the gzip member tells its length (field ``sl``), and
    else passed over without being built.
    """
    raw = bytearray(data.read(2))
    packed = raw == b"\x1f\x8b"
    size, skipping = None, False  # of the member that is read, not packed; whether the rest of it goes unread

    def need(n: int) -> bool:
        while len(raw) < n:
            block = data.read(chunk)
            if not block:
                return False
            raw.extend(block)
        return True

    def drop(n: int) -> None:
        nonlocal raw
        while n > len(raw):
            n -= len(raw)
            raw = bytearray(data.read(min(chunk, n)))
            if not raw:
                return
        del raw[:n]

    def plain():
        nonlocal size, skipping
        while not packed and need(1):
            out = bytes(raw)
            raw.clear()
            yield out
        while packed and need(12):
            sizes = None
            if raw[3] & 4 and need(12 + int.from_bytes(raw[10:12], "little")):
                sizes = skip_length(bytes(raw[: 12 + int.from_bytes(raw[10:12], "little")]))
            size, skipping = sizes and sizes[1], False
            z, done, step = zlib.decompressobj(31), 0, HEAD
            while not z.eof and need(1):
                block = bytes(raw[:step])
                del raw[:step]
                done, step = done + len(block), chunk
                out = z.decompress(block)
                raw[0:0] = z.unused_data
                done -= len(z.unused_data)
                if out:
                    yield out
                if skipping:
                    drop(sizes[0] - done)
                    break

    blocks, buffer = plain(), bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            block = next(blocks, None)
            if block is None:
                return False
            buffer.extend(block)
        return True

    def skip(n: int) -> None:
        nonlocal buffer
        while n > len(buffer):
            n -= len(buffer)
            buffer = bytearray(next(blocks, b""))
            if not buffer:
                return
        del buffer[:n]

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            block = next(blocks, None)
            if block is None:
                return
            buffer.extend(block)
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        del buffer[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record: " + lines[0][:40])
        head = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head.get("content-length", 0))
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        row |= {c: int(row[c]) for c in LONGS if row[c] is not None}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not wanted(row):
            if size == end + length + 8:  # the member holds this record alone
                skipping = True
                buffer.clear()
            else:
                skip(length + 4)
        elif payload:
            fill(length + 4)
            yield (*(row[c] for c in HEADERS), bytes(buffer[:length]))
            del buffer[: length + 4]
        else:
            skip(length + 4)
            yield (*(row[c] for c in HEADERS), None)


@dataclass
class Files(InputPartition):
    paths: tuple


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 32 << 20))
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters):
        """Takes equality, IN and not-null tests on header columns; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, top = filesystem(self.path)
        info = store.get_file_info(top)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True)) if info.type != fs.FileType.NotFound else []
        files = sorted(((f.size, f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))), reverse=True)
        parts, size = [[]], 0
        for n, path in files:
            if parts[-1] and size + n > self.split:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(tuple(p)) for p in parts]

    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64() if c in LONGS else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])
        tests = self.tests
        wanted = lambda row: all(row[c] is not None and (v is None or row[c] in v) for c, v in tests)
        store, _ = filesystem(self.path)
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as data:
                for row in records(data, wanted, self.payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """A task writes one archive under a name of its own; a failed or repeated
    attempt leaves no file that a reader sees: it is moved into place on commit."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches):
        store, top = filesystem(self.path)
        store.create_dir(f"{top}/_temporary", recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{top}/_temporary/{name}", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(encode(row))
        return Written(name)

    def commit(self, messages):
        store, top = filesystem(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{top}/_temporary/{m.path}", f"{top}/{m.path}")
        store.create_dir(top, recursive=True)
        self._clean(store, top)

    def abort(self, messages):
        self._clean(*filesystem(self.path))

    def _clean(self, store, top):
        from pyarrow import fs

        if store.get_file_info(f"{top}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/_temporary")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(col):
    """Upper-case base32 SHA-1 of a binary column, in the JVM: 40 bits are 8 digits."""
    sha = F.sha1(col)
    digits = F.concat(*(F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_records(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer: a response or a revisit for each page.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with
    the smallest page_id is the response. A null html counts as empty, a null
    url gives no target. Rows with the same id, or none, keep a record each, told
    apart by a hidden row number; only the first of equal rows is the response. A
    null page_id never wins over a number. Texts of any length and an empty table
    are fine. Other columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    # Written once, so that a row keeps its number when a task runs again.
    rows = ws.table(slim.select("*", base32_sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("rid")), "rows")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("first")
    first = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(least, F.count("*").alias("n")).where("n > 1")
    first = ws.table(first.select("payload_digest", F.col("first.page_id").alias("first"), F.col("first.rid").alias("first_rid")), "first")
    # The rows of a hot digest are split by Spark's skew join: both sides are plain shuffles.
    same = rows.join(first, "payload_digest", "left")
    own = F.col("first_rid").isNull() | (F.col("rid") == F.col("first_rid"))
    return same.select(
        F.when(own, "response").otherwise("revisit").alias("record_type"), F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.md5(F.concat_ws("|", "page_id", "payload_digest", "rid")), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        "target_uri", F.lit(date).alias("date"), "page_id", "payload_digest", "payload_bytes", F.when(~own, F.col("first")).alias("refers_to"), F.lit("text/html").alias("content_type"),
        F.when(own, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    register(pages.sparkSession)
    archive_records(pages, min_revisit_bytes).select(*COLUMNS).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back; digests and sizes of response
    payloads are computed anew from the archive, those of revisits are headers."""
    path = new_path(spark, "archive")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    rows = read_warc(spark, path)
    full = F.col("record_type") == "response"
    return rows.select(
        "page_id", F.when(full, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def _base32_sql(sha: str) -> str:
    digit = lambda v, k: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {k}) & 31 AS INT) + 1, 1)"
    chunks = [f"CAST(('0x' || substr({sha}, {1 + 10 * i}, 10)) AS BIGINT)" for i in range(4)]
    return " || ".join(digit(v, k) for v in chunks for k in range(35, -1, -5))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_base32_sql("sha")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
