"""WARC archives: a writer that stores equal payloads once, and a Python data source that reads them.

The writer marks, of records with equal payloads of at least `least` bytes, all but the one with the largest page id as
revisits; SHA-1 and size are found by Spark's own functions, the largest id per payload by a pre-aggregated grouping, and
the join that carries it back is salted, so one payload on many pages does not meet in one task. A revisit keeps the HTTP
header block, whose Content-Length is the full payload's.

Files are .warc.gz, a gzip member per record; its header's extra field "sl" holds the member's length, so that a reader which
has seen the first lines of a record can seek to the next one without inflating or even fetching the rest.

The last member of a large file is empty and holds in its extra field "ix" where a member begins in about each MARK bytes.

``spark.read.format("warc")`` reads .warc.gz files of any writer and plain .warc. It plans a partition per file, and several
for files of over ``split`` bytes (an option) that have such an index. It takes filters on the record header's columns
(record_type, record_id, target_uri, date, payload_digest, refers_to, content_type), reads a record's header first, and seeks past the blocks
of records that the filters reject or whose payload nobody asked for (option ``payload``: bytes, digest or skip).

The payload of a record is its block without the HTTP header, if its type is application/http, and the whole block of any other
(resource, conversion, metadata, warcinfo). A record that its file ends in has the column `truncated` true and what there is of it.

Defined cases: null html counts as empty; a null page id is written as "null", never refers or is referred to by number, and
revisits as any other page; rows that repeat the largest id are all responses; other columns are ignored; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from ._common import files_of, shared_path, table

RECORD = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
#: Parts into which the join deals the pages of one payload.
SALTS = 32
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary, content_type string, truncated boolean"
HEADER = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "content_type")
#: Fixed values of WARC 1.1: the profile of a revisit with an equal payload, and header fields by column.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to", "content-type": "content_type"}


def with_references(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page whose payload is kept instead, or null)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    kept = slim.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "kept")
    salted = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash("page_id", "url"), F.lit(SALTS))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.withColumn("salt", salt).join(salted, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> list[bytes]:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
        payload = b""
    lines.append(f"Content-Length: {len(http) + len(payload)}")
    return ["\r\n".join(lines).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"]


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and that of the data in the extra field "sl"."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = MEMBER + len(body) + 8
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBH2sHII", 0, 4, 255, 12, b"sl", 8, total % (1 << 32), len(data) % (1 << 32)) + body + struct.pack("<II", zlib.crc32(data), len(data) % (1 << 32))


#: Bytes of such a member's header.
MEMBER = 24
#: Bytes between places of an index, and how many places fit in an extra field.
MARK, PLACES = 16 << 20, 8000
#: A gzip member's bytes after its header if it holds nothing.
NOTHING = b"\x03\x00" + bytes(8)


def index(places: list[int]) -> bytes:
    """An empty gzip member with the places, and their number last, in the extra field "ix"."""
    while len(places) > PLACES:
        places = places[::2]
    data = struct.pack(f"<{len(places) + 1}Q", *places, len(places))
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBH2sH", 0, 4, 255, len(data) + 4, b"ix", len(data)) + data + NOTHING


def indexed(file: pa.NativeFile) -> list[int]:
    """The places in a file's index; none if it has no index."""
    size = file.size()
    tail = len(NOTHING) + 8
    if size < tail:
        return []
    file.seek(size - tail)
    last = file.read(tail)
    n = struct.unpack_from("<Q", last)[0]
    at = size - tail - 8 * n - 16
    if last[8:] != NOTHING or n > PLACES or at < 0:
        return []
    file.seek(at)
    whole = file.read(size - at)
    places = list(struct.unpack_from(f"<{n}Q", whole, 16))
    return places if whole == index(places) else []


def write(pages: DataFrame, path: str, least: int = 1000, mark: int = MARK) -> DataFrame:
    """Writes part-N.warc.gz files; returns file, records and bytes. pages: page_id, url, html."""
    files, folder = files_of(path)
    files.create_dir(folder, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = files_of(path)
        name, own = f"part-{TaskContext.get().partitionId():07d}.warc.gz", uuid.uuid4().hex
        out, n, at, places = None, 0, 0, []
        for batch in batches:
            out = out or files.open_output_stream(f"{folder}/.{name}.{own}")
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at >= (places[-1] if places else 0) + mark:
                    places.append(at)
                at += out.write(member(b"".join(record(*row))))
                n += 1
        if out:
            if places:
                out.write(index(places))
            size = out.tell()
            out.close()
            files.move(f"{folder}/.{name}.{own}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    found = with_references(pages, least).mapInArrow(put, "file string, records long, bytes long").collect()  # a row per file
    return pages.sparkSession.createDataFrame(found, "file string, records long, bytes long")


class WarcFile(InputPartition):
    def __init__(self, uri: str, name: str, begin: int = 0, end: int | None = None):
        self.uri, self.name, self.begin, self.end = uri, name, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.split = int(options.get("split", 128 << 20))
        if self.payload not in ("bytes", "digest", "skip"):
            raise ValueError("payload: bytes, digest or skip")
        self.wanted: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute[-1] in HEADER:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        files, folder = files_of(self.path)
        found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        out = []
        for x in sorted(found, key=lambda x: x.base_name):
            if not x.base_name.endswith((".warc", ".warc.gz")) or x.base_name.startswith("."):
                continue
            ends = []
            if x.size > self.split:
                with files.open_input_file(f"{folder}/{x.base_name}") as raw:
                    for place in indexed(raw):
                        if place >= (ends[-1] if ends else 0) + self.split:
                            ends.append(place)
            out += [WarcFile(self.path, x.base_name, begin, end) for begin, end in zip([0, *ends], [*ends, None], strict=True)]
        return out or [WarcFile(self.path, "")]

    def accepts(self, head: dict) -> bool:
        for f in self.wanted:
            value = head.get(f.attribute[-1])
            if value is None or not (value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value)):
                return False
        return True

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = files_of(partition.uri)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = pa.schema([(n, {"payload_bytes": pa.int64(), "payload": pa.binary(), "truncated": pa.bool_()}.get(n, pa.string())) for n in names])
        rows, held = [], 0
        with files.open_input_file(f"{folder}/{partition.name}") as raw:
            for head, size, block in records(raw, partition.begin, partition.end):
                if not self.accepts(head):
                    block.skip()
                    continue
                # A block holds an HTTP header only where its type says so; the payload of other records is the block.
                http = http_header(block) if (head["content_type"] or "").lower().startswith("application/http") else None
                if self.payload == "skip" or head["record_type"] == "revisit":
                    row = head | {"payload_bytes": int(http["content-length"]) if http and http.get("content-length", "").isdigit() else block.left(), "payload": None}
                    block.skip()
                    row["truncated"] = block.cut()
                else:
                    data = block.rest()
                    row = head | {"payload_bytes": len(data), "payload": data if self.payload == "bytes" else None, "truncated": block.cut()}
                    if self.payload == "digest":
                        row["payload_digest"] = hashlib.sha1(data).hexdigest()
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 5000 or held > 16_000_000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class Block:
    """A record's block: lines, the rest, or a seek past it."""

    def __init__(self, source: "Lines", size: int):
        self.source, self.end = source, source.tell() + size

    def line(self) -> bytes:
        return self.source.line() if self.source.tell() < self.end else b""

    def left(self) -> int:
        """Bytes that should follow."""
        return self.end - self.source.tell()

    def rest(self) -> bytes:
        return self.source.take(self.left())

    def cut(self) -> bool:
        """After rest() or skip(): whether the file ended first."""
        return self.source.tell() < self.end or self.source.limit is not None and self.source.limit < self.end

    def skip(self) -> None:
        self.source.seek(self.end)


class Lines:
    """Lines and runs of bytes from parts that `more(n)` gives, about n bytes each and empty at the end; `jump`, if there is one, goes to a place in the file."""

    PART = 1 << 18

    def __init__(self, more: Callable[[int], bytes], jump: Callable[[int], None] | None = None, size: int | None = None, limit: int | None = None):
        self.more, self.jump, self.size, self.limit, self.data, self.base, self.at = more, jump, size, limit, b"", 0, 0

    def tell(self) -> int:
        return self.base + self.at

    def seek(self, to: int) -> None:
        if to <= self.base + len(self.data):
            self.at = to - self.base
        elif self.jump:
            self.jump(to)
            self.data, self.base, self.at = b"", to, 0
        else:
            while self.base + len(self.data) < to and self._more(self.PART):
                self.at = min(len(self.data), to - self.base)
            self.at = min(len(self.data), to - self.base)

    def _more(self, n: int) -> bool:
        part = self.more(n)
        self.data, self.base, self.at = self.data[self.at :] + part, self.base + self.at, 0
        return bool(part)

    def line(self) -> bytes:
        while (k := self.data.find(b"\n", self.at)) < 0:
            if not self._more(4096):
                k = len(self.data) - 1
                break
        out, self.at = self.data[self.at : k + 1], k + 1
        return out

    def take(self, n: int) -> bytes:
        parts, held = [], 0
        while held < n:
            if self.at == len(self.data) and not self._more(max(n - held, self.PART)):
                break
            part = self.data[self.at : self.at + n - held]
            self.at += len(part)
            held += len(part)
            parts.append(part)
        return b"".join(parts)


def plain(file: pa.NativeFile) -> Lines:
    return Lines(lambda n: file.read(max(n, Lines.PART)), file.seek, limit=file.size())


def inflated(file: pa.NativeFile, end: int | None = None, size: int | None = None) -> Lines:
    """The members from here on, or up to `end`, as one run of bytes."""
    state = {"z": zlib.decompressobj(31), "left": b""}

    def more(n: int) -> bytes:
        while True:
            room = n if end is None else min(n, end - file.tell())
            part = state["left"] or (file.read(room) if room > 0 else b"")
            if state["z"].eof and part:
                state["z"] = zlib.decompressobj(31)
            if not part:
                return b""
            out = state["z"].decompress(part)
            state["left"] = state["z"].unused_data if state["z"].eof else b""
            if out:
                return out

    return Lines(more, size=size)


def sources(file: pa.NativeFile, begin: int = 0, end: int | None = None) -> Iterator[Lines]:
    """Runs of records that begin in a range of the file: each member by itself where its length is told, else all that is left."""
    at, size = begin, file.size() if end is None else end
    while at < size:
        file.seek(at)
        start = file.read(MEMBER)
        if start[:2] != b"\x1f\x8b":
            file.seek(at)
            lines = plain(file)
            lines.base = at
            yield lines
            return
        known = len(start) == MEMBER and start[3] & 4 and start[12:14] == b"sl"
        after = at + struct.unpack_from("<I", start, 16)[0] if known else size
        file.seek(at)
        yield inflated(file, after, struct.unpack_from("<I", start, 20)[0]) if known else inflated(file)
        at = after


def records(file: pa.NativeFile, begin: int = 0, end: int | None = None) -> Iterator[tuple[dict, int, Block]]:
    """Header columns, block size and block of each record; what is left of a block is skipped when the next one is asked for."""
    for source in sources(file, begin, end):
        while line := source.line():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {line[:40]!r}")
            head: dict = dict.fromkeys(HEADER)
            size = 0
            while (line := source.line()).strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                key, value = key.strip().lower(), value.strip()
                if key == "content-length":
                    size = int(value)
                elif key in FIELDS:
                    head[FIELDS[key]] = value.strip("<>") if key in ("warc-record-id", "warc-refers-to") else value.removeprefix("sha1:") if key == "warc-payload-digest" else value
            block = Block(source, size)
            yield head, size, block
            if source.size is not None and block.end + 4 >= source.size:
                break  # the member's last record: what is left of it needn't be inflated
            block.skip()


def http_header(block: Block) -> dict:
    out = {}
    while (line := block.line()).strip():
        key, _, value = line.decode("latin-1").partition(":")
        out[key.strip().lower()] = value.strip()
    return out


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: str = "bytes", split: int = 128 << 20) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).option("split", split).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    rows = read(spark, path, "digest")
    number = lambda c: F.regexp_extract(c, rf"^{RECORD}(\d+|-\d+)$", 1).try_cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: op7's rows by SQL.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
     k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN k.kept IS NULL OR k.kept = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.kept <> d.page_id THEN k.kept END AS refers_to
FROM d LEFT JOIN k ON k.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""
