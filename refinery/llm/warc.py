"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of a ``.warc.gz`` file.  Equal
payloads of at least ``MIN_REVISIT`` bytes are stored once, as the response of
the largest page id; the others are revisit records that name it.

Index: one line per record, keyed by the URL with its host reversed and by the
record id, range-sorted over tasks.  Each task writes a file of compressed
blocks of ``BLOCK_LINES`` lines and, behind them, the sparse directory of its
blocks (first key, place, size).  The upper level is one first key per file.
A lookup binary-searches the upper level, then the file's directory, reads that
one block by range, binary-searches its lines and reads the record by range.

Tasks write under names of their own per attempt and report them in tables that
Spark commits; only reported files count, so a lost executor leaves at most
files that nothing names.

Defined results
  - null html: an empty payload; null url: no target, key ``-``;
  - rows that repeat page id and payload are one page, all of one type;
  - a page without an id is a revisit only if a page with an id has its payload;
  - control characters of a URL are percent-encoded in headers;
  - an empty table writes nothing and gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, open_folder

MIN_REVISIT = 1000
FILE_BYTES = 256 << 20
BLOCK_LINES = 1000
CAPTURED = "2024-01-01T00:00:00Z"  # the pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_FOOTER = "<QQI8s"
_MAGIC = b"CDXBLK1\n"


def reversed_host_key(url: str | None) -> str:
    """``http://www.b.example.com/p?q#f`` -> ``com,example,b)/p?q``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "-" + re.sub(r"\s", "+", url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + re.sub(r"\s", "+", path)


def record_id(page_id: str | None, digest: str) -> str:
    return str(uuid.uuid5(_SPACE, f"{page_id}/{digest}"))


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None,
                 target: str | None) -> bytes:
    """One WARC record; ``refers_to`` (a page id) and its URL ``target`` make it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:uuid:{record_id(page_id, digest)}>"), ("WARC-Date", CAPTURED)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_text(url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if page_id is not None:
        fields.append(("Page-ID", page_id))
    if refers_to is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = http + b"\r\n"
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, digest)}>")]
        if target is not None:
            fields.append(("WARC-Refers-To-Target-URI", _header_text(target)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# --- writing -------------------------------------------------------------------------------------

def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def page_roles(pages: DataFrame, scratch: Scratch, id_col: str, url: str, html: str) -> DataFrame:
    """(page_id, digest, refers_to, target) of every distinct (page, payload); refers_to null for responses."""
    meta = scratch.table(pages.select(
        F.col(id_col).alias("page_id"), F.sha1(_payload(F.col(html))).alias("digest"),
        F.octet_length(_payload(F.col(html))).alias("n"), F.col(url).alias("url")), "meta")
    best = scratch.table(
        meta.filter((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("o"))
        .select("digest", F.col("o.page_id").alias("original"), F.col("o.url").alias("target")), "originals")
    other = ~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull()
    return (meta.select("page_id", "digest").distinct().join(best, "digest", "left")
            .select("page_id", "digest", F.when(other, F.col("original")).alias("refers_to"),
                    F.when(other, F.col("target")).alias("target")))


_ENTRY = "part int, file string, key string, record string, page_id string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url: str = "url",
                   html: str = "html") -> DataFrame:
    """Write the archives; returns one index entry per record (lazily: write it to a table before use)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, place, name = TaskContext.get().partitionId(), None, 0, ""
        fs, root = open_folder(folder)
        for batch in batches:
            rows: list[tuple] = []
            for page, link, text, digest, refers_to, target in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or place >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, place = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = _gzip(build_record(page, link, text.encode("utf-8", "surrogatepass"), digest,
                                          refers_to, target))
                out.write(data)
                rows.append((part, name, reversed_host_key(link and _header_text(link)),
                             record_id(page, digest), page, place, len(data)))
                place += len(data)
            if rows:
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["part", "file", "key", "record", "page_id", "offset", "length"])
        if out is not None:
            out.close()

    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_k")
    roles = page_roles(pages, scratch, id_col, url, html).select(
        name(F.col("page_id")), F.col("page_id").isNull().alias("_n"), "digest", "refers_to", "target")
    rows = pages.select(name(F.col(id_col)), F.col(id_col).isNull().alias("_n"),
                        F.sha1(_payload(F.col(html))).alias("digest"), F.col(id_col).cast("string").alias("page_id"),
                        F.col(url).alias("url"), _payload(F.col(html)).alias("html"))
    joined = rows.join(roles.hint("shuffle_hash"), ["_k", "_n", "digest"])
    # a revisit needs no payload
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("").alias("html"),
                         "digest", F.col("refers_to").cast("string"), "target").mapInArrow(write, _ENTRY)


# --- the index -----------------------------------------------------------------------------------

def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Sort the entries into block files; returns (first_key, last_key, file) of each, lazily."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdxb"
        out, lines, directory, first, last = None, [], [], None, None

        def flush() -> None:
            data = zlib.compress("\n".join(lines).encode())
            directory.append((lines[0].split("\t", 1)[0], out.tell(), len(data)))
            out.write(data)
            lines.clear()

        for batch in batches:
            for sort_key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}", compression=None), sort_key
                lines.append(sort_key + "\t" + json.dumps(rest))
                last = sort_key
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = zlib.compress(json.dumps(directory).encode())
        place = out.tell()
        out.write(data)
        out.write(struct.pack(_FOOTER, place, len(data), zlib.crc32(data), _MAGIC))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([name])],
                                         names=["first_key", "last_key", "file"])

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = entries.select(F.concat_ws(" ", "key", "record").alias("sort_key"), "file", "offset", "length", "page_id")
    return (keyed.repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key")
            .mapInArrow(write, "first_key string, last_key string, file string"))


class IndexFile:
    """One block file: directory in memory, blocks read by range, the last one kept."""

    def __init__(self, folder: str, name: str):
        fs, root = open_folder(folder)
        self.stream = fs.open_input_file(f"{root}/{name}")
        size = struct.calcsize(_FOOTER)
        place, length, crc, magic = struct.unpack(_FOOTER, self.stream.read_at(size, self.stream.size() - size))
        data = self.stream.read_at(length, place)
        if magic != _MAGIC or zlib.crc32(data) != crc:
            raise ValueError(f"{name} is no index file or is damaged")
        self.blocks = json.loads(zlib.decompress(data))
        self.keys = [b[0] for b in self.blocks]
        self.at, self.lines = -1, []

    def find(self, sort_key: str) -> list | None:
        """[file, offset, length, page_id] of a key."""
        k = bisect.bisect_right(self.keys, sort_key) - 1
        if k < 0:
            return None
        if k != self.at:
            _, place, length = self.blocks[k]
            self.at, self.lines = k, zlib.decompress(self.stream.read_at(length, place)).decode().split("\n")
        i = bisect.bisect_left(self.lines, sort_key + "\t")
        if i < len(self.lines) and self.lines[i].startswith(sort_key + "\t"):
            return json.loads(self.lines[i].split("\t", 1)[1])
        return None


def read_record(folder: str, name: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    fs, root = open_folder(folder)
    with fs.open_input_file(f"{root}/{name}") as stream:
        return parse_record(zlib.decompress(stream.read_at(length, offset), 31))


def look_up(wanted: DataFrame, upper: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """(sort_key, page_id, payload_bytes, digest) of the record of every sort key in ``wanted`` that exists.

    ``upper`` has one row per index file (as many as tasks wrote it), so it is read on the driver.
    """
    files = sorted((r["first_key"], r["file"]) for r in upper.collect())
    firsts = [f for f, _ in files]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, -1
        for batch in batches:
            rows = []
            for sort_key in batch.column(0).to_pylist():
                k = bisect.bisect_right(firsts, sort_key) - 1
                if k < 0:
                    continue
                if k != at:  # keys arrive sorted, so each file is opened once a task
                    index, at = IndexFile(index_folder, files[k][1]), k
                hit = index.find(sort_key)
                if hit:
                    _, payload = read_record(archive_folder, *hit[:3])
                    rows.append((sort_key, hit[3], len(payload), hashlib.sha1(payload).hexdigest()))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["sort_key", "page_id", "payload_bytes", "digest"])

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (wanted.select("sort_key").repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key")
            .mapInArrow(find, "sort_key string, page_id string, payload_bytes long, digest string"))


# --- reading -------------------------------------------------------------------------------------

def _records(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    data = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(z.decompress(data))
            data = z.unused_data
        yield b"".join(parts)


_READ = "page_id string, payload_bytes long, digest string, record_type string, target_key string"


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the files; ``target_key`` is the index key of what a revisit refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _records(stream):
                        fields, payload = parse_record(record)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        key = None
                        if fields["WARC-Type"] == "revisit":
                            key = (reversed_host_key(fields.get("WARC-Refers-To-Target-URI")) + " "
                                   + fields["WARC-Refers-To"].removeprefix("<urn:uuid:").removesuffix(">"))
                        elif hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"a payload in {name} does not match its digest")
                        rows.append((fields.get("Page-ID"), len(payload), digest, fields["WARC-Type"], key))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                names=["page_id", "payload_bytes", "digest", "record_type", "target_key"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=["page_id", "payload_bytes", "digest", "record_type", "target_key"])

    names = files.select("file").distinct()
    return names.repartition(max(1, names.count())).mapInArrow(read, _READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives and index of all pages, read the archives back, and resolve revisits through the index."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives, index = scratch.folder("archives"), scratch.folder("index")
    entries = scratch.table(write_archives(pages, archives, scratch, id_col, url, html), "entries")
    upper = scratch.table(write_index(entries, index), "upper")
    records = scratch.table(read_archives(entries, archives), "records")
    targets = records.filter(F.col("target_key").isNotNull()).select(F.col("target_key").alias("sort_key")).distinct()
    found = scratch.table(look_up(targets, upper, index, archives), "found").select(
        F.col("sort_key").alias("target_key"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    kind = pages.schema[id_col].dataType
    return records.join(found, "target_key", "left").select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
