"""Token-id files: coded, checksummed blocks of ids with a directory of documents.

One file holds a contiguous range of documents in ascending order of id:

    header     magic, vocabulary size
    block      number of ids, coded bytes, CRC-32 of the ids, coded words    (repeated)
    directory  Arrow stream (zlib) of (doc_id, n_tokens)
    footer     place, size and CRC-32 of the directory, number of ids, magic

All numbers are little-endian.  Every block decodes alone.  Files are written
by the tasks that sorted their range, under a name of their own per attempt;
the manifest, a table that Spark commits, names the files that count.

Defined results
  - null text counts as empty: the end id alone; null ids come last;
  - rows that repeat an id follow one another; an empty table gives no files;
  - a damaged block or directory raises ``ValueError`` on reading.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import range_coder
from .common import Scratch, open_folder
from .tokens import ID_BYTES, encoder, release_memory

MAGIC = b"TOKIDS1\n"
_BLOCK, _FOOTER, _HEADER = "<III", "<QQIQ8s", "<8sI"
END_ID = 2


def _coded_blocks(ids: bytes, vocabulary: int) -> bytes:
    step = range_coder.BLOCK * ID_BYTES
    raw = [ids[i:i + step] for i in range(0, len(ids), step)]
    coded = range_coder.encode_blocks([np.frombuffer(r, "<u4") for r in raw], vocabulary)
    return b"".join(part for r, c in zip(raw, coded)
                    for part in (struct.pack(_BLOCK, len(r) // ID_BYTES, len(c), zlib.crc32(r)), c))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Write the files under ``folder`` (shared); returns the manifest (part, file, n_docs, n_tokens), not yet run."""
    spark = docs.sparkSession
    end = int(end_id).to_bytes(ID_BYTES, "little")
    full = range_coder.BLOCK * range_coder.LANES * ID_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_path)
        vocabulary = max(tok.model.get_vocab_size(), end_id + 1)
        part, owners, counts, held, n = TaskContext.get().partitionId(), [], [], [], 0
        fs, root = open_folder(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                if some.num_rows and out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(struct.pack(_HEADER, MAGIC, vocabulary))
                owners.append(some.column(0))
                for one in tok.encode(some.column(1)):
                    counts.append(len(one) // ID_BYTES + 1)
                    held += (one, end)
                    n += len(one) + ID_BYTES
                if n >= full:
                    ids = b"".join(held)
                    whole = n // full * full
                    for i in range(0, whole, full):
                        out.write(_coded_blocks(ids[i:i + full], vocabulary))
                    held, n = [ids[whole:]], n - whole
        if out is None:
            return
        if n:
            out.write(_coded_blocks(b"".join(held), vocabulary))
        table = pa.Table.from_arrays([pa.chunked_array(owners), pa.array(counts, pa.int64())],
                                     names=["doc_id", "n_tokens"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        directory = zlib.compress(sink.getvalue().to_pybytes())
        place = out.tell()
        out.write(directory)
        out.write(struct.pack(_FOOTER, place, len(directory), zlib.crc32(directory), sum(counts), MAGIC))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(counts)], pa.int64()),
             pa.array([sum(counts)], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])
        release_memory()

    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(text)]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_col, text).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(write, "part int, file string, n_docs long, n_tokens long")


def _read_blocks(stream, begin: int, stop: int, vocabulary: int) -> Iterator[bytes]:
    """The ids of the blocks between two places of a file, a bounded number of blocks at a time."""
    stream.seek(begin)
    while stream.tell() < stop:
        heads, coded = [], []
        while stream.tell() < stop and len(coded) < range_coder.LANES:
            heads.append(struct.unpack(_BLOCK, stream.read(struct.calcsize(_BLOCK))))
            coded.append(stream.read(heads[-1][1]))
        found = range_coder.decode_blocks(coded, [h[0] for h in heads], vocabulary)
        for (_, _, crc), ids in zip(heads, found):
            raw = ids.astype("<u4").tobytes()
            if zlib.crc32(raw) != crc:
                raise ValueError("a block of token ids does not match its checksum")
            yield raw


def read_token_file(folder: str, name: str) -> Iterator[tuple[pa.Scalar, int, bytes]]:
    """(doc_id, place of its first id in the file, ids) of every document of a file, in order."""
    fs, root = open_folder(folder)
    with fs.open_input_file(f"{root}/{name}") as stream:
        size = stream.size()
        stream.seek(size - struct.calcsize(_FOOTER))
        place, length, crc, _, magic = struct.unpack(_FOOTER, stream.read(struct.calcsize(_FOOTER)))
        stream.seek(0)
        head, vocabulary = struct.unpack(_HEADER, stream.read(struct.calcsize(_HEADER)))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{name} is no token file")
        stream.seek(place)
        directory = stream.read(length)
        if zlib.crc32(directory) != crc:
            raise ValueError(f"the directory of {name} does not match its checksum")
        table = pa.ipc.open_stream(zlib.decompress(directory)).read_all()
        blocks = _read_blocks(stream, struct.calcsize(_HEADER), place, vocabulary)
        held, start = b"", 0
        for owner, n in zip(table.column(0), table.column(1).to_pylist()):
            parts, have = [held], len(held)
            while have < n * ID_BYTES:
                parts.append(next(blocks))
                have += len(parts[-1])
            held = b"".join(parts)
            yield owner, start, held[:n * ID_BYTES]
            held = held[n * ID_BYTES:]
            start += n


def read_token_files(manifest: DataFrame, folder: str, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files of a written manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for owner, start, ids in read_token_file(folder, name):
                    kind = owner.type
                    rows.append((owner, first + start, ids))
                    held += len(ids)
                    if held > 8_000_000:
                        yield _batch(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kind)

    def _batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        owners, starts, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([o.as_py() for o in owners], kind), pa.array(starts, pa.int64()),
             pa.array([len(i) // ID_BYTES for i in ids], pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    n = max(1, manifest.count())
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return files.repartition(n).mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
               end_id: int = END_ID) -> DataFrame:
    """Write the files of all documents into the shared scratch folder and read them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = scratch.folder("files")
    manifest = scratch.table(write_token_files(docs, tokenizer_path, folder, id_col, text, end_id), "manifest")
    return read_token_files(manifest, folder, docs.select(id_col).schema[0].dataType)
