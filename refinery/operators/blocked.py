"""Iterations over a sparse matrix whose rows and columns both outgrow one machine.

A matrix is a table of entries ``(id, index, value)``.  Its rows are dealt into
blocks of a bounded number of entries, each packed into one row once.  The columns are dealt into
buckets, and a static table lists which columns of a bucket each block touches.  An iteration gives
every block the vectors of its own columns, runs a NumPy function over the block, and sums the
vectors that come back per column.  What is shuffled between blocks and buckets is one binary value
for each pair of them, not a row for each vector.  Models with a vector per column (topic weights,
principal directions) therefore stay tables; what passes through the driver is
one number or a small square matrix per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.session import Tables, compute_partitions, cut_lineage, release

BLOCK_ENTRIES = 1 << 19
WIDE_ENTRIES = 1 << 20  # of a block where there are more than WIDE_COLUMNS columns: larger blocks share more of their vectors
WIDE_COLUMNS = 1 << 16
BUCKET_PAIRS = 1 << 18  # of a block and a column, in a bucket
PASS_BYTES, PASS_BYTES_ENTRY = 1 << 29, 32  # of the vectors sent to the blocks and back at a time: the larger of both bounds
VECTOR_BYTES = 256 << 20  # of the vectors of one block, if it touches a column per entry
SUM_ENTRIES = 1 << 12
HELD_BYTES = 64 << 20  # of sums kept in a task before they are handed on

VECTORS = T.StructType([T.StructField("index", T.LongType()), T.StructField("vec", T.BinaryType())])
PIECES = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType()),
                       T.StructField("vec", T.BinaryType())])
BlockFunction = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]
SumFunction = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def number_rows(df: DataFrame, order: list[Column], out: str = "index") -> DataFrame:
    """The rows with their place (a long, from 0) in a total order: a range sort, and one offset per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(part).agg(F.min("_pos").alias("_lo"), F.count("*").alias("_n"))
              .select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift")))
    return (placed.withColumn("_part", F.shiftright("_pos", 33)).join(F.broadcast(starts), "_part")  # one row per partition
            .withColumn(out, F.col("_pos") + F.col("_shift")).select(*df.columns, out))


class Block:
    """One packed block: its number, ``ids``, and its entries by ``row`` and ``column``, numbered from 0; ``index`` names the columns."""

    def __init__(self, packed: pa.Table):
        self.number = packed.column("block")[0].as_py()
        self.ids = packed.column("ids").combine_chunks().flatten()
        self.index = _unpressed(packed.column("index")[0], "<i8")
        self.row, self.column = (_unpressed(packed.column(c)[0], "<i4") for c in ("row", "column"))
        self.value = _unpressed(packed.column("value")[0], "<f8", steps=False)

    @property
    def heads(self) -> np.ndarray:
        """The first entry of every row."""
        return np.flatnonzero(np.diff(self.row, prepend=-1))

    def column_sums(self, rows: np.ndarray) -> np.ndarray:
        """The sum over every column's entries of value x row of ``rows``."""
        by = np.argsort(self.column, kind="stable")
        return weighted_sums(rows, self.row[by], self.value[by], np.flatnonzero(np.diff(self.column[by], prepend=-1)))


@dataclass
class Blocked:
    """``packed``, one row per block with its entries in compressed binary columns, and ``wants`` (bucket, part, at), the
    columns of each bucket that each block touches; both are tables in the checkpoint folder until ``drop``."""

    packed: DataFrame
    wants: DataFrame
    id_type: T.DataType
    n_entries: int
    n_blocks: int
    block_entries: int
    n_pairs: int
    n_buckets: int
    tables: Tables

    @classmethod
    def of(cls, entries: DataFrame, block_entries: int | None = None, n_entries: int | None = None,
           n_columns: int | None = None) -> Blocked:
        """Deal ``(id, index, value)`` entries (they and their columns are counted here unless given) into blocks, enough
        for all cores.

        All entries of a row stay together.
        """
        spark = entries.sparkSession
        if n_entries is None or block_entries is None and n_columns is None:
            n_entries, last = entries.agg(F.count("*"), F.max("index")).first()
            n_columns = 0 if last is None else last + 1
        size = block_entries or (WIDE_ENTRIES if n_columns > WIDE_COLUMNS else BLOCK_ENTRIES)
        blocks = max(1, -(-n_entries // size), min(compute_partitions(spark), -(-n_entries // 1024)))
        id_type = entries.schema["id"].dataType
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("width", T.LongType()),
                               T.StructField("ids", T.ArrayType(id_type)),
                               *[T.StructField(c, T.BinaryType()) for c in ("index", "row", "column", "value")]])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]  # of one block as a rule, which a sort by block would only copy
            found = np.concatenate([np.asarray(b.column(0)) for b in held]) if held else np.zeros(0, np.int64)
            for number in np.unique(found).tolist():
                whole = [b if (np.asarray(b.column(0)) == number).all() else b.filter(pc.equal(b.column(0), number)) for b in held]
                part = pa.Table.from_batches(whole)
                coded = part.column("id").combine_chunks().dictionary_encode("encode")
                row = np.asarray(coded.indices).astype("<i4")
                index, column = np.unique(np.asarray(part.column("index")), return_inverse=True)
                by = np.lexsort((column, row))
                value = np.asarray(part.column("value"))[by].astype("<f8")
                raw = [_pressed(x) for x in (index.astype("<i8"), row[by], column[by].astype("<i4"))]
                ids = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(index)], pa.int64()), ids, *[
                    pa.array([x], pa.binary()) for x in (*raw, _pressed(value, steps=False))]], names=schema.names)

        numbers = F.array(*map(F.lit, _apart(spark, blocks)))
        dealt = entries.select(F.get(numbers, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).alias("block"), "id",
                               F.col("index").cast("long").alias("index"), F.col("value").cast("double").alias("value"))
        tables = Tables(spark, "blocks")
        packed = tables.keep(_dealt(dealt, blocks).mapInArrow(pack, schema))
        pairs = packed.agg(F.sum("width")).first()[0] or 0
        buckets = max(1, -(-pairs // BUCKET_PAIRS), min(compute_partitions(spark), -(-pairs // 4096)))

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, index in zip(batch.column(0).to_pylist(), batch.column(1)):
                    index = _unpressed(index, "<i8")
                    some = list(_by_bucket(index, buckets))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in some], pa.int64()), pa.array([part] * len(some), pa.int64()),
                         pa.array([_pressed(index[at] // buckets) for _, at in some], pa.binary())], names=["bucket", "part", "at"])

        wants = tables.keep(packed.select("block", "index").mapInArrow(columns, "bucket long, part long, at binary"))
        release(spark)  # what dealt the blocks
        return cls(packed, wants, id_type, n_entries, blocks, size, pairs, buckets, tables)

    def drop(self) -> None:
        """Remove the tables; what was made of them must have been written."""
        self.tables.drop()

    @property
    def most_numbers(self) -> int:
        """Numbers of a vector that may be sent at a time, so that a pass takes disk in proportion to the entries."""
        return max(1, max(PASS_BYTES, PASS_BYTES_ENTRY * self.n_entries) // (16 * max(1, self.n_pairs)))

    def column_sums(self, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(index, vec): the sum over every column's entries of ``run(values)``, a row of numbers per entry."""
        buckets = self.n_buckets

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(pa.Table.from_batches([batch.slice(i, 1)]))
                    found = run(block.value)
                    found = np.column_stack([np.bincount(block.column, x, len(block.index)) for x in found.T])
                    yield from pieces(block, found, buckets).to_batches()

        return self._added(_dealt(self.packed, self.n_blocks).mapInArrow(sums, PIECES))

    def apply(self, table: DataFrame, run: BlockFunction, schema: T.StructType) -> DataFrame:
        """``run(row, column, value, ids, vectors)`` over every block, with its rows and columns numbered locally.

        ``table`` is (index, vec) with one binary vector of doubles per column; ``run`` yields the columns of Arrow batches.
        """
        return self.meet(self.replies(table), _with_vectors(run, self.n_buckets), schema)

    def sums(self, table: DataFrame, run: SumFunction) -> DataFrame:
        """(index, vec): the sum over the blocks of what ``run(row, column, value, ids, vectors)`` returns, a row per column."""
        buckets = self.n_buckets

        def split(block: Block, right: pa.Table) -> Iterator[pa.Table]:
            vectors = block_vectors(block.index, right, buckets)
            yield pieces(block, run(block.row, block.column, block.value, block.ids, vectors), buckets)

        return self._added(self.meet(self.replies(table), split, PIECES))

    def meet(self, rows: DataFrame, run: Callable[[Block, pa.Table], Iterator], schema: T.StructType) -> DataFrame:
        """``run(block, rows)`` over every block and its rows of a table with a column ``part``; it yields tables or columns."""

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            out = pa.schema([(f.name, _ARROW[type(f.dataType)]) if type(f.dataType) in _ARROW else
                             (f.name, left.schema.field("ids").type.value_type) for f in schema])
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            found = [x if isinstance(x, pa.Table) else pa.Table.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, out.field(i).type) for i, c in enumerate(x)], schema=out)
                for x in run(Block(left), right)]
            return pa.concat_tables(found or [out.empty_table()])

        return _dealt(self.packed, self.n_blocks).groupBy("block").cogroup(rows.groupBy("part")).applyInArrow(block, schema)

    def replies(self, table: DataFrame) -> DataFrame:
        """(bucket, part, vec): for each block, the vectors of its columns of an (index, vec) table."""
        n = self.n_buckets

        def reply(wants: pa.Table, vectors: pa.Table) -> pa.Table:
            if not wants.num_rows or not vectors.num_rows:
                return _EMPTY
            at, m = np.asarray(vectors.column("index").combine_chunks()) // n, matrix(vectors.column("vec"))
            order = np.argsort(at)
            return _replies(wants, at[order], m[order])

        held = table.select("index", "vec", F.pmod("index", F.lit(n)).cast("long").alias("bucket"))
        return self.wants.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(reply, PIECES)

    def exchange(self, sent: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(bucket, part, vec) sent by the blocks, added up by column, changed and sent back to the blocks."""

        def run(wants: pa.Table, sent: pa.Table) -> pa.Table:
            if not sent.num_rows:
                return _EMPTY
            at, m = _add(wants, sent)
            return _replies(wants, at, change(m))

        return self.wants.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(run, PIECES)

    def totals(self, sent: DataFrame, change: Callable[[np.ndarray, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
        """``change(index, vectors)`` of what the blocks sent, added up by column, for every bucket."""
        n = self.n_buckets

        def run(wants: pa.Table, sent: pa.Table) -> pa.Table:
            if not sent.num_rows:
                return change(np.zeros(0, np.int64), np.zeros((0, 1))).slice(0, 0)
            at, m = _add(wants, sent)
            return change(at * n + sent.column("bucket")[0].as_py(), m)

        return self.wants.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(run, schema)

    def _added(self, sent: DataFrame) -> DataFrame:
        return self.totals(sent, lambda index, m: pa.Table.from_batches([_vectors(index, m)]), VECTORS)


def _pressed(x: np.ndarray, steps: bool = True) -> bytes:
    """Numbers (or the steps between them) as compressed bytes, after the number of bytes they take."""
    raw = (np.diff(x, prepend=x.dtype.type(0)) if steps else x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpressed(data: pa.Scalar, kind: str, steps: bool = True) -> np.ndarray:
    raw = data.as_buffer()
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    x = np.frombuffer(pa.decompress(raw.slice(8), size, codec="zstd") if size else b"", kind)
    return np.cumsum(x, dtype=kind) if steps else x


def _by_bucket(index: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that holds some of the columns, and the places of these."""
    bucket = index % buckets
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for low, high in zip(heads, np.append(heads[1:], len(order))):
        yield int(bucket[order[low]]), order[low:high]


def pieces(block: Block, vectors: np.ndarray, buckets: int) -> pa.Table:
    """A block's vectors, one row per bucket."""
    some = [(b, vectors[at].astype("<f8", copy=False).tobytes()) for b, at in _by_bucket(block.index, buckets)]
    return pa.table([pa.array([b for b, _ in some], pa.int64()), pa.array([block.number] * len(some), pa.int64()),
                     pa.array([v for _, v in some], pa.binary())], names=PIECES.names)


def block_vectors(index: np.ndarray, rows: pa.Table, buckets: int) -> np.ndarray:
    """The vectors of a block's columns, of its rows (bucket, vec)."""
    held = dict(zip(rows.column("bucket").to_pylist(), (v for c in rows.column("vec").chunks for v in c)))
    out = None
    for bucket, at in _by_bucket(index, buckets):
        found = np.frombuffer(held[bucket].as_buffer(), "<f8").reshape(len(at), -1)
        out = np.empty((len(index), found.shape[1])) if out is None else out
        out[at] = found
    return out


def _with_vectors(run: BlockFunction, buckets: int) -> Callable[[Block, pa.Table], Iterator]:
    return lambda block, rows: run(block.row, block.column, block.value, block.ids, block_vectors(block.index, rows, buckets))


def _wanted(wants: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, block, places in the bucket) in the order of the blocks."""
    rows = zip(wants.column("part").to_pylist(), wants.column("bucket").to_pylist(), (v for c in wants.column("at").chunks for v in c))
    for part, bucket, at in sorted(rows, key=lambda r: r[0]):
        yield bucket, part, _unpressed(at, "<i8")


def _add(wants: pa.Table, sent: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of a bucket's columns, and the sums of the vectors that the blocks sent."""
    held = dict(zip(sent.column("part").to_pylist(), (v for c in sent.column("vec").chunks for v in c)))
    wanted = [(part, at) for _, part, at in _wanted(wants)]
    places = np.unique(np.concatenate([at for _, at in wanted]))
    total = None
    for part, at in wanted:
        found = np.frombuffer(held[part].as_buffer(), "<f8").reshape(len(at), -1)
        total = np.zeros((len(places), found.shape[1])) if total is None else total
        total[np.searchsorted(places, at)] += found
    return places, total


def _replies(wants: pa.Table, places: np.ndarray, vectors: np.ndarray) -> pa.Table:
    """(bucket, part, vec) to every block that wants columns of a bucket; ``places`` ascend."""
    rows = [(bucket, part, vectors[np.searchsorted(places, at)].tobytes()) for bucket, part, at in _wanted(wants)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary())], names=PIECES.names)


_EMPTY = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("vec", pa.binary())]).empty_table()


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows by block; a block is long work on little data: a task each, whatever the bytes."""
    return rows.repartition(blocks, "block")


def _apart(spark: SparkSession, blocks: int) -> list[int]:
    """Numbers for the blocks such that a repartitioning by number into as many tasks gives every task one block."""
    task = F.pmod(F.hash("id"), F.lit(blocks)).alias("task")
    found = spark.range(16 * blocks + 256).groupBy(task).agg(F.min("id").alias("number")).collect()  # a row per block
    numbers = {r["task"]: r["number"] for r in found}
    return [numbers.get(t, -1 - t) for t in range(blocks)]


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(),
          T.ArrayType: pa.list_(pa.float64())}


def blobs(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix of doubles."""
    width = 8 * matrix.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(matrix, "<f8"))
    if len(matrix) * width < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(matrix),
                                     [None, pa.py_buffer((np.arange(len(matrix) + 1) * width).astype("<i4")), data])
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def matrix(vecs: pa.Array) -> np.ndarray:
    """Binary values of one length as a matrix of doubles, one row each."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    if not len(vecs):
        return np.zeros((0, 0))
    wide = pa.types.is_large_binary(vecs.type)
    ends = np.frombuffer(vecs.buffers()[1], "<i8" if wide else "<i4")[vecs.offset:vecs.offset + len(vecs) + 1]
    data = np.frombuffer(vecs.buffers()[2], np.uint8)[int(ends[0]):int(ends[-1])]
    return data.view("<f8").reshape(len(vecs), -1)


def weighted_sums(table: np.ndarray, at: np.ndarray, value: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sum of value x row ``at`` of a table over each run of entries, given by the first ones of the runs.

    Some ``SUM_ENTRIES`` at a time, so that the products stay in a core's cache.
    """
    out, ends = np.empty((len(heads), table.shape[1])), np.append(heads[1:], len(at))
    first = 0
    while first < len(heads):
        begin = heads[first]
        stop = max(first + 1, int(np.searchsorted(ends, begin + SUM_ENTRIES, "right")))
        part = slice(begin, ends[stop - 1])
        out[first:stop] = np.add.reduceat(table[at[part]] * value[part][:, None], heads[first:stop] - begin, axis=0)
        first = stop
    return out


def _per_index(index: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of every index, by index."""
    by = np.argsort(index, kind="stable")
    index = index[by]
    heads = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[heads], np.add.reduceat(vectors[by], heads, axis=0)


def _vectors(index: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), blobs(vectors)], names=["index", "vec"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per index by width: what fits ``HELD_BYTES`` is added up before it is handed on."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for some in held.values():
            yield _vectors(*_per_index(np.concatenate([i for i, _ in some]), np.concatenate([m for _, m in some])))

    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(1)))
        for width in np.unique(sizes).tolist():
            mine = batch.filter(pa.array(sizes == width)) if (sizes != width).any() else batch
            held.setdefault(width, []).append((np.array(mine.column(0)), matrix(mine.column(1)).copy()))
            n += mine.num_rows * width
        if n > HELD_BYTES:
            held = {w: [_per_index(np.concatenate([i for i, _ in some]), np.concatenate([m for _, m in some]))]
                    for w, some in held.items()}
            n = sum(m.nbytes for some in held.values() for _, m in some)
            if n > HELD_BYTES // 2:
                yield from flush()
                held, n = {}, 0
    yield from flush()


def _ordered_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by index to one row per index."""
    at, total = None, None
    for batch in batches:
        index, n = np.asarray(batch.column(0)), batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(1)))
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), n]  # rows of one width at a time
        for low, high in zip(cuts, cuts[1:]):
            found, sums = _per_index(index[low:high], matrix(batch.column(1).slice(low, high - low)))
            if at is not None and found[0] == at:
                sums[0] += total
            elif at is not None:
                yield _vectors(np.array([at]), total[None])
            if len(found) > 1:
                yield _vectors(found[:-1], sums[:-1])
            at, total = int(found[-1]), sums[-1].copy()
    if at is not None:
        yield _vectors(np.array([at]), total[None])


def sum_vectors(rows: DataFrame) -> DataFrame:
    """The sum of the vectors of every index, added up in each task before they are shuffled."""
    return (rows.select("index", "vec").mapInArrow(_sums, VECTORS).repartition("index")
            .sortWithinPartitions("index").mapInArrow(_ordered_sums, VECTORS))


def total_vector(rows: DataFrame, run: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``run`` (a vector of ``width``) over batches of the table's vectors; one small row per task is read."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += run(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vec"])

    found = rows.select("vec").mapInArrow(part, "vec binary").toArrow().column(0).to_pylist()
    return np.sum([np.frombuffer(v, "<f8") for v in found], axis=0) if found else np.zeros(width)
