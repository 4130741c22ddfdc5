"""Best-fit packing of token sequences by linear grouping and configurations.

Only the histogram of piece lengths (at most one row per possible length)
reaches the driver.  There the plan is made on counts, never on documents:

  1. large lengths are sorted and cut into groups of equal cardinality, each
     rounded up to its longest member;
  2. the few rounded sizes give a configuration program (how many sequences
     of which combination of sizes), solved by column generation;
  3. actual lengths are substituted for the rounded sizes in a share of the
     solution (rounding up asks for too many sequences; the excess stays in the
     unused share), the smallest member of each configuration left open or not;
  4. the rest and the small lengths go, longest first, where they fit best.

Several numbers of groups and shares are tried on the counts, best-fit alone
among them, and the plan of fewest sequences is kept.

Sequences with the same content of lengths stay one run of the plan, so its
size depends on the capacity and not on the number of documents.  The pieces
are then ranked among those of their length (in salted slices, so that a
length which a third of the pieces share is no single task) and each looks its
place up by (length, rank).

Defined results
  - null text counts as empty: a document of the end id alone;
  - documents longer than the capacity are cut into whole sequences, the first
    piece holding the remainder; no other document is cut;
  - repeated rows and ids are packed one by one; null ids are kept;
  - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .tokens import ID_BYTES, encoder, release_memory

CAPACITY = 1024
END_ID = 2
GROUPS = (32, 64)  # numbers of groups tried
SMALL = 1 / 8  # lengths up to this share of the capacity are small
SHARES = (0.95, 0.85, 0.75, 0.5, 0.25, 0.1)  # of the configurations, tried; the rounding's excess is in the rest
SLICE = 10_000  # pieces of one length ranked together


# --- the plan, on counts -------------------------------------------------------------------------

def solve_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (copies per size) and their multiplicities that cover ``counts`` with least sequences.

    The fractional cutting-stock program by column generation: the basis starts
    with one size per sequence, the best new configuration is a knapsack over
    the dual prices.
    """
    k = len(sizes)
    columns = [np.where(np.arange(k) == i, capacity // sizes[i], 0) for i in range(k)]
    inverse = np.diag(1.0 / np.array([c.max() for c in columns], float))
    amount = inverse @ counts
    for _ in range(60 * k):
        price = inverse.sum(axis=0)
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):  # rooms a size apart follow one another, those between go together
            for low in range(size, capacity + 1, size):
                into = slice(low, min(low + size, capacity + 1))
                option = value[low - size:into.stop - size] + price[i]
                better = option > value[into] + 1e-12
                value[into] = np.where(better, option, value[into])
                last[into] = np.where(better, i, last[into])
        if value.max() <= 1 + 1e-7:
            break
        column, room = np.zeros(k, int), int(value.argmax())
        while last[room] >= 0:
            i = last[room]
            column[i] += 1
            room -= int(sizes[i])
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= step[out]
        amount[out] /= step[out]
        step[out] = 0.0
        inverse -= np.outer(step, inverse[out])
        amount = np.maximum(amount - step * amount[out], 0.0)
        columns[out] = column
    return list(zip(columns, amount))


def plan_packing(histogram: Mapping[int, int], capacity: int = CAPACITY, groups: int | Sequence[int] = GROUPS,
                 small: float = SMALL, shares: Sequence[float] = SHARES) -> list[tuple[int, dict[int, int]]]:
    """Runs (number of sequences, {length: copies in each}) that hold every counted length.

    Every number of groups and every share of its configurations gives a plan,
    with the smallest members open or not; the one of fewest sequences is
    returned, or best-fit of all lengths where that takes fewer still.
    """
    full = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    rest = {n: c for n, c in histogram.items() if n < capacity and c}
    size = lambda runs: sum(c for c, _ in runs)
    least = size(full) - (-sum(n * c for n, c in rest.items()) // capacity)  # no plan is below this
    best = None
    for k in [groups] if isinstance(groups, int) else groups:
        grouped, left = _group(rest, capacity, k, small)
        if not grouped:
            break
        sizes = np.array([g[0][0] for g in grouped])
        counts = np.array([sum(c for _, c in g) for g in grouped], float)
        solution = solve_configurations(sizes, counts, capacity)
        for share in shares:
            for keep_open in (True, False):
                runs = _substitute(full, grouped, left, solution, share, keep_open, capacity)
                if best is None or size(runs) < size(best):
                    best = runs
                if size(best) == least:
                    return best
    plain = _best_fit(full, rest, capacity)
    return plain if best is None or size(plain) < size(best) else best


def _group(rest: Mapping[int, int], capacity: int, groups: int,
           small: float) -> tuple[list[list[tuple[int, int]]], dict[int, int]]:
    """Large lengths in groups of equal cardinality, as (length, count) from the longest, and the small lengths."""
    large = sorted((n for n in rest if n > small * capacity), reverse=True)
    left = {n: c for n, c in rest.items() if n <= small * capacity}
    quota = max(1, -(-sum(rest[n] for n in large) // groups))
    grouped: list[list[tuple[int, int]]] = []
    room = 0
    for n in large:
        more = rest[n]
        while more:
            if not room:
                if not grouped or grouped[-1][0][0] != n:
                    grouped.append([])
                room = quota
            took = min(more, room)
            grouped[-1].append((n, took))
            more, room = more - took, room - took
    return grouped, left


def _substitute(full: list[tuple[int, dict[int, int]]], groups: list[list[tuple[int, int]]], small: Mapping[int, int],
                solution: list[tuple[np.ndarray, float]], share: float, keep_open: bool,
                capacity: int) -> list[tuple[int, dict[int, int]]]:
    """A share of the configurations filled with actual lengths; all that is left goes by best-fit."""
    runs, rest = list(full), dict(small)
    grouped = [[list(x) for x in g] for g in groups]
    for column, amount in solution:
        whole = int(amount * share + 1e-6)
        used = [(i, int(a)) for i, a in enumerate(column) if a]
        if keep_open and sum(a for _, a in used) > 1:  # the smallest member is fitted on actual lengths below
            used[-1] = (used[-1][0], used[-1][1] - 1)
            used = [x for x in used if x[1]]
        whole = min([whole, *(sum(c for _, c in grouped[i]) // a for i, a in used)])
        while whole:  # as many equal sequences as the front lengths of the groups allow
            mix: dict[int, int] = {}
            same = whole
            for i, a in used:
                n, c = grouped[i][0]
                same = min(same, c // a) if c >= a else 1
            for i, a in used:
                need = a * same
                while need:
                    n, c = grouped[i][0]
                    took = min(c, need)
                    mix[n] = mix.get(n, 0) + took
                    need -= took
                    grouped[i][0][1] -= took
                    if not grouped[i][0][1]:
                        grouped[i].pop(0)
            runs.append((same, {n: c // same for n, c in mix.items()}))
            whole -= same
    for g in grouped:
        for n, c in g:
            rest[n] = rest.get(n, 0) + c
    return _best_fit(runs, rest, capacity)


def _best_fit(runs: list[tuple[int, dict[int, int]]], rest: Mapping[int, int],
              capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Add the counted lengths, longest first, each where the least room is left."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for count, mix in runs:
        by_room.setdefault(capacity - sum(n * c for n, c in mix.items()), []).append((count, mix))
    rooms = sorted(by_room)

    def put(room: int, run: tuple[int, dict[int, int]]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(run)

    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            while at < len(rooms) and not by_room[rooms[at]]:
                del by_room[rooms.pop(at)]
            if at == len(rooms):
                put(capacity, (-(-left // (capacity // n)), {}))
                continue
            room = rooms[at]
            count, mix = by_room[room].pop()
            copies = min(room // n, left)
            took = min(count, left // copies)
            put(room - copies * n, (took, {**mix, n: mix.get(n, 0) + copies}))
            if count > took:
                put(room, (count - took, mix))
            left -= took * copies
    return [run for room in rooms for run in by_room[room]]


def plan_places(runs: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """The plan as intervals of (length, rank): length, first rank, first sequence, copies, first offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for count, mix in runs:
        offset = 0
        for n in sorted(mix, reverse=True):
            rows.append((n, ranks.get(n, 0), sequence, mix[n], offset))
            ranks[n] = ranks.get(n, 0) + count * mix[n]
            offset += n * mix[n]
        sequence += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(5))


# --- the pieces, in Spark ------------------------------------------------------------------------

def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                    capacity: int = CAPACITY, end_id: int = END_ID, texts_per_call: int = 4096,
                    words_kept: int = 300_000) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every piece; ids as little-endian uint32 bytes.

    ``texts_per_call`` and ``words_kept`` trade a worker's memory for time; they do not change the result.
    """
    end = int(end_id).to_bytes(ID_BYTES, "little")
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_path, words_kept)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_per_call):
                part = batch.slice(at, texts_per_call)
                owner, piece, start, ids = [], [], [], []
                for k, one in enumerate(tok.encode(part.column(1))):
                    one += end
                    n = len(one) // ID_BYTES
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for j, (a, b) in enumerate(zip(edges, edges[1:])):
                        owner.append(k)
                        piece.append(j)
                        start.append(a)
                        ids.append(one[a * ID_BYTES:b * ID_BYTES])
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // ID_BYTES
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(cut, schema)


def place_pieces(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, groups: int | Sequence[int] = GROUPS,
                 small: float = SMALL) -> DataFrame:
    """``pieces`` (any columns next to doc_id, piece, length) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    length, first, sequence, copies, offset = plan_places(plan_packing(histogram, capacity, groups, small))
    key = length * np.int64(1 << 48) + first

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(), rank.to_numpy()
        k = np.searchsorted(key, n * np.int64(1 << 48) + rank, "right") - 1
        into, spot = np.divmod(rank - first[k], copies[k])
        return pd.DataFrame({"sequence_id": sequence[k] + into, "offset": offset[k] + spot * n})

    # only lengths with many pieces are sliced, so there are few slices in all
    slices = F.array(*[F.lit(max(1, -(-histogram.get(n, 0) // SLICE))) for n in range(capacity + 1)])
    salted = pieces.withColumn("_slice", F.pmod(F.xxhash64(*pieces.columns), F.get(slices, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (salted.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
              .select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    order = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["length", "_slice"])
    placed = ranked.withColumn("_place", place("length", F.col("_first") + F.col("_rank")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, groups: int | Sequence[int] = GROUPS,
                   small: float = SMALL, carry: Mapping[str, Column] | None = None, **memory: int) -> DataFrame:
    """Every piece with its place.

    ``carry``: columns to take along instead of the ids themselves; ``memory``: see ``tokenize_pieces``.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = tokenize_pieces(docs, tokenizer_path, id_col, text, capacity, end_id, **memory)
    kept = scratch.table(pieces.select("doc_id", "piece", "start", "length",
                                       *[c.alias(name) for name, c in carry.items()]), "pieces")
    return place_pieces(kept, scratch, capacity, groups, small)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), ids joined in order of offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
