"""Phrase collocations counted in counting quotient filters.

Texts are cut into pieces and words once, a shard of bounded size at a time; a
shard keeps the ids of its own words.  A shuffled word count names the frequent
words of each language, and only they get ids: a phrase with a rarer word cannot
reach ``min_count`` itself.  Each shard then counts its own n-grams.  The word ids
of an n-gram are packed into one number of n x b bits and permuted invertibly (a
Feistel network), which spreads equal-looking keys evenly.  The top bits of the
permuted number choose a range; within it the next bits are the quotient, kept as
unary runs, and all others the remainder, kept in full.  So a sorted filter takes
a few bytes per distinct n-gram, and its counts are exact: the permutation is
undone to read the words back.  Filters of one range are merged across shards.

A range's filter is bounded by the number of ranges, which follows the number of
words; an n-gram that a third of the corpus repeats is one entry per shard.

Scores and the choice among nested phrases are joins on the merged counts.

Defined results
  - null or empty text: no words; null language: ``und``;
  - ids play no part: null and repeated ids count like others, and so do repeated rows;
  - an empty table, or one without frequent phrases, gives no rows;
  - only the text and language columns are read, whatever other columns are named.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, dense_rank
from .tokens import release_memory

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
INSIDE_PERCENT = 80
SCALE = 2_000_000
SHARD_BYTES = 8 << 20
RANGE_ENTRIES = 1 << 21  # of a merged filter at most, on average
ID_BITS = 32
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"

_BREAK = b"\n"
_TABLE = bytes.maketrans((UPPER + "\t" + PIECE_ENDS).encode(), (LOWER + " " + "\n" * len(PIECE_ENDS)).encode())
_HEAD = "<qBBB"  # entries, quotient bits, remainder bytes, counts above 254 follow


def shard_words(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of some texts: the word numbers in order (-1 between pieces), the distinct words, and their counts."""
    raw = _BREAK.join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    raw = raw.translate(_TABLE).replace(_BREAK, b" \n ")
    flat = pc.split_pattern(pa.array([raw], pa.large_binary()), b" ").flatten()
    coded = flat.dictionary_encode()
    known, code = coded.dictionary, np.asarray(coded.indices)
    real = np.asarray(pc.and_(pc.not_equal(known, b""), pc.not_equal(known, _BREAK)))
    number = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    blank = pc.index(known, pa.scalar(b"", known.type)).as_py()
    ids = number[code[code != blank]]
    return ids, known.filter(pa.array(real)).cast(pa.large_string()), np.bincount(ids[ids >= 0], minlength=int(real.sum()))


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = TaskContext.get().partitionId() << 33, {}, 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, *shard_words(texts)) for lang, texts in held.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(rows))), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1].tobytes() for r in rows], pa.binary()),
                 pa.array([r[2].to_pylist() for r in rows], pa.list_(pa.string())),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["shard", "lang", "codes", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    n += len(text)
                if n >= size:
                    yield flush()
                    at, held, n = at + len(held), {}, 0
        if held:
            yield flush()
        release_memory()

    return run


# ---- packed keys: n word ids of b bits as (hi, lo), permuted and back ----

def _halves(n: int, b: int) -> tuple[int, int]:
    """Bits of the left and the right half of a packed n-gram."""
    return n // 2 * b, (n - n // 2) * b


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _mix(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def permute(words: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) word ids as the two halves of a permuted n*b-bit number."""
    n = len(words)
    left, right = (np.zeros(words.shape[1], np.uint64) for _ in range(2))
    for i, w in enumerate(words.astype(np.uint64)):
        if i < n // 2:
            left = left << np.uint64(b) | w
        else:
            right = right << np.uint64(b) | w
    wl, wr = _halves(n, b)
    for turn in range(0, 4, 2):
        left = left ^ (_mix(right, turn) & _mask(wl))
        right = right ^ (_mix(left, turn + 1) & _mask(wr))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, n: int, b: int) -> np.ndarray:
    """The word ids of permuted numbers."""
    wl, wr = _halves(n, b)
    for turn in range(2, -1, -2):
        right = right ^ (_mix(left, turn + 1) & _mask(wr))
        left = left ^ (_mix(right, turn) & _mask(wl))
    out = np.zeros((n, len(left)), np.int64)
    for i in range(n):
        half, at = (left, n // 2 - 1 - i) if i < n // 2 else (right, n - 1 - i)
        out[i] = (half >> np.uint64(at * b) & _mask(b)).astype(np.int64)
    return out


def _number(left: np.ndarray, right: np.ndarray, n: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves as one number: its bits above 64, and the low 64."""
    wr = _halves(n, b)[1]
    if wr == 64:
        return left, right
    high = left >> np.uint64(64 - wr) if n * b > 64 else np.zeros_like(left)
    return high, left << np.uint64(wr) | right


def _split(high: np.ndarray, low: np.ndarray, n: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    wl, wr = _halves(n, b)
    if wr == 64:
        return high, low
    left = low >> np.uint64(wr)
    if n * b > 64:
        left = left | high << np.uint64(64 - wr)
    return left & _mask(wl), low & _mask(wr)


def _top(high: np.ndarray, low: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The top bits (63 at most) of numbers of a width."""
    rest = width - bits
    if bits == 0:
        return np.zeros(len(low), np.int64)
    if rest >= 64:
        return (high >> np.uint64(rest - 64)).astype(np.int64)
    found = low >> np.uint64(rest)
    if width > 64 and rest:
        found = found | high << np.uint64(64 - rest)
    elif width > 64:
        raise ValueError("a quotient must leave a remainder")
    return (found & _mask(bits)).astype(np.int64)


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers with the sum of their counts."""
    if not len(low):
        return high, low, np.zeros(0, np.int64)
    if high.any():
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    elif counts is None:
        low = np.sort(low)
    else:
        order = np.argsort(low, kind="stable")
        low = low[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    first = np.flatnonzero(new)
    sums = np.diff(np.append(first, len(low))) if counts is None else np.add.reduceat(counts[order], first)
    return high[first], low[first], sums


# ---- the filter: sorted quotients in unary, remainders in full, counts ----

def pack_filter(high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int, prefix: int) -> bytes:
    """A filter of sorted distinct numbers that agree in their top ``prefix`` bits."""
    k = len(low)
    q = max(0, min(k.bit_length() - 1, width - prefix - 1, 62 - prefix))
    quotient = _top(high, low, width, prefix + q) & ((1 << q) - 1)
    runs = np.zeros(k + (1 << q), np.uint8)
    runs[quotient + np.arange(k)] = 1
    size = -(-(width - prefix - q) // 8)
    both = np.stack([low, high], 1).astype("<u8").view(np.uint8)[:, :size]
    spare = width - prefix - q - 8 * (size - 1)  # bits of the last byte that belong to the remainder
    both = np.ascontiguousarray(both)
    both[:, -1] &= np.uint8((1 << spare) - 1)
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    return b"".join([struct.pack(_HEAD, k, q, size, len(large) > 0), np.packbits(runs).tobytes(), both.tobytes(),
                     small.tobytes(), large.tobytes()])


def unpack_filter(data: bytes, width: int, prefix: int, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers (high, low) and counts of a filter of the range ``place``."""
    k, q, size, _ = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    n_runs = -(-(k + (1 << q)) // 8)
    runs = np.unpackbits(np.frombuffer(data, np.uint8, n_runs, at), count=k + (1 << q))
    quotient = np.flatnonzero(runs) - np.arange(k)
    at += n_runs
    both = np.zeros((k, 16), np.uint8)
    both[:, :size] = np.frombuffer(data, np.uint8, k * size, at).reshape(k, size)
    at += k * size
    pairs = both.view("<u8")
    low, high = pairs[:, 0].copy(), pairs[:, 1].copy()
    counts = np.frombuffer(data, np.uint8, k, at).astype(np.int64)
    many = counts == 255
    counts[many] = np.frombuffer(data, "<i8", int(many.sum()), at + k)
    top = quotient.astype(np.uint64) | np.uint64(place << q)
    rest = width - prefix - q
    if rest < 64:
        low |= top << np.uint64(rest)
        if width > 64:
            high |= top >> np.uint64(64 - rest)
    else:
        high |= top << np.uint64(rest - 64)
    return high, low, counts


def _shard_filters(b: int, ranges: dict[int, int]):
    """Rows of (codes, map) to rows of (n, place, filter): the n-grams of a shard, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, found in zip(batch.column(0), batch.column(1)):
                codes = np.frombuffer(codes.as_buffer(), np.int32)
                to = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last one stands for -1
                to[np.asarray(found.values.field("i"))] = np.asarray(found.values.field("id"))
                ids = to[codes]
                rows = []
                for n, p in ranges.items():
                    k = len(ids) - n + 1
                    if k < 1:
                        continue
                    fits = np.ones(k, bool)
                    for j in range(n):
                        fits &= ids[j:j + k] >= 0
                    at = np.flatnonzero(fits)
                    halves = permute(np.stack([ids[at + j] for j in range(n)]), b)
                    high, low, counts = counted(*_number(*halves, n, b), None)
                    place = _top(high, low, n * b, p)
                    cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist() + [len(place)]
                    for x, y in zip(cuts, cuts[1:]):
                        rows.append((n, int(place[x]), pack_filter(high[x:y], low[x:y], counts[x:y], n * b, p)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.binary())], names=["n", "place", "filter"])
        release_memory()

    return run


def merge_filters(b: int, ranges: dict[int, int], least: int):
    """The filters of one range to rows (key, a) of the n-grams that reach ``least``."""

    def run(table: pa.Table) -> pa.Table:
        n, place = table.column("n")[0].as_py(), table.column("place")[0].as_py()
        parts = [unpack_filter(f.as_py(), n * b, ranges[n], place) for f in table.column("filter")]
        high, low, counts = counted(*(np.concatenate(x) for x in zip(*parts)))
        often = counts >= least
        words = restore(*_split(high[often], low[often], n, b), n, b)
        k = words.shape[1]
        keys = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * n, pa.int32()), pa.array(words.T.ravel()))
        return pa.Table.from_arrays([keys, pa.array(counts[often])], names=["key", "a"])

    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                  longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, range_entries: int = RANGE_ENTRIES,
                  id_bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, a) of all words and phrases that occur ``min_count`` times, (lang, word, a, id), (lang, n) of all words."""
    quote = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    rows = docs.select(F.coalesce(quote(lang), F.lit("und")).alias("lang"), quote(text).alias("text"))
    shards = scratch.table(rows.mapInArrow(
        _shards(shard_bytes), "shard long, lang string, codes binary, words array<string>, counts array<long>"), "shards")
    totals = scratch.table(shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
                           .groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted_words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(
        "lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("a")).filter(F.col("a") >= min_count)
    words = scratch.table(counted_words.withColumn("pos", F.monotonically_increasing_id()), "words")
    words = scratch.table(dense_rank(words).select("lang", "word", "a", F.col("rank").alias("id")), "ids")
    n_words, total = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    b = max(1, (n_words - 1).bit_length(), id_bits or 0)
    if b > ID_BITS:
        raise ValueError(f"{n_words} frequent words do not fit ids of {ID_BITS} bits")
    need = max(0, int(total // range_entries).bit_length())
    ranges = {n: min(need, n * b - 1) for n in range(2, longest + 1)}
    local = shards.select("shard", "lang", F.posexplode("words").alias("i", "word")).join(words, ["lang", "word"])
    maps = local.groupBy("shard").agg(F.collect_list(F.struct("i", "id")).alias("map"))
    filters = shards.select("shard", "codes").join(maps, "shard").select("codes", "map").mapInArrow(
        _shard_filters(b, ranges), "n int, place long, filter binary")
    phrases = filters.groupBy("n", "place").applyInArrow(merge_filters(b, ranges, min_count), "key array<long>, a long")
    return scratch.table(phrases.union(words.select(F.array("id"), "a")), "counts"), words, totals


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP, **sizes) -> DataFrame:
    """The ``top`` phrases of each language by score: (lang, rank, phrase, a, l, r, n, score).

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the language.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    counts, words, totals = phrase_counts(docs, scratch, text, lang, min_count, longest, **sizes)
    phrases = counts.filter(F.size("key") > 1)

    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")).select(
        "*", F.expr("slice(key, 1, k)").alias("left"), F.expr("slice(key, k + 1, size(key))").alias("right"))
    part = lambda side, name: counts.select(F.col("key").alias(side), F.col("a").alias(name))
    scored = (cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
              .withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)"))
              .groupBy("key").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
              .select("key", "best.a", "best.l", "best.r", "best.score"))

    inside = phrases.filter(F.size("key") > 2).select(F.col("a").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m))))"))
        .alias("key")).groupBy("key").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, "key", "left").filter(
        f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {INSIDE_PERCENT}").drop("longer")
    kept = scratch.table(kept, "kept")

    spelled = kept.select("key", F.posexplode("key").alias("i", "id")).join(words.select("id", "lang", "word"), "id").groupBy(
        "key").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = kept.join(spelled, "key").select(
        "lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each slice of a language, then the best of those
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = named.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
