"""LM scoring by context-tree weighting over bytes, with a unigram base next to it.

A byte is eight binary decisions.  Each decision has a context tree over the
bytes before it, of depth ``DEPTH``: the node of a context counts the zeros and
ones that followed it in the training texts and estimates by Krichevsky and
Trofimov; its weighted probability is the mean of its own estimate and of the
product of its children's weighted probabilities.  The share of its own
estimate in that mean is how much the node trusts itself, so a prediction mixes
the estimates of all depths along the context path.  Contexts that training
never saw predict 1/2.

Everything follows from the counts of (context, next byte), gathered from all
training texts:

  - partitions count words and byte 4-grams and Spark sums them;
  - a subtree below the two nearest bytes is one group of at most 256 x 256
    counts; the levels above have at most 65,536 + 256 + 1 nodes;
  - the finished model is a row of 256 byte probabilities per context.  It is
    sent to the tasks while its rows stay within ``BROADCAST_ROWS``; a larger
    one is joined to the contexts of each document instead, with equal scores.

The base needs the count of each word of each document.  The most frequent
words are priced where a text is read; the others travel as (hash, count) to a
join with the corpus counts, so a very common word is no hot key.

Defined results
  - null or empty text: the end symbol alone; the text is scored whole;
  - a document is held out if crc32(id as text) mod 7 is 2; a null id counts as
    the empty text (training);
  - repeated rows all train and all are scored; an empty table gives no rows;
  - without any training text every byte costs 8 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

DEPTH = 3  # bytes of context; the codes below pack 3 + 1 bytes
EDGE = 0xFF  # never in UTF-8: stands before and after a text
FREQUENT = 20_000  # words priced where texts are read
BROADCAST_ROWS = 100_000  # model rows of 1 KB sent to every task
_FOLDS, _HELD = 7, 2
_WORD, _GRAM, _DOC = 0, 1, 2
_NODES = 255


# --- estimates -----------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift += np.log(np.where(small, y, 1.0))
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (by level, then prefix) from rows of 256 byte counts."""
    pairs = [counts.reshape(len(counts), 1 << level, 2, -1).sum(-1) for level in range(8)]
    return (np.concatenate([p[:, :, 0] for p in pairs], axis=1), np.concatenate([p[:, :, 1] for p in pairs], axis=1))


def kt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of all decisions under the estimator, and its next probability of a one."""
    a, b = bit_counts(counts)
    log_block = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)
    return log_block, (b + 0.5) / (a + b + 1.0)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a node, and the share of its own estimate."""
    total = np.logaddexp(own, children) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def byte_log10(ones: np.ndarray) -> np.ndarray:
    """log10 probability of every byte from the probabilities of a one at its decisions."""
    out = np.zeros((len(ones), 256))
    for level in range(8):
        p = ones[:, (1 << level) - 1:(2 << level) - 1]
        both = np.log10(np.stack([1 - p, p], axis=2)).reshape(len(ones), -1)
        out += np.repeat(both, 256 >> (level + 1), axis=1)
    return out


# --- texts as codes ------------------------------------------------------------------------------

def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def text_codes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three bytes before, the byte) of all bytes and ends of some texts; where each text begins."""
    edge = bytes([EDGE]) * DEPTH
    data = np.frombuffer(edge + edge.join(raws) + edge, np.uint8).astype(np.uint32)
    codes = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    sizes = np.array([len(r) for r in raws]) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    keep = np.ones(len(codes), bool)
    last = begin + sizes
    keep[last[last < len(codes)]] = False
    keep[last[last + 1 < len(codes)] + 1] = False
    return codes[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


# --- counting ------------------------------------------------------------------------------------

def _word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def corpus_counts(training: DataFrame, text: str) -> DataFrame:
    """(kind, key, n): word hashes, byte 4-grams and documents of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams, times, docs = np.empty(0, np.uint32), np.empty(0, np.int64), 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.astype(np.int64)), pa.array(n)],
                names=["kind", "key", "n"])

        def word_rows() -> pa.RecordBatch:
            n = np.fromiter(words.values(), np.int64, len(words))
            out = rows(_WORD, np.fromiter(map(_word_hash, words), np.int64, len(words)), n)
            words.clear()
            return out

        for batch in batches:
            texts = batch.column(0).to_pylist()
            docs += len(texts)
            for i in range(0, len(texts), 1000):
                raws = [_raw(t) for t in texts[i:i + 1000]]
                for r in raws:
                    words.update(r.split())
                new, n = np.unique(text_codes(raws)[0], return_counts=True)
                both, where = np.unique(np.concatenate([grams, new]), return_inverse=True)
                times = np.bincount(where, np.concatenate([times, n]), len(both)).astype(np.int64)
                grams = both
                if len(words) > 500_000:
                    yield word_rows()
                if len(grams) > 4_000_000:
                    yield rows(_GRAM, grams, times)
                    grams, times = grams[:0], times[:0]
        if docs:
            yield word_rows()
            yield rows(_GRAM, grams, times)
            yield rows(_DOC, np.zeros(1), np.array([docs]))

    return (training.select(text).mapInArrow(count, "kind byte, key long, n long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n")))


# --- the tree ------------------------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, the other columns) of every run of equal first columns, across batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = table.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(key[a]), table.slice(a, b - a).columns[1:]
        held = table.slice(cuts[-1])
    if held is not None:
        yield int(held.column(0)[0].as_py()), held.columns[1:]


def _subtree(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The third bytes of a group's contexts and their rows of next-byte counts."""
    third, row = np.unique(codes >> 24, return_inverse=True)
    counts = np.zeros((len(third), 256))
    counts[row, codes & 0xFF] = n
    return third, counts


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])


def _level_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per two nearest bytes: next-byte counts and log weighted probabilities of the node."""
    for key, (codes, n) in _groups(batches):
        _, counts = _subtree(codes.to_numpy(), n.to_numpy())
        total = counts.sum(axis=0)
        weighted, _ = weigh(kt(total[None])[0][0], kt(counts)[0].sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key & 0xFF], pa.int32()), pa.array([total.tobytes()]), pa.array([weighted.tobytes()])],
            names=["near", "counts", "weighted"])


def _level_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for near, (counts, weighted) in _groups(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([near], pa.int32()), pa.array([_vectors(counts).sum(axis=0).tobytes()]),
             pa.array([_vectors(weighted).sum(axis=0).tobytes()])], names=["near", "counts", "children"])


def train(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(level, context, row): 256 float32 log10 probabilities per context, shallower ones for unseen deeper ones."""
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = scratch.table(counts.filter(F.col("kind") == _GRAM).select(
        F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int").alias("pair"), F.col("key").alias("code"), "n"), "grams")
    grouped = grams.repartition(n, "pair").sortWithinPartitions("pair", "code")
    two = scratch.table(grouped.mapInArrow(_level_two, "near int, counts binary, weighted binary"), "two")
    one = (two.repartition(n, "near").sortWithinPartitions("near")
           .mapInArrow(_level_one, "near int, counts binary, children binary").collect())  # at most 256 rows

    share, ones = np.full((256, _NODES), 0.5), np.full((256, _NODES), 0.5)
    total, children = np.zeros(256), np.zeros(_NODES)
    for r in one:
        row = np.frombuffer(r["counts"], "<f8")
        own, ones[r["near"]] = (x[0] for x in kt(row[None]))
        weighted, share[r["near"]] = weigh(own, np.frombuffer(r["children"], "<f8"))
        total, children = total + row, children + weighted
    own, top = (x[0] for x in kt(total[None]))
    top_share = weigh(own, children)[1]

    def above(near: int, deeper: np.ndarray) -> np.ndarray:
        """Mix what the deeper levels predict with the levels of one byte and of none."""
        deeper = share[near] * ones[near] + (1 - share[near]) * deeper
        return top_share * top + (1 - top_share) * deeper

    def rows_of(level: int, contexts: list[int], probabilities: np.ndarray) -> pa.RecordBatch:
        rows = byte_log10(probabilities).astype("<f4")
        return pa.RecordBatch.from_arrays(
            [pa.array([level] * len(contexts), pa.int32()), pa.array(contexts, pa.int32()),
             pa.array([r.tobytes() for r in rows])], names=["level", "context", "row"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, (codes, n) in _groups(batches):
            third, c = _subtree(codes.to_numpy(), n.to_numpy())
            logs, deepest = kt(c)
            own, mine = kt(c.sum(axis=0)[None])
            part = weigh(own[0], logs.sum(axis=0))[1]
            mix = lambda deeper: above(pair & 0xFF, part * mine + (1 - part) * deeper)
            yield rows_of(3, [(int(x) << 16) | pair for x in third], mix(deepest))
            yield rows_of(2, [pair], mix(np.full((1, _NODES), 0.5)))

    schema = "level int, context int, row binary"
    shallow = [(1, r["near"], bytearray(byte_log10(above(r["near"], np.full((1, _NODES), 0.5)))[0].astype("<f4").tobytes()))
               for r in one]
    root = (top_share * top + (1 - top_share) * 0.5)[None]
    shallow.append((0, 0, bytearray(byte_log10(root)[0].astype("<f4").tobytes())))
    return scratch.table(grouped.mapInArrow(finish, schema).union(spark.createDataFrame(shallow, schema)), "model")


class Scorer:
    """Rows by context: the longest seen one of three, two, one or no bytes."""

    def __init__(self, level: np.ndarray, context: np.ndarray, rows: np.ndarray):
        self.rows = rows.ravel()
        by = lambda k: (context[level == k], np.flatnonzero(level == k))
        root = by(0)[1][0]
        one = np.full(256, root, np.int32)
        one[by(1)[0]] = by(1)[1]
        two = np.tile(one, 256)
        two[by(2)[0]] = by(2)[1]
        self.two = two
        self.three = np.zeros(1 << 24, np.int32)  # 0: unseen, else row + 1
        self.three[by(3)[0]] = by(3)[1] + 1

    def bytes_log10(self, codes: np.ndarray) -> np.ndarray:
        at = self.three[codes >> 8] - 1
        unseen = np.flatnonzero(at < 0)
        at[unseen] = self.two[(codes[unseen] >> 8) & 0xFFFF]
        return self.rows[at.astype(np.int64) * 256 + (codes & 0xFF)]


_SCORERS: dict[str, Scorer] = {}


# --- scoring -------------------------------------------------------------------------------------

_ROWS = T.StructType([T.StructField("uid", T.LongType()), T.StructField("h", T.LongType()),
                      T.StructField("n", T.LongType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                      T.StructField("part", T.DoubleType()), T.StructField("known", T.LongType()),
                      T.StructField("score", T.DoubleType())])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"),
                       (F.crc32(name) % _FOLDS == _HELD).alias("held_out"))
    counts = scratch.table(corpus_counts(rows.filter(~F.col("held_out")), "text"), "counts")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()}
    ends = totals[_DOC]["n"] if totals else 0
    tokens = ends + (totals[_WORD]["n"] if _WORD in totals else 0)
    kinds = (totals[_WORD]["c"] if _WORD in totals else 0) + (1 if ends else 0)
    words = counts.filter(F.col("kind") == _WORD)
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow().sort_by("key")
    top_key, top_n = (top.column(i).to_numpy() for i in range(2))
    top_log = np.log10(top_n + 1.0)

    model = train(counts, scratch)
    sent = None
    if model.count() <= broadcast_rows:
        table = model.toArrow()
        sent = spark.sparkContext.broadcast(
            (table.column(0).to_numpy(), table.column(1).to_numpy(),
             np.stack([np.frombuffer(r, "<f4") for r in table.column(2).to_pylist()])))
    model_name = scratch.root
    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField(f.name, kind if f.name == "doc_id" else f.dataType) for f in _ROWS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if sent is not None:
            if model_name not in _SCORERS:
                _SCORERS.clear()
                _SCORERS[model_name] = Scorer(*sent.value)
            scorer = _SCORERS[model_name]
        uid, known_hash = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                raws = [_raw(t) for t in some.column(1).to_pylist()]
                d = len(raws)
                score = np.zeros(d)
                if scorer is not None:
                    codes, begin = text_codes(raws)
                    score = np.add.reduceat(scorer.bytes_log10(codes).astype(np.float64), begin)
                hashes, n, size, length = [], [], [], []
                if len(known_hash) > 500_000:
                    known_hash.clear()
                for raw in raws:
                    split = raw.split()
                    c = Counter(split)
                    for w in [w for w in c if w not in known_hash]:
                        known_hash[w] = _word_hash(w)
                    hashes += map(known_hash.__getitem__, c)
                    n += c.values()
                    size.append(len(c))
                    length.append(len(split) + 1)
                h, n = np.array(hashes, np.int64), np.array(n, np.int64)
                owner = np.repeat(np.arange(d), size)
                spot = np.searchsorted(top_key, h)
                inside = np.minimum(spot, max(len(top_key) - 1, 0))
                frequent = (top_key[inside] == h) if len(top_key) else np.zeros(len(h), bool)
                part = np.bincount(owner[frequent], n[frequent] * top_log[inside[frequent]], d) + np.log10(ends + 1.0)
                known = np.bincount(owner[frequent], n[frequent], d).astype(np.int64) + (1 if ends else 0)
                ids = uid + np.arange(d)
                uid += d
                rest = ~frequent
                m = int(rest.sum())
                none = lambda k: pa.nulls(m, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[rest]]), pa.array(h[rest]), pa.array(n[rest]), none(some.column(0).type),
                     none(pa.bool_()), none(pa.int64()), none(pa.float64()), none(pa.int64()), none(pa.float64())],
                    names=schema.names)
                # the document's own row; a key of its own keeps it out of every word's group
                own = np.array([_word_hash(b"\xff" + int(i).to_bytes(8, "little")) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(own), pa.array(np.zeros(d, np.int64)), some.column(0), some.column(2),
                     pa.array(length, pa.int64()), pa.array(part), pa.array(known), pa.array(score)],
                    names=schema.names)

    items = rows.mapInArrow(read, schema)
    priced = items.join(words.select(F.col("key").alias("h"), F.col("n").alias("c")).hint("shuffle_hash"), "h", "left")
    summed = priced.groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("rare"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "part", "known", "score")])
    if sent is None:
        summed = summed.drop("score").join(_scores_by_join(rows, model), "uid")
    price = F.log10(F.lit(float(tokens + kinds + 1)))
    return summed.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare", F.lit(0.0)) - F.col("n_tokens") * price).alias("base_score"), "score")


def _scores_by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, score) without sending the model: each document's contexts meet the model's rows in a join."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes, n = np.unique(text_codes([_raw(text)])[0], return_counts=True)
                starts = np.flatnonzero(np.concatenate([[True], (codes[1:] >> 8) != (codes[:-1] >> 8)]))
                ends = np.concatenate([starts[1:], [len(codes)]])
                offsets = pa.array(np.concatenate([starts, [len(codes)]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), uid)), pa.array((codes[starts] >> 8).astype(np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array((codes & 0xFF).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))],
                    names=["uid", "context", "next", "times"])
                uid += 1

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, row, nxt, times = (c.to_pylist() for c in batch.columns)
            score = [float(np.frombuffer(r, "<f4")[x].astype(np.float64) @ np.array(n)) for r, x, n in zip(row, nxt, times)]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(score)], names=["uid", "score"])

    got = rows.select("text").mapInArrow(contexts, "uid long, context int, next array<int>, times array<long>")
    level = lambda k: model.filter(F.col("level") == k).select(F.col("context").alias(f"c{k}"), F.col("row").alias(f"r{k}"))
    # levels 0 to 2 have at most 65,793 rows of 1 KB
    joined = (got.join(level(3), F.col("context") == F.col("c3"), "left")
              .join(F.broadcast(level(2)), F.col("context").bitwiseAND(0xFFFF) == F.col("c2"), "left")
              .join(F.broadcast(level(1)), F.col("context").bitwiseAND(0xFF) == F.col("c1"), "left"))
    root = F.unhex(F.lit(bytes(level(0).first()["r0"]).hex()))
    return (joined.select("uid", F.coalesce("r3", "r2", "r1", root).alias("row"), "next", "times")
            .mapInArrow(priced, "uid long, score double").groupBy("uid").agg(F.sum("score").alias("score")))
