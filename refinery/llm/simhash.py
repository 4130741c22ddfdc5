"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints, verified by Hamming distance.

Two fingerprints within ``d`` bits, cut into ``b > d`` blocks, agree on at
least ``b - d`` whole blocks.  So each distinct fingerprint is keyed by every
choice of ``b - d`` blocks, and only fingerprints with an equal key are
compared.  ``b`` grows with the number of distinct fingerprints so that keys
stay selective; every choice of ``b`` finds the same links.

Equal fingerprints are one node, whatever the number of their documents.  A
key shared by many fingerprints (a large group of near copies) is dealt out as
pairs of bounded chunks, each pair in its own group, and each group returns a
spanning forest of its links instead of all of them.  Components therefore
lose no link and no task holds more than two chunks.

Defined results
  - lower-casing touches A-Z only; words are runs without ASCII blanks;
    fewer words than a shingle: the whole sequence is the one shingle; no
    words (null, empty, blank): fingerprint 0, linked like any other;
  - ``component_id`` is the smallest non-null id of the component, null if
    there is none; repeated rows are all returned;
  - ``keep_one`` leaves one row per component: that of ``component_id`` (or
    one of the rows without an id); other columns are passed through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name
from .components import connected_components

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
CHUNK = 2048  # fingerprints per chunk of a large key; a group compares two chunks


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    spans = zip(starts, ends[shingle_words - 1:])
    count, n = np.zeros(BITS, np.int64), len(words) - shingle_words + 1
    while chunk := b"".join([digest(joined[s:e], SEED) for s, e in itertools.islice(spans, 1 << 16)]):
        bits = np.unpackbits(np.frombuffer(chunk, np.uint8)).reshape(-1, BITS)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def blocks_for(distinct: int, max_distance: int = MAX_DISTANCE) -> int:
    """Fewest blocks for which a key is expected to hold at most 64 unrelated fingerprints."""
    for b in range(max_distance + 2, BITS // 4):
        if sum(sorted(_block_sizes(b))[:b - max_distance]) >= math.log2(max(distinct, 1)) - 6:
            return b
    return BITS // 4


def _block_sizes(blocks: int) -> list[int]:
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def block_masks(blocks: int, max_distance: int = MAX_DISTANCE) -> list[int]:
    """One bit mask for every choice of ``blocks - max_distance`` blocks, as signed longs."""
    masks, at = [], 0
    for size in _block_sizes(blocks):
        masks.append(((1 << size) - 1) << at)
        at += size
    chosen = (sum(c) for c in itertools.combinations(masks, blocks - max_distance))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _forest(fps: np.ndarray, max_distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among some fingerprints, as (node, its new neighbours)."""
    rest = fps
    while rest.size > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= max_distance
            if near.any():
                yield node, rest[near]
                frontier.extend(rest[near])
                rest = rest[~near]


def _links_of_groups(max_distance: int):
    """Arrow function over rows sorted by group; the last group of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
                fp = batch.column(3).to_numpy().view(np.uint64)
                key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            else:
                key, fp = held_key, held_fp
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            if batch is not None:
                held_key, held_fp = key[starts[-1]:], fp[starts[-1]:]
                ends, starts = starts[1:], starts[:-1]
            else:
                ends = np.concatenate([starts[1:], [len(fp)]])
            left, right = [], []
            pairs = starts[ends - starts == 2]  # most groups: two fingerprints, compared all at once
            near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_distance
            left.append(fp[pairs[near]])
            right.append(fp[pairs[near] + 1])
            for s, e in zip(starts, ends):
                if e - s > 2:
                    for node, found in _forest(fp[s:e], max_distance):
                        left.append(np.full(found.size, node))
                        right.append(found)
            a, b = (np.concatenate(x).view(np.int64) for x in (left, right))
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, distinct: int, max_distance: int = MAX_DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps(fp)`` that span every component of the link graph."""
    masks = block_masks(blocks_for(distinct, max_distance), max_distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("c", "m")).select(
        "fp", "c", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
    shared = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), chunks).cast("int")
    # chunk i meets every chunk j: the pair (min, max) is a group of its own
    dealt = (keyed.join(shared, ["c", "v"]).withColumn("own", own)
             .select("c", "v", "fp", "own", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
             .select(F.xxhash64("c", "v").alias("g"), F.col("v"),
                     (F.least("own", "other").cast("long") * F.lit(1 << 31)
                      + F.greatest("own", "other").cast("long") * F.lit(64) + F.col("c") % 64).alias("part"), "fp"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(n, "g", "v", "part").sortWithinPartitions("g", "v", "part")
    return grouped.mapInArrow(_links_of_groups(max_distance), "a long, b long")


def classes(fps: DataFrame, scratch: Scratch, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``fps(doc_id, fp)``."""
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    edges = links(nodes.select("fp"), nodes.count(), max_distance)
    labels = connected_components(edges, scratch).withColumnRenamed("node", "fp")
    linked = nodes.join(labels, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = linked.select("fp", "root").join(smallest, "root")
    return nodes.join(found, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint as 16 hex digits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(docs.select(F.col(id_col).alias("doc_id"),
                                    fingerprint_column(F.col(text), shingle_words).alias("fp")), "fingerprints")
    # written first: a join of two plain exchanges, so that a very common fingerprint can be split
    by_fp = scratch.table(classes(fps, scratch, max_distance), "classes")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of every component, all columns unchanged.

    Fingerprints are computed again next to the texts, so that texts move once:
    to the join with the rows to keep, whose partitioning also serves the last
    step (one row where an id and text are repeated).
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(docs.select(F.col(id_col).alias("doc_id"),
                                    fingerprint_column(F.col(text), shingle_words).alias("fp")), "fingerprints")
    by_fp = scratch.table(classes(fps, scratch, max_distance), "classes")
    stay = (fps.join(by_fp, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("s")).select("s.*"))
    key, fp = free_name(docs, "_id_key"), free_name(docs, "_fp")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    stay = stay.select(name(F.col("doc_id")).alias(key), F.col("fp").alias(fp))
    marked = docs.withColumn(key, name(F.col(id_col))).withColumn(fp, fingerprint_column(F.col(text), shingle_words))
    return marked.join(stay, [key, fp], "left_semi").dropDuplicates([key, fp]).drop(key, fp)
