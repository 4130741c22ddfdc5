"""Line dedup: repeated line runs found by prefix doubling, later copies deleted.

Every document is its sequence of line ids (lines without a word are skipped).
A run of lines is deleted where an equal run of at least ``min_words`` words
stands earlier, in the order of (doc_id, line).  The deleted lines are exactly
the union of all such runs, hence of all maximal ones:

  - any qualifying run is covered by the shortest qualifying blocks that start
    at its lines and the one that ends with its last line, so only these blocks
    are compared, at most two per line;
  - the rank of the 2^(k+1) lines from a position is named from the ranks of the
    2^k lines there and 2^k further on.  A class of equal ranks is the interval
    of the suffix array whose common prefix is at least that long; its first
    position names it.  (Only the intervals are needed, so no total order is
    sorted; a line that a third of the corpus repeats would be one range of it.)
  - a block of m lines, 2^k <= m < 2^(k+1), is the pair of ranks of its first and
    its last 2^k lines;
  - positions whose class has one member leave after each round, and rounds end
    with the longest block, which holds at most ``min_words`` lines.

Texts are read twice and moved once, to the join with the lines to delete.

Defined results
  - null or empty text: no lines, nothing deleted;
  - rows that repeat both id and text are one document, treated alike;
  - rows with a null id come last in the order, then rows order by text hash;
  - a text is otherwise unchanged: the lines that stay are joined by ``\\n``;
  - other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, Scratch, free_name, let

MIN_WORDS = 50

_LINE = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("hi", T.LongType()),
                      T.StructField("lo", T.LongType()), T.StructField("ahead", T.IntegerType()),
                      T.StructField("back", T.IntegerType()), T.StructField("rest", T.IntegerType())])


def line_table(text: str | None, min_words: int) -> tuple[np.ndarray, ...]:
    """Of each line with a word: its number, 128-bit id, the lines of the shortest qualifying block that
    starts and that ends there (0: none), and how many such lines follow."""
    numbers, words, ids = [], [], []
    for no, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        n = len(line.split())
        if n:
            numbers.append(no)
            words.append(n)
            ids.append(xxhash.xxh3_128_digest(line))
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    k = len(numbers)
    at = np.arange(k)
    end = np.searchsorted(total, total[:-1] + min_words)  # first end whose block is long enough
    ahead = np.where(end <= k, end - at, 0)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    back = np.where(total[1:] >= min_words, at - start + 1, 0)
    halves = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
    return (np.array(numbers, np.int32), halves[:, 0], halves[:, 1], ahead.astype(np.int32),
            back.astype(np.int32), (k - 1 - at).astype(np.int32))


def _line_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [line_table(t.as_py(), min_words) for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(t[0]) for t in tables])]).astype(np.int32)
            columns = [pa.array(np.concatenate([t[i] for t in tables])) for i in range(6)]
            lines = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=_LINE.names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h1"), batch.column("h2"), lines],
                names=["doc_id", "h1", "h2", "lines"])

    return run


def _hashed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(_named(id_col).alias("doc_id"), F.xxhash64(_named(text)).alias("h1"),
                       F.xxhash64(_named(text), F.lit(1)).alias("h2"), _named(text).alias("text"))


def _positions(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """One row per worded line with its position, a long that rises in (doc_id, text hash, line) order."""
    hashed = _hashed(docs, id_col, text)
    schema = T.StructType([*hashed.schema.fields[:3], T.StructField("lines", T.ArrayType(_LINE))])
    documents = hashed.mapInArrow(_line_rows(min_words), schema).filter(F.size("lines") > 0).dropDuplicates(
        ["doc_id", "h1", "h2"])
    order = [F.col("doc_id").asc_nulls_last(), "h1", "h2"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (documents.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .select("doc_id", "h1", "h2", F.inline("lines"))
            .withColumn("pos", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame, keys: list[str], keep: list[str], scratch: Scratch) -> DataFrame:
    """Rows whose keys occur twice or more, with the first position of the class as ``rank``.

    The classes are written first: the join then meets two plain exchanges, and
    a class of very many rows (a line that a third of the corpus repeats) can be split.
    """
    named = scratch.table(rows.groupBy(*keys).agg(F.min("pos").alias("rank"), F.count("*").alias("n"))
                          .filter("n > 1").drop("n"), "classes")
    return rows.join(named, keys).select(*keep, "rank")


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h1, h2, line_nos) of the lines that are later copies; h1, h2: the two hashes of the text."""
    lines = scratch.table(_positions(docs, id_col, text, min_words), "lines")
    level = scratch.table(_ranked(lines.select("pos", "hi", "lo", "ahead", "back", "rest"), ["hi", "lo"],
                                  ["pos", "ahead", "back", "rest"], scratch), "ranks")
    blocks = scratch.table(
        level.filter("ahead > 0").select(F.col("pos").alias("start"), F.col("ahead").alias("m")).union(
            level.filter("back > 0").select(F.col("pos") - F.col("back") + 1, "back")).distinct(), "blocks")
    longest = blocks.agg(F.max("m")).first()[0] or 0
    found, size = [], 1
    while size <= longest:
        # blocks of size..2*size-1 lines: the ranks of their first and last `size` lines
        rank = level.select("pos", "rank")
        these = blocks.filter(F.col("m").between(size, 2 * size - 1))
        pairs = (these.join(rank.select(F.col("pos").alias("start"), F.col("rank").alias("r1")), "start")
                 .withColumn("tail", F.col("start") + F.col("m") - size)
                 .join(rank.select(F.col("pos").alias("tail"), F.col("rank").alias("r2")), "tail")
                 .select("m", "r1", "r2", F.col("start").alias("pos")))
        pairs = scratch.table(pairs, "pairs")
        copies = _ranked(pairs, ["m", "r1", "r2"], ["pos", "m"], scratch).filter("rank < pos")
        found.append(scratch.table(copies.select(
            F.explode(F.sequence("pos", F.col("pos") + F.col("m") - 1)).alias("pos")).distinct(), "copies"))
        if 2 * size <= longest:
            after = rank.select((F.col("pos") - size).alias("pos"), F.col("rank").alias("r2"))
            doubled = (level.filter(F.col("rest") >= 2 * size - 1).withColumnRenamed("rank", "r1")
                       .join(after, "pos"))
            doubled = scratch.table(doubled, "doubled")
            following = scratch.table(_ranked(doubled, ["r1", "r2"], ["pos", "ahead", "back", "rest"], scratch), "ranks")
            scratch.drop(level)
            level = following
        size *= 2
    deleted = lines.select("pos").limit(0) if not found else found[0]
    for more in found[1:]:
        deleted = deleted.union(more)
    return (lines.join(deleted.distinct(), "pos").groupBy("doc_id", "h1", "h2")
            .agg(F.sort_array(F.collect_list("no")).alias("line_nos")))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                          drop_emptied: bool = False, mark: str | None = None) -> DataFrame:
    """The documents without later copies of repeated runs, all columns in place.

    ``drop_emptied`` leaves out documents of which no line with a word is left.
    ``mark`` names an extra column that lists the deleted line numbers (from 0).
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    h1, h2, nos, key, no_id = (free_name(docs, x) for x in ("_h1", "_h2", "_nos", "_key", "_no_id"))
    ids, texts = _named(id_col), _named(text)
    found = repeated_lines(docs, scratch, id_col, text, min_words).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("doc_id").isNull().alias(no_id),
        F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("line_nos").alias(nos))
    found = scratch.table(found, "deleted")
    marked = (docs.withColumn(key, F.coalesce(ids.cast("string"), F.lit(""))).withColumn(no_id, ids.isNull())
              .withColumn(h1, F.xxhash64(texts)).withColumn(h2, F.xxhash64(texts, F.lit(1))))
    joined = marked.join(found.hint("shuffle_hash"), [key, no_id, h1, h2], "left")
    rest = let(F.split(texts, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(nos)), lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(text, F.when(F.col(nos).isNull(), texts).otherwise(rest))
    if drop_emptied:
        out = out.filter(F.col(nos).isNull() | (F.btrim(texts, F.lit(BLANKS + "\n")) != ""))
    if mark:
        out = out.withColumn(mark, F.coalesce(F.col(nos), F.array().cast("array<int>")))
    return out.select(*map(_named, docs.columns), *([_named(mark)] if mark else []))


def _named(column: str) -> Column:
    return F.col("`{}`".format(column.replace("`", "``")))
