"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are maximal runs of letters and digits, lower-cased; a shingle is
``SHINGLE_WORDS`` of them (an item with fewer words is one shingle of all its
words).  A document is contaminated by an item when it holds at least
``threshold`` of the item's distinct shingles.

Containment of a short item in a long document has a tiny Jaccard similarity,
so equal-size sketches of both sides would miss it.  Here only the items are
sketched, and losslessly: of n shingles, k of which must be found, any
n - k + 1 include one that is found.  The sketch is the n - k + 1 smallest
shingle hashes (bottom-k MinHash).  Items are partitioned by size; each
partition has its own sketch length, its least document size and the largest
hash in its sketches, and a document's shingles are probed only up to the
largest hash of the partitions whose items it is long enough to contain.
Documents that hit a sketch are shingled again as text and counted exactly.

The main path is DataFrame expressions only.

Defined results
  - an item or document without words matches nothing;
  - a pair (document, item) is returned once, also where rows repeat id and text;
  - null ids are kept; other columns of ``docs`` pass through ``remove_contaminated``;
  - an empty table on either side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 2_000_000  # sketch or shingle rows (about 100 bytes each) sent to every executor; more are joined by shuffle
_NOT_WORD = "[^\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda x: x != "")


def _at(k: int) -> list[Column]:
    return [F.get("_w", F.col("_i") + j) for j in range(k)]


def _shingled(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """One row per ``k``-word shingle position of the word arrays ``_w``, with their number ``_n``."""
    n = F.size("_w")
    return rows.filter(n >= k).select(
        *keep, "_w", (n - k + 1).alias("_n"), F.explode(F.sequence(F.lit(0), n - k)).alias("_i"))


def item_shingles(items: DataFrame, id_col: str = "item_id", text: str = "text",
                  shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, key, k, n, need, shingle, h) of every distinct shingle of every item; key: a hash of the words."""
    worded = items.select(F.col(id_col).alias("item_id"), _words(F.col(text)).alias("_w")).withColumn(
        "key", F.xxhash64("_w"))
    parts = []
    for k in range(1, shingle_words + 1):
        sized = worded if k == shingle_words else worded.filter(F.size("_w") == k)
        parts.append(_shingled(sized, k, "item_id", "key").select(
            "item_id", "key", F.lit(k).alias("k"), F.concat_ws(" ", *_at(k)).alias("shingle"),
            F.xxhash64(*_at(k)).alias("h")))
    distinct = parts[0]
    for p in parts[1:]:
        distinct = distinct.union(p)
    distinct = distinct.distinct()
    sizes = distinct.groupBy("item_id", "key").agg(F.count("*").alias("n")).select(
        F.col("item_id").alias("_id"), F.col("key").alias("_key"), "n",
        F.ceil(F.col("n") * threshold - 1e-9).alias("need"))
    return (distinct.join(sizes, (F.col("key") == F.col("_key")) & F.col("item_id").eqNullSafe(F.col("_id")))
            .select("item_id", "key", "k", "n", "need", "shingle", "h"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h1, h2, item_id, n_shared, n_shingles, containment) of every contaminated pair.

    h1, h2: the two hashes of the document's text, to tell documents of one id apart.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    shingles = scratch.table(item_shingles(items, item_id, item_text, shingle_words, threshold), "items")
    rows = shingles.count()
    rank = F.row_number().over(Window.partitionBy("item_id", "key").orderBy("h", "shingle"))
    sketch = scratch.table(
        shingles.withColumn("_r", rank).filter(F.col("_r") <= F.col("n") - F.col("need") + 1)
        .select("k", "need", "h", F.floor(F.log2("n")).alias("size_class")), "sketch")
    # per size partition (at most 64 a shingle length): least shingles of a document, largest sketch hash
    partitions = sketch.groupBy("k", "size_class").agg(F.min("need").alias("need"), F.max("h").alias("top")).collect()

    hashed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("h1"),
                         F.xxhash64(F.col(text), F.lit(1)).alias("h2"))
    hits = None
    for k in sorted({p["k"] for p in partitions}):
        own = [p for p in partitions if p["k"] == k]
        top = F.greatest(*[F.when(F.col("_n") >= p["need"], F.lit(p["top"])).otherwise(F.lit(-(1 << 63)))
                           for p in own], F.lit(-(1 << 63)))
        probes = (_shingled(hashed.select("h1", "h2", _words(F.col("_text")).alias("_w")), k, "h1", "h2")
                  .select("h1", "h2", "_n", F.xxhash64(*_at(k)).alias("h")).filter(F.col("h") <= top))
        found = probes.join(_small(sketch.filter(F.col("k") == k).select("h", "need").distinct(), rows), "h").filter(
            F.col("_n") >= F.col("need")).select("h1", "h2").distinct()
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = hashed.select("h1", "h2").limit(0)
    hits = scratch.table(hits.distinct(), "hits")

    again = hashed.join(hits, ["h1", "h2"], "left_semi").select(
        "doc_id", "h1", "h2", _words(F.col("_text")).alias("_w"))
    counted = None
    for k in sorted({p["k"] for p in partitions}) or [shingle_words]:
        of_k = _small(shingles.filter(F.col("k") == k).select("item_id", "key", "n", "need", "shingle"), rows)
        shared = (_shingled(again, k, "doc_id", "h1", "h2")
                  .select("doc_id", "h1", "h2", F.concat_ws(" ", *_at(k)).alias("shingle"))
                  .join(of_k, "shingle").distinct()
                  .groupBy("doc_id", "h1", "h2", "item_id", "key", "n", "need").agg(F.count("*").alias("n_shared")))
        counted = shared if counted is None else counted.union(shared)
    return counted.filter("n_shared >= need").select(
        "doc_id", "h1", "h2", "item_id", "n_shared", F.col("n").alias("n_shingles"),
        (F.col("n_shared") / F.col("n")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                        **options) -> DataFrame:
    """The documents that no item contaminates, all columns unchanged."""
    h1, h2 = free_name(docs, "_h1"), free_name(docs, "_h2")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    pairs = contained_items(docs, items, id_col, text, **options)
    found = scratch.table(pairs.select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct(), "contaminated")
    marked = docs.withColumn(h1, F.xxhash64(text)).withColumn(h2, F.xxhash64(F.col(text), F.lit(1)))
    return marked.join(found, [h1, h2], "left_anti").drop(h1, h2)
