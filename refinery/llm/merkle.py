"""Merkle manifest of a dataset: leaf digests, group subroots, one root and a proof per row.

Every row is a leaf; the leaves of a group ascend by the order column.  Runs of
``fanout`` nodes become their digest until one node, the subroot, is left; the
subroots, ordered by group, make the root in the same way.

The tree is a rollup of nested structs.  A leaf's rank in its group is cut into
digits of base ``fanout``; ``levels`` digits make a block.  One exchange brings
a block together; its digit columns are then grouped away one after another, and
each grouping nests the structs of the children in the struct of their parent.
Blocks hold at most ``fanout ** levels`` leaves; their digests are the leaves of
the next round, until every group is one block.  Proofs come from a transform
and an explode per level of the nested structs.  Inside blocks nothing is joined; one row
per block meets the path above it.

Digests are lowercase hex SHA-256 of their inputs' concatenation, digests as hex text.

Defined results
  - null group: a group of its own, before all others; null order values come
    before all others, and rows equal in both ascend by leaf digest;
  - rows repeated in full are leaves of their own, side by side;
  - one leaf in a group: the leaf is the subroot; one group: the subroot is the root;
  - an empty table gives an empty manifest, without a root;
  - other columns of the table play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_rank

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
LEVELS = 10

_STEPS = "array<struct<before:string,after:string>>"


def _quoted(name: str) -> Column:
    return F.col("`{}`".format(name.replace("`", "``")))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest leads to along a proof."""
    return F.aggregate(proof, leaf, lambda at, s: digest(F.concat(s["before"], at, s["after"])))


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings along a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _width(n: Column, fanout: int, level: int) -> Column:
    """Nodes that a tree of n leaves has at a level."""
    return F.ceil(n / F.lit(fanout ** level)).cast("long") if level else n


def _roll(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, n, rank, h, payload) nodes to one row (tree, n, block, node) per block, children nested."""
    digits = [(F.floor(F.col("rank") / F.lit(fanout ** k)) % fanout).cast("int").alias(f"d{k}") for k in range(levels)]
    at = nodes.select("tree", "n", F.floor(F.col("rank") / F.lit(fanout ** levels)).alias("block"), *digits,
                      F.struct("h", "payload").alias("node")).repartition("tree", "block")
    for k in range(levels):
        keys = ["tree", "n", "block", *(f"d{j}" for j in range(k + 1, levels))]
        at = at.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["node"]["h"]), "")
        h = F.when(_width(F.col("n"), fanout, k) <= 1, F.get("kids", F.lit(0))["node"]["h"]).otherwise(digest(joined))
        at = at.select(*keys, F.struct(h.alias("h"), F.transform("kids", lambda x: x["node"]).alias("kids")).alias("node"))
    return at


def _unnest(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, n, up, subroot, root, node) blocks to their leaves; every level puts its siblings before ``up``.

    A transform over the children makes each one's step, and an explode hands child and step on.
    """
    rest = ["tree", "n", "subroot", "root"]
    for level in range(levels, 0, -1):
        kids = F.col("node.kids")
        hashes = F.transform(kids, lambda x: x["h"])

        def step(kid: Column, i: Column) -> Column:
            own = F.struct(F.array_join(F.slice(F.col("hashes"), F.lit(1), i), "").alias("before"),
                           F.array_join(F.slice(F.col("hashes"), i + 2, F.lit(fanout)), "").alias("after"))
            return F.struct(kid.alias("kid"), own.alias("own"))

        blocks = (blocks.select(*rest, "up", kids.alias("kids"), hashes.alias("hashes"))
                  .select(*rest, "up", F.explode(F.transform("kids", step)).alias("at"))
                  .select(*rest, F.when(_width(F.col("n"), fanout, level - 1) > 1, F.concat(F.array("at.own"), "up"))
                          .otherwise(F.col("up")).alias("up"), F.col("at.kid").alias("node")))
    return blocks.select("tree", F.col("node.payload").alias("payload"), F.col("node.h").alias("h"),
                         F.col("up").alias("proof"), "subroot", "root")


def _build(nodes: DataFrame, scratch: Scratch, fanout: int, levels: int) -> list[DataFrame]:
    """The written blocks of every round, from the leaves up; in the last one each tree is one block."""
    rounds = []
    while True:
        blocks = scratch.table(_roll(nodes, fanout, levels), "blocks")
        rounds.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return rounds
        nodes = blocks.select("tree", _width(F.col("n"), fanout, levels).alias("n"), F.col("block").alias("rank"),
                              F.col("node.h").alias("h"), F.col("block").alias("payload"))


def _emit(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, payload, h, proof, subroot, root) of all leaves; above: (tree, block, up, subroot, root) of the top blocks."""
    for blocks in reversed(rounds):
        leaves = _unnest(blocks.join(above, ["tree", "block"]), fanout, levels)
        above = leaves.select("tree", F.col("payload").alias("block"), F.col("proof").alias("up"), "subroot", "root")
    return leaves


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "lang",
             fanout: int = FANOUT, levels: int = LEVELS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of the table: id, group, leaf, subroot, root, proof, and the ``carry`` columns.

    ``proof`` lists, from the leaf's level up to the root, the siblings' digests before and after.
    ``carry`` names short extra columns, computed from the table, that ride along.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    carry = carry or {}

    def depth(nodes: DataFrame) -> int:
        """Digits that the largest tree needs, ``levels`` at most: shallow trees get shallow structs."""
        n, need = nodes.agg(F.max("n")).first()[0] or 1, 1
        while fanout ** need < n and need < levels:
            need += 1
        return need

    slim = docs.select(_quoted(order).alias("key"), _quoted(group).alias("grp"),
                       leaf_digest([_quoted(f) for f in fields]).alias("h"),
                       F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in carry.items())).alias("extra"))
    # the texts are read once; the place breaks ties among rows equal in all else, so that none fills one range
    slim = scratch.table(slim.withColumn("place", F.monotonically_increasing_id()), "leaves")
    by = [F.col(c).asc_nulls_first() for c in ("grp", "key", "h", "place")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("place")
    ordered = scratch.table(ordered.withColumn("pos", F.monotonically_increasing_id()), "ordered")
    scratch.drop(slim)
    # the first position of a group names its tree and orders the trees
    leaves = dense_rank(ordered, ["grp"]).select(
        F.col("first").alias("tree"), "n", "rank", "h", F.struct("key", "grp", "extra").alias("payload"))
    deep = depth(leaves)
    rounds = _build(leaves, scratch, fanout, deep)
    scratch.drop(ordered)

    tops = rounds[-1].select("tree", F.col("node.h").alias("subroot"))
    tops = tops.repartitionByRange(parts, "tree").sortWithinPartitions("tree")
    tops = scratch.table(tops.withColumn("pos", F.monotonically_increasing_id()), "subroots")
    groups = dense_rank(tops).select(F.lit(0).cast("long").alias("tree"), "n", "rank", F.col("subroot").alias("h"),
                                     F.col("tree").alias("payload"))
    high = depth(groups)
    upper = _build(groups, scratch, fanout, high)
    top = upper[-1].select("tree", "block", F.array().cast(_STEPS).alias("up"), F.col("node.h").alias("subroot"),
                           F.col("node.h").alias("root"))
    paths = scratch.table(_emit(upper, top, fanout, high).select(
        F.col("payload").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("proof").alias("up"),
        F.col("h").alias("subroot"), "root"), "paths")
    out = _emit(rounds, paths, fanout, deep)
    return out.select(F.col("payload.key").alias("doc_id"), F.col("payload.grp").alias("grp"), F.col("h").alias("leaf"),
                      "subroot", "root", "proof", *(F.col("payload.extra")[k].alias(k) for k in carry))
