import hashlib

import pytest
from pyspark.sql import functions as F

from refinery.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels, i, fanout):
    steps = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        run = level[first:first + fanout]
        steps.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
        i //= fanout
    return steps


def brute(rows, fanout):
    """(doc_id, lang, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text) rows."""
    out, subs = [], []
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, levels_of([leaf(r) for r in mine], fanout)))
        subs.append(trees[-1][1][-1][0])
    upper = levels_of(subs, fanout)
    for k, (mine, lv) in enumerate(trees):
        up = path(upper, k, fanout)
        out += [(r[0], r[2], leaf(r), subs[k], upper[-1][0], path(lv, i, fanout) + up) for i, r in enumerate(mine)]
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, rank int, tree string, `a.b` int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "n") for r in rows], SCHEMA)


ROWS = [(i, f"s{i % 3}", ["en", "fr", None, "é", ""][i % 5], i * 7, f"text {i} é") for i in range(57)]
ROWS += [(3, "s", "en", None, None), (3, "s", "en", None, None), (None, None, None, None, None), (None, "x", "en", 1, ""),
         (900, "s", "solo", 2, "w " * 50_000)]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1] or "", r[1] is None, r[2], str(r[5]))


@pytest.mark.parametrize("fanout,levels", [(2, 10), (2, 2), (3, 2), (4, 1)])
def test_manifest_matches_plain_tree(spark, fanout, levels):
    got = merkle.manifest(frame(spark, ROWS), fanout=fanout, levels=levels).collect()
    mine = [(r.doc_id, r.grp, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got]
    assert sorted(mine, key=key) == sorted(brute(ROWS, fanout), key=key)


def test_folds_reach_the_root_only_from_true_leaves(spark):
    docs = frame(spark, ROWS)
    fields = [F.col(f) for f in merkle.FIELDS]
    bad = merkle.leaf_digest([*fields[:3], F.col("n_chars") + 1, fields[4]])
    out = merkle.manifest(docs, carry={"bad": bad, "n": F.col("n_chars")})
    for r in out.select("*", merkle.fold(F.col("leaf"), F.col("proof")).alias("f"),
                        merkle.fold(F.col("bad"), F.col("proof")).alias("g")).collect():
        assert r.f == r.root and (r.g == r.root) == (r.n is None)


def test_one_row_and_no_rows(spark):
    one = merkle.manifest(frame(spark, ROWS[:1])).collect()
    assert [(r.leaf == r.subroot == r.root, r.proof) for r in one] == [(True, [])]
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_one_group_of_equal_rows(spark):
    rows = [(1, "s", "en", 3, "abc")] * 300
    got = merkle.manifest(frame(spark, rows), levels=3).collect()
    assert len(got) == 300 and {r.root for r in got} == {levels_of([leaf(rows[0])] * 300, 2)[-1][0]}
    assert sorted([tuple(s) for s in r.proof] for r in got) == sorted(b[5] for b in brute(rows, 2))
