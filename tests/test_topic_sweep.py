"""The joint topic sweep: equal to fits of one k, near other implementations, independent of blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery import session
from refinery.operators import blocked
from refinery.plans import topic_sweep as TS
from refinery.plans import topics as TP


def themed(shuffled=False, n=120, seed=1):
    """Documents of three themes of eight terms each; shuffled: the same terms dealt out at random."""
    rng = random.Random(seed)
    terms = [[f"t{t}w{i}" for i in range(8)] for t in range(3)]
    docs = [[rng.choice(terms[d % 3]) for _ in range(30)] for d in range(n)]
    if shuffled:
        flat = [w for d in docs for w in d]
        rng.shuffle(flat)
        docs = [flat[i * 30:(i + 1) * 30] for i in range(n)]
    return list(enumerate(docs))


def entries_of(spark, docs):
    df = spark.createDataFrame(docs, "id int, a array<string>")
    terms = TP.weighted_terms(df, "id", [("a", 1.0)])
    words = TS.dictionary(terms)
    return TS.postings(terms, words, "id"), words, terms


@pytest.fixture(scope="module")
def sweep(spark):
    entries, words, _ = entries_of(spark, themed())
    return TS.fit_sweep(entries, words, range(2, 7))


def test_special_functions():
    x = np.array([1e-3, .02, .5, 1, 1.5, 5.99, 6, 8, 30, 1e4])
    assert np.allclose(TS.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    h = 1e-5
    slope = [(math.lgamma(v + v * h) - math.lgamma(v - v * h)) / (2 * v * h) for v in x]
    assert np.allclose(TS.digamma(x), slope, rtol=1e-4, atol=1e-4)


def test_dictionary_and_postings(spark):
    entries, words, _ = entries_of(spark, [(1, ["b", "a", "b", None]), (2, ["c"]), (3, []), (4, None)])
    assert [(r["index"], r.term, r.weight) for r in words.orderBy("index").collect()] == [(0, "b", 2.0), (1, "a", 1.0), (2, "c", 1.0)]
    assert sorted(tuple(r) for r in entries.collect()) == [(1, 0, 2.0), (1, 1, 1.0), (2, 2, 1.0)]


def test_themes_are_found(sweep):
    assert sweep.best == 3
    by_topic = {}
    for r in sweep.assign().collect():
        by_topic.setdefault(r.dominant_topic, set()).add(r.id % 3)
        assert abs(sum(r.topics) - 1) < 1e-9 and r.topic_label == r.dominant_topic
    assert sorted(map(sorted, by_topic.values())) == [[0], [1], [2]]
    tops = {}
    for r in sweep.top_terms(n=8).collect():
        tops.setdefault(r.topic, set()).add(r.term[:2])
    assert sorted(map(sorted, tops.values())) == [["t0"], ["t1"], ["t2"]]
    sums = sweep.term_weights().groupBy("topic").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 3 and all(abs(r.w - 1) < 1e-9 for r in sums)
    assert all(r.topic_label == -1 for r in sweep.assign(min_share=1.1).collect())


def test_sweep_equals_single_fits_and_any_blocks(spark, sweep, monkeypatch):
    entries, words, _ = entries_of(spark, themed())
    for k in (3, 6):
        assert abs(TS.fit_sweep(entries, words, [k]).log_perplexity[k] - sweep.log_perplexity[k]) < 1e-6
    small = blocked.Blocked.of
    monkeypatch.setattr(blocked.Blocked, "of", classmethod(lambda cls, e: small(e, 40)))
    assert abs(TS.fit_sweep(entries, words, [3]).log_perplexity[3] - sweep.log_perplexity[3]) < 1e-6


def test_near_the_library_and_better_than_shuffled(spark, sweep):
    _, words, terms = entries_of(spark, themed())
    feats = TP.weighted_vectors(terms, "id", [1.0], [r.term for r in words.orderBy("index").collect()])
    model = LDA(k=3, maxIter=60, seed=1, optimizer="online", subsamplingRate=1.0, learningOffset=1.0,
                optimizeDocConcentration=False, featuresCol="features").fit(feats)
    assert abs(sweep.log_perplexity[3] - model.logPerplexity(feats)) < 0.02 * sweep.log_perplexity[3]
    entries, other, _ = entries_of(spark, themed(shuffled=True))
    assert sweep.log_perplexity[3] < TS.fit_sweep(entries, other, [3]).log_perplexity[3] - 0.2


def test_dense_and_sparse_updates_agree():
    rng = np.random.default_rng(3)
    row = np.repeat(np.arange(6), 4)
    column = np.concatenate([np.sort(rng.choice(12, 4, False)) for _ in range(6)])
    value, beta = rng.random(24) + .5, rng.random((3, 12))
    wide = np.hstack([beta, np.full((3, 400), .1)])
    dense, sparse = TS._document_topics(row, column, value, 6, beta), TS._document_topics(row, column, value, 6, wide)
    assert dense[3] is not None and sparse[3] is None
    assert np.allclose(dense[0], sparse[0]) and np.allclose(dense[2][row, column], sparse[2])


def test_no_terms(spark):
    entries, words, _ = entries_of(spark, [(1, []), (2, None)])
    with pytest.raises(ValueError):
        TS.fit_sweep(entries, words, [2])


def test_single_precision_updates_keep_the_bound(monkeypatch):
    rng = np.random.default_rng(5)
    n, width, per = 60, 40, 12
    row = np.repeat(np.arange(n), per)
    column = np.concatenate([rng.choice(width, per, replace=False) for _ in range(n)])
    value = rng.integers(1, 5, n * per).astype(float)
    for k in (2, 20, 64):
        beta = np.exp(TS.digamma(rng.gamma(.3, 9., (k, width)) + 1 / k) - 5)
        got, want = [], []
        for out, single in ((got, 64), (want, 0)):
            monkeypatch.setattr(TS, "SINGLE", single)
            gamma, theta, ratio, _ = TS._document_topics(row, column, value, n, beta, 400)
            assert gamma.dtype == theta.dtype == ratio.dtype == np.float64
            out.append(((1 / k - gamma) * np.log(theta) + TS.log_gamma(gamma)).sum() - TS.log_gamma(gamma.sum(1)).sum())
        assert np.allclose(got, want, rtol=1e-3)


def test_large_vocabularies_train_in_groups(spark, sweep, monkeypatch):
    """Vectors of a block are bounded whatever the vocabulary; results do not depend on the groups."""
    entries, words, _ = entries_of(spark, themed())
    monkeypatch.setattr(TS, "VECTOR_BYTES", 24 * 8 * 7)  # seven topics at a time
    found = TS.fit_sweep(entries, words, (3, 4, 6))
    assert [ks for ks, _, _ in found.fits] == [(3, 4), (6,)]
    assert all(abs(found.log_perplexity[k] - sweep.log_perplexity[k]) < 1e-6 for k in (3, 4, 6))
    assert len(found.assign(6).first().topics) == 6 and found.top_terms(4, 2).count() == 8


def test_pieces_and_padded_groups_are_the_plain_updates(monkeypatch):
    """Documents of any length, in parts, move as one by one in double precision."""
    rng = np.random.default_rng(7)
    sizes = [1, 1, 2, 9, 40, 130, 131, 400]
    row = np.repeat(np.arange(8), sizes)
    column = np.concatenate([np.sort(rng.choice(8000, s, False)) for s in sizes])
    value, beta = rng.integers(1, 4, len(row)).astype(float), rng.random((5, 8000)) + .01
    monkeypatch.setattr(TS, "SPARSE_PIECE", 140)
    pieces = list(TS._pieces(row, column, value, 8, 8000))
    assert len(pieces) > 2 and sum(p.n_rows for p in pieces) == 8 and all(p.counts is None for p in pieces)
    found = [TS._topics(p, beta, 16) for p in pieces]
    gamma, sums = np.concatenate([f[0] for f in found]), np.zeros((8000, 5))
    for p, f in zip(pieces, found):
        p.add_sums(f[1], f[2], sums)
    want, whole = np.ones((8, 5)), np.zeros((8000, 5))
    for d in range(8):
        mine, c = beta[:, column[row == d]], value[row == d]
        for _ in range(16):
            theta = TS._exp_log_share(want[d:d + 1])[0]
            new = 1 / 5 + theta * (mine @ (c / (theta @ mine)))
            change, want[d] = np.abs(new - want[d]).mean(), new
            if change < TS.TOLERANCE:
                break
        theta = TS._exp_log_share(want[d:d + 1])[0]
        whole[column[row == d]] += np.outer(c / (theta @ mine), theta)
    assert np.allclose(gamma, want, rtol=1e-3, atol=1e-2) and np.allclose(sums, whole, rtol=2e-2, atol=1e-2)


def test_share_of_small_weights():
    x = np.geomspace(1 / 64, 1e4, 500)
    assert np.allclose(TS._exp_log(x.astype("f4")), np.exp(TS.digamma(x)), rtol=2e-5)


def test_weighted_terms_read_their_input_once(spark):
    """One scan and no union, with null lists and null tokens left out."""
    df = spark.createDataFrame([(1, ["a", None, "b", "a"], ["b"]), (2, None, ["c"]), (1, ["a"], None), (None, ["d"], [])],
                               "id int, a array<string>, b array<string>")
    terms = TP.weighted_terms(df, "id", [("a", 1.0), ("b", .5)])
    assert "Union" not in terms._jdf.queryExecution().toString()
    assert sorted((r.id or 0, r.term, r.weight) for r in terms.collect()) == [
        (0, "d", 1.0), (1, "a", 3.0), (1, "b", 1.5), (2, "c", .5)]


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000)
    few = session.spread(df, "id").rdd.getNumPartitions()
    assert session.spread(df, "id", rows=10).rdd.getNumPartitions() == max(few, 100)
    assert session.spread(df, "id", tasks=few + 3).rdd.getNumPartitions() == few + 3


def test_blocks_are_packed_once(spark):
    """An iteration reads one row per block; null and repeated ids keep their entries."""
    rows = [(i if i % 7 else None, i % 5, float(i)) for i in range(70)]
    data = blocked.Blocked.of(spark.createDataFrame(rows, "id int, index long, value double"), 8)
    assert data.packed.count() <= data.n_blocks == 9 and data.n_entries == 70
    sums = {r["index"]: np.frombuffer(bytes(r.vec), "<f8").tolist()
            for r in data.column_sums(lambda v: np.column_stack([v, v * v])).collect()}
    assert sums == {j: [sum(v for _, k, v in rows if k == j), sum(v * v for _, k, v in rows if k == j)] for j in range(5)}

    def run(row, column, value, ids, vectors):
        yield ids, np.bincount(row, value * vectors[column, 0], len(ids)).astype(np.int64)

    table = spark.range(5).selectExpr("id as index").mapInArrow(
        lambda bs: (blocked._vectors(np.asarray(b.column(0)), np.ones((b.num_rows, 1))) for b in bs), blocked.VECTORS)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("total", T.LongType())])
    out = {r.id: r.total for r in data.apply(table, run, schema).collect()}
    assert out[None] == sum(range(0, 70, 7)) and out[1] == 1 and len(out) == 61


def test_every_block_has_a_task_of_its_own(spark):
    """No task has two blocks to work on while others have none."""
    rows = spark.range(4000).selectExpr("id", "id % 3 as index", "1D as value")
    data = blocked.Blocked.of(rows, 100)
    assert data.n_blocks == 40
    held = blocked._dealt(data.packed, data.n_blocks).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert [r["count"] for r in held] == [1] * 40


def test_item_terms_have_as_many_tasks_as_the_lines_need(spark, tmp_path, monkeypatch):
    """the join and the count of the terms get more tasks with more lines, whatever the shuffle partitions."""
    from refinery.plans import queries  # noqa: F401 -- registers the modules in their order
    from refinery.plans import queries_models as QM

    spark.range(40).selectExpr("id as o_orderkey", "id % 9 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(400).selectExpr("id % 40 as l_orderkey", "id % 5 as l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(5).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand").write.parquet(
        str(tmp_path / "part.parquet"))
    asked = []
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *c: asked.append((n, *c)) or plain(df, n, *c))
    monkeypatch.setattr(QM, "LINES_PER_TASK", 4)
    terms = QM._item_terms(spark, str(tmp_path))
    assert {(100, c) for c in ("l_orderkey", "o_orderkey", "o_custkey")} <= set(asked)
    weights = {t: w for t, w in terms.groupBy("term").agg(F.sum("weight")).collect()}
    assert weights == {"b": 200.0, **{f"n{i}": 80.0 for i in range(5)}}


def test_training_leaves_the_last_model_only(spark):
    """neither the models of earlier iterations nor the postings stay on disk; what stays can be read."""
    import os

    entries, words, _ = entries_of(spark, themed())
    folders = {session.checkpoint_dir(spark).removeprefix("file:"), spark.sparkContext.getCheckpointDir().removeprefix("file:")}
    listed = lambda: {f"{d}/{f}" for d in folders for f in os.listdir(d)}
    before, done = listed(), []
    found = TS.fit_sweep(entries, words, (2, 3), iterations=3, done=lambda: done.append(len(listed() - before)))
    left = {f.rsplit("/", 1)[1].rsplit("-", 5)[0]: sorted(os.listdir(f)) for f in listed() - before}
    assert done == [1] and sorted(left) == ["blocks", "topics"] and len(left["topics"]) == 1 and len(left["blocks"]) == 2
    assert found.assign(3).count() == 120 and found.term_weights(2).count() == 48


def test_updates_reuse_their_arrays():
    """An update allocates nothing of its documents' size; the numbers are those of new arrays."""
    x = np.random.default_rng(2).gamma(.5, 4., (7, 5)).astype("f4") + np.float32(.02)
    rooms = [np.full_like(x, np.nan) for _ in range(5)]
    found = TS._exp_log(x, rooms)
    assert found is rooms[4] and (found == TS._exp_log(x)).all() and not (x == found).any()
    counts, beta = np.random.default_rng(4).integers(0, 3, (9, 6)), np.random.default_rng(6).random((3, 6)) + .1
    row, column = np.nonzero(counts)
    seen, matmul = [], np.matmul

    def watched(*args, out=None, **kw):
        seen.append(out is not None)
        return matmul(*args, out=out, **kw)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(TS.np, "matmul", watched)
        TS._document_topics(row, column, counts[row, column].astype(float), 9, beta)
    assert seen and all(seen)


def test_terms_and_blocks_need_no_lists_of_functions_and_no_sort(spark):
    """The terms come from compiled generators, and a task packs its block without sorting its entries first."""
    df = spark.createDataFrame([(1, ["a"], ["b"])], "id int, a array<string>, b array<string>")
    assert "lambda" not in TP.weighted_terms(df, "id", [("a", 1.0), ("b", .5)])._jdf.queryExecution().toString()
    rows = spark.range(3000).selectExpr("id div 3 as id", "id % 50 as index", "1D as value")
    plans, keep = [], session.Tables.keep
    with pytest.MonkeyPatch.context() as m:
        m.setattr(session.Tables, "keep", lambda self, f: plans.append(f._jdf.queryExecution().toString()) or keep(self, f))
        data = blocked.Blocked.of(rows, 100)
    assert "MapInArrow" in plans[0] and "Sort" not in plans[0]
    assert data.n_blocks == data.packed.count() == 30 and data.packed.agg(F.sum(F.size("ids"))).first()[0] == 1000
