import random

import pytest
from pyspark.sql import functions as F

from refinery.operators import counts, dedup, grouping, joins, tables


def test_strict_select_and_drop(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.strict_select(df, ["v"]).columns == ["v"]
    with pytest.raises(tables.MissingColumnsError):
        tables.strict_select(df, ["nope"])
    with pytest.raises(tables.MissingColumnsError):
        tables.strict_drop(df, ["nope"])
    assert tables.lenient_drop(df, ["nope", "v", "v"]).columns == ["k"]


def test_prefix_and_rename_keep(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "ID int, NAME string, X double")
    assert tables.prefix_columns(df, "WH_", keep=["ID"]).columns == ["ID", "WH_NAME", "WH_X"]
    out = tables.rename_and_keep(df, {"X": "x", "ID": "id"})
    assert out.columns == ["x", "id"]


def test_replace_and_fill(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    got = [r[0] for r in tables.replace_values(df, "c", {"a": "A"}).collect()]
    assert got == ["A", "b", None]
    assert [r[0] for r in tables.fill_constant(df, {"c": "z"}).collect()] == ["a", "b", "z"]


def test_clean_null_markers_only_strings(spark):
    df = spark.createDataFrame([("k\\N", "\\N", 1)], "key string, v string, n int")
    r = tables.clean_null_markers(df, exclude=["key"]).first()
    assert r.key == "k\\N" and r.v is None and r.n == 1


def test_latest_per_key_and_row_dedup(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 5, "x"), ("b", 5, "w"), ("c", None, "q")]
    df = spark.createDataFrame(rows, "k string, ver int, v string")
    got = {r.k: (r.ver, r.v) for r in dedup.latest_per_key(df, "k", "ver", tie_break=["v"]).collect()}
    assert got == {"a": (3, "y"), "b": (5, "x"), "c": (None, "q")}
    rows2 = [("k1", 1, "x"), ("k2", 1, "x"), ("k3", 2, "x")]
    d2 = spark.createDataFrame(rows2, "k string, ver int, v string")
    got2 = sorted(tuple(r) for r in dedup.row_dedup(d2, "k", "ver").collect())
    assert got2 == [("k2", 1, "x"), ("k3", 2, "x")]


def test_ordered_list_keeps_nulls_duplicates_and_order(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, 2, None), (1, 4, "a"), (2, 1, "z"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    got = {r.k: r.vals for r in grouping.ordered_list(df, "k", "v", ["o"], alias="vals").collect()}
    assert got == {1: ["a", None, "c", "a"], 2: ["z"]}
    for order in (["o"], ["v"]):
        kept = {r.k: r.vals for r in grouping.ordered_list(df, "k", "v", order, alias="vals",
                                                           null_items="drop").collect()}
        assert {k: sorted(v) for k, v in kept.items()} == {1: ["a", "a", "c"], 2: ["z"]}


def test_guarded_lookup_raises_on_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(joins.FanOutError):
        joins.guarded_lookup(left, right, "k")
    ok = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r.k, r.v) for r in joins.guarded_lookup(left, ok, "k").collect()) == [(1, "a"), (2, None)]


def test_join_grouped_gives_empty_list_on_miss(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    g = spark.createDataFrame([(1, ["x"])], "jid int, tags array<string>")
    got = {r.id: r.tags for r in joins.join_grouped(left, g, "id", "jid", ["tags"]).collect()}
    assert got == {1: ["x"], 2: []}


def test_checked_broadcast_respects_limit(spark):
    small = spark.range(10)
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().logical().toString() or True
    big = joins.checked_broadcast(spark.range(100), max_rows=10)
    assert "broadcast" not in big._jdf.queryExecution().logical().toString().lower()
    hinted = joins.checked_broadcast(spark.range(5), max_rows=10)
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()


def _python_cut(freq, t, inclusive):
    items = sorted(freq.items(), key=lambda kv: (-kv[1], kv[0]))
    total = sum(freq.values())
    if t is None:
        return {v for v, _ in items}
    out, cum = set(), 0
    for i, (v, c) in enumerate(items):
        before = cum
        cum += c
        if inclusive:
            if before < t * total or i == 0:
                out.add(v)
        else:
            if cum < t * total:
                out.add(v)
            else:
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coverage_select_matches_loop(spark, seed):
    rnd = random.Random(seed)
    freq = {f"v{i}": rnd.choice([1, 1, 2, 3, 5, 8, 8, 13]) for i in range(60)}
    df = spark.createDataFrame(list(freq.items()), "value string, count long")
    for t in [0.0, 0.1, 0.5, 0.8, 0.99, 1.0, None]:
        for inc in (True, False):
            want = _python_cut(freq, t, inc)
            got = {r.value for r in counts.coverage_select(df, t, inclusive=inc).collect()}
            assert got == want, (t, inc)
            rows, _ = counts.coverage_rows(df, t, inclusive=inc)
            assert {r[0] for r in rows} == want, (t, inc)


def test_running_sum_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id % 700 AS a", "id AS b", "id % 13 AS n")
    got = [tuple(r) for r in counts.running_sum(df, [F.desc("a"), F.asc("b")], F.col("n"), "s").collect()]
    rows = sorted(((r.a, r.b, r.n) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    want, run = [], 0
    for r in rows:
        run += r[2]
        want.append((*r, run))
    assert sorted(got) == sorted(want)
    assert counts.running_sum(df.limit(0), [F.col("a")], F.lit(1), "s").count() == 0


def test_value_shares_and_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    s = {r.value: (r["count"], r.share) for r in counts.value_shares(df, "c").collect()}
    assert s == {"a": (2, 2 / 3), "b": (1, 1 / 3)}
    s2 = {r.value: r.share for r in counts.value_shares(df, "c", dropna=False).collect()}
    assert s2 == {"a": 0.5, "b": 0.25, None: 0.25}
    p = counts.null_profile(df).first()
    assert (p.column, p.nulls, p.non_nulls, p.distinct) == ("c", 1, 3, 2)


def test_observe_counts_rows(spark):
    df, obs = joins.count_rows(spark.range(7), "step")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 7


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    vals = np.concatenate([rnd.normal(size=3000), rnd.integers(0, 5, size=2000).astype(float), [np.nan] * 0])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = counts.exact_quantiles(df, ["v"], probs)["v"]
    want = np.quantile(vals, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert counts.exact_quantiles(df.filter("v IS NULL"), ["v"], [0.5]) == {"v": [None]}


def test_exact_quantiles_ties_ranges_and_missing(spark):
    import numpy as np

    rnd = np.random.default_rng(6)
    cols = {"ties": np.where(rnd.random(4000) < 0.8, 0.0, rnd.integers(0, 50, 4000)),
            "wide": np.exp(rnd.normal(0, 60, 4000)) * rnd.choice([-1, 1], 4000), "whole": rnd.integers(1, 51, 4000) * 1.0,
            "same": np.full(4000, 7.0)}
    df = spark.createDataFrame([tuple(map(float, r)) + (float("nan"),) for r in zip(*cols.values())],
                               ", ".join(f"{c} double" for c in cols) + ", gap double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = counts.exact_quantiles(df, [*cols, "gap"], probs)
    for c, v in cols.items():
        assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-12, atol=0), c
    assert got["gap"] == [None] * len(probs)
    ends = spark.createDataFrame([(float(x),) for x in ["-inf", -3, -1, 0, 2, 5, "inf"]], "v double")
    assert counts.exact_quantiles(ends, ["v"], [0.0, 1 / 6, 0.5, 4 / 6, 1.0])["v"] == \
        [float("-inf"), -3, 0, 2, float("inf")]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (3.0, None)], "x double, s string")
    (d,) = counts.describe(df, ["x"]).collect()
    assert (d["count"], d.mean, d.min, d.p50, d.max) == (2, 2.0, 1.0, 2.0, 3.0) and abs(d.std - 2 ** 0.5) < 1e-12
    for approx in (False, True):
        got = {r["column"]: (r.nulls, r.non_nulls, r.distinct) for r in counts.null_profile(df, approx=approx).collect()}
        assert got == {"x": (1, 2, 2), "s": (1, 2, 2)}


def test_ordered_by_value_fast_path_equals_general(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice(["b", "a", None, "c", "a"])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k int, v string")
    df2 = df.withColumn("o", F.col("v"))
    fast = {r.k: r.l for r in grouping.ordered_list(df, "k", "v", ["v"], alias="l").collect()}
    general = {r.k: r.l for r in grouping.ordered_list(df2, "k", "v", ["o"], alias="l").collect()}
    assert fast == general
    assert all(lst[:lst.count(None)] == [None] * lst.count(None) for lst in fast.values())


def test_guarded_lookup_above_broadcast_limit_shuffles(spark):
    left = spark.range(50).withColumnRenamed("id", "k")
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    spark.conf.set("refinery.broadcast.maxRows", "5")
    try:
        out = joins.guarded_lookup(left, right, "k")
        assert "broadcast" not in out._jdf.queryExecution().logical().toString().lower()
        got = {r.k: r.v for r in out.collect()}
        assert got[3] == 30 and got[40] is None and len(got) == 50
    finally:
        spark.conf.unset("refinery.broadcast.maxRows")
    small = joins.guarded_lookup(left, right, "k")
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()


def test_latest_per_key_with_hot_key(spark):
    rnd = random.Random(4)
    rows = [(0 if i % 5 < 2 else rnd.randint(1, 200), i, rnd.randint(0, 9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, ver int, v int")
    got = {r.k: (r.ver, r.v) for r in dedup.latest_per_key(df, "k", "ver").collect()}
    want = {}
    for k, ver, v in rows:
        if k not in want or ver > want[k][0]:
            want[k] = (ver, v)
    assert got == want


def test_row_dedup_sends_the_key_once(spark):
    """Of rows equal but for the key the largest key stays, null keys last; no ordering struct is shuffled."""
    from refinery.operators.dedup import row_dedup

    df = spark.createDataFrame([("1", 5, 7), ("3", 5, 7), ("2", 5, None), (None, 5, 7), (None, 6, 1), ("9", None, 7)],
                               "k string, x int, v int")
    out = row_dedup(df, "k", "v")
    assert "max_by" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {("3", 5, 7), ("2", 5, None), (None, 6, 1), ("9", None, 7)}
