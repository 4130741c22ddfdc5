"""Index encoders against brute force, their persistence, and keyed tables that join without an exchange."""

import re
import tempfile
import uuid
from collections import Counter

import pytest

from refinery.features.chain import from_spec, load_model, save_model
from refinery.features.encoders import MultiLabelEncoder
from refinery.features.sparse import IndexEncoder
from refinery.plans import jobs, queries
from refinery.session import checkpoint_dir
from refinery.sources.sinks import write_keyed

SF = "/root/testdata/sf0.001"
VALUES = ["b", "a", None, "a", "c", "b", "d", "", "a b", None]
LISTS = [["x", "y", None], ["x", "x"], [], None, [None], ["z"], ["x", "y"], ["y", "x"], ["x", "y"]]


def _order(values):
    return sorted(Counter(values).items(), key=lambda r: (-r[1], r[0]))


def _cut(values, threshold, inclusive):
    kept, run, total = [], 0, len(values)
    for v, n in _order(values):
        if threshold is not None and inclusive and kept and run >= threshold * total:
            break
        run += n
        if threshold is not None and not inclusive and run >= threshold * total:
            break
        kept.append(v)
    return kept


@pytest.mark.parametrize("threshold", [None, 0.6, 1.0, 0.0])
def test_scalar_places(spark, threshold):
    df = spark.createDataFrame(list(enumerate(VALUES)), "id int, v string")
    kept = _cut([v for v in VALUES if v is not None], threshold, inclusive=False)
    model = IndexEncoder("v", threshold).fit(df)
    got = {r.id: r.v_indices for r in model.transform(df).collect()}
    other = [] if threshold is None else [len(kept)]
    assert got == {i: [kept.index(v)] if v in kept else other for i, v in enumerate(VALUES)}
    assert model.getOrDefault(model.width) == len(kept) + len(other)
    unseen = model.transform(spark.createDataFrame([(1, "new")], "id int, v string")).first()
    assert unseen.v_indices == other


@pytest.mark.parametrize("threshold", [None, 0.7, 0.0])
def test_list_places(spark, threshold):
    df = spark.createDataFrame(list(enumerate(LISTS)), "id int, v array<string>")
    kept = _cut([x for v in LISTS for x in v or [] if x is not None], threshold, inclusive=True)
    model = IndexEncoder("v", threshold).fit(df)
    got = {r.id: r.v_indices for r in model.transform(df).collect()}
    assert got == {i: sorted({kept.index(x) if x in kept else len(kept) for x in v or [] if x is not None
                              if x in kept or threshold}) for i, v in enumerate(LISTS)}


def test_lists_agree_with_the_encoder_of_columns(spark):
    lists = [["x", "y"], ["x"], ["z", "y"], [], ["x", "w"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, v array<string>")
    wide = MultiLabelEncoder("v", 0.7).fit(df)
    model = IndexEncoder("v", 0.7).fit(df)
    names = [f"v_{x}" for x in wide.getOrDefault(wide.values)] + ["v_others"]
    columns = {r.id: [i for i, c in enumerate(names) if r[c]] for r in wide.transform(df).collect()}
    assert columns == {r.id: r.v_indices for r in model.transform(df).collect()}


def test_many_values_saved_and_reloaded(spark):
    df = spark.range(200_000).selectExpr("id", "concat('v', id % 150000) as v")
    model = from_spec([("id", "pass", {}), ("v", "indices", {})]).fit(df)
    path = f"{tempfile.mkdtemp(prefix='refinery-index-')}/m"
    save_model(model, path)
    out = load_model(path).transform(df)
    row = out.selectExpr("count(*) n", "count(distinct v_indices[0]) d", "min(v_indices[0]) lo", "max(v_indices[0]) hi",
                         "max(size(v_indices)) s").first()
    assert tuple(row) == (200_000, 150_000, 0, 149_999, 1)
    empty = IndexEncoder("v").fit(df.limit(0))
    assert empty.transform(df.limit(3)).selectExpr("max(size(v_indices))").first()[0] == 0


@pytest.fixture
def no_broadcast(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "refinery.broadcast.maxRows")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("refinery.broadcast.maxRows", "0")
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_keyed_job_tables_move_for_the_company_only(spark, no_broadcast):
    name = f"t_{uuid.uuid4().hex}_"
    tables = queries.queries_models._job_tables(spark, SF)
    stored = jobs.store_job_tables(tables, 4, name, f"{checkpoint_dir(spark)}/{name}")
    keyed, plain = jobs.integrate(stored, loaded=True), jobs.integrate(tables)
    assert len(_exchanges(plain)) > 8
    assert len(_exchanges(keyed)) <= 2 and "ID" not in _exchanges(keyed) and "JOBID" not in _exchanges(keyed)
    columns = [c for c in plain.columns if c != "WH_PARSED"]
    text = [f"cast(`{c}` as string)" for c in columns]
    assert sorted(map(tuple, keyed.selectExpr(*text).collect())) == sorted(map(tuple, plain.selectExpr(*text).collect()))


def test_keyed_table_is_replaced(spark):
    name = f"t_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    write_keyed(spark.range(10), name, "id", 2, path)
    assert write_keyed(spark.range(3).selectExpr("id", "'x' as `a.b`"), name, "id", 2, path).count() == 3
