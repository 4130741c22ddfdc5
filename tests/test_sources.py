import os
import tempfile

import pytest
from pyspark.sql import functions as F

from refinery.operators.sample import seeded_fraction, seeded_sample
from refinery.plans import topics as TP
from refinery.plans.profile import profile
from refinery.sources.files import (file_manifest, load_keyed_table, probe_schemas, read_columns, read_csv,
                                    read_csv_with_lists)
from refinery.sources.sinks import export_catalog, write_csv, write_parquet


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_round_trip_quotes_newlines_lists(spark):
    d = tempfile.mkdtemp(prefix="refinery-csv-")
    p = os.path.join(d, "jobs.csv")
    _write(p, 'ID,TITLE,SKILLS\n1,"multi\nline, with ""quotes""","[\'Python\', \'Web Design\']"\n2,plain,\n'
              '3,bad,"[\'a\', "\n')
    df = read_csv_with_lists(spark, p, "ID string, TITLE string, SKILLS string", ["SKILLS"]).orderBy("ID")
    rows = df.collect()
    assert rows[0].TITLE == 'multi\nline, with "quotes"' and rows[0].SKILLS == ["Python", "Web Design"]
    assert rows[1].SKILLS == [] and rows[2].SKILLS is None
    out = os.path.join(d, "out")
    write_csv(df.withColumn("SKILLS", F.array_join("SKILLS", "|")), out)
    back = read_csv(spark, out, "ID string, TITLE string, SKILLS string").orderBy("ID").collect()
    assert back[0].TITLE == rows[0].TITLE


def test_load_keyed_table_modes(spark):
    df = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("2", 1, "\\N"), (None, 1, "x"), ("3", 1, "a")],
                               "ID string, PARSED int, V string")
    latest = {r.ID: r.V for r in load_keyed_table(df, "ID", "string", "PARSED").collect()}
    assert latest == {"1": "b", "2": None, "3": "a"}
    dedup = sorted(tuple(r) for r in load_keyed_table(df, "ID", None, "PARSED", mode="row_dedup").collect())
    assert dedup == [("1", 2, "b"), ("2", 1, None), ("3", 1, "a")]


def test_probe_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="refinery-probe-")
    _write(os.path.join(d, "A.CSV"), "x,y\n1,2\n")
    _write(os.path.join(d, "b.csv"), "z\n3\n")
    _write(os.path.join(d, "notes.txt"), "hello")
    rows = probe_schemas(spark, [("a", os.path.join(d, "A.CSV")), ("missing", os.path.join(d, "nope.csv"))],
                         fmt="csv").collect()
    assert [(r.table, r.column) for r in rows if r.error is None] == [("a", "x"), ("a", "y")]
    assert any(r.table == "missing" and r.error for r in rows)
    names = [r.name for r in file_manifest(spark, d, extensions=[".csv"]).collect()]
    assert names == ["A.CSV", "b.csv"]
    assert [r.name for r in file_manifest(spark, d, name_contains="note").collect()] == ["notes.txt"]


def test_read_columns_prunes(spark):
    df = read_columns(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey", "o_totalprice"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_export_catalog_and_parquet(spark):
    d = tempfile.mkdtemp(prefix="refinery-export-")
    spark.sql("CREATE DATABASE IF NOT EXISTS refinery_export_test")
    spark.range(5).write.mode("overwrite").saveAsTable("refinery_export_test.t1")
    paths = export_catalog(spark, "refinery_export_test", d, single_file=True)
    assert len(paths) == 1
    back = spark.read.option("header", True).csv(paths[0])
    assert back.count() == 5
    write_parquet(back, os.path.join(d, "pq"))
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 5
    spark.sql("DROP DATABASE refinery_export_test CASCADE")


def test_seeded_sample_deterministic(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = [r.o_orderkey for r in seeded_sample(o, 10, "o_orderkey", seed=1).collect()]
    b = [r.o_orderkey for r in seeded_sample(o.repartition(7), 10, "o_orderkey", seed=1).collect()]
    assert a == b and len(a) == 10
    assert seeded_sample(o.limit(3), 10, "o_orderkey").count() == 3
    n = seeded_fraction(o, 0.5, "o_orderkey").count()
    assert 0.4 * o.count() < n < 0.6 * o.count()


def test_profile_parts(spark):
    df = spark.createDataFrame([("a", 1.0, ["x", "y"]), ("a", 2.0, ["x"]), (None, None, None)],
                               "c string, n double, l array<string>")
    p = profile(df, categorical=["c"], numeric=["n"], lists=["l"], top_k=1)
    assert {r.column: r.nulls for r in p["nulls"].collect()} == {"c": 1, "n": 1, "l": 1}
    assert p["describe"].first()["mean"] == 1.5
    assert p["modes"].first()["mode"] == "a"
    assert {r.value: r["count"] for r in p["l:item_counts"].collect()} == {"x": 2, "y": 1}
    assert p["l:distinct_items"].first()[0] == 2


def test_weighted_counts_and_topics(spark):
    docs = spark.createDataFrame([(1, ["python", "sql"], ["python"]), (2, ["java", None], []), (3, [], None)],
                                 "id int, a array<string>, b array<string>")
    terms = TP.weighted_terms(docs, "id", [("a", 1.0), ("b", 0.5)])
    vocab = TP.vocabulary(terms)
    assert vocab == ["python", "java", "sql"]
    feats = TP.weighted_vectors(terms, "id", [1.0, 0.5], vocab)
    assert {r.id: r.features.toArray().tolist() for r in feats.collect()} == {1: [1.5, 0.0, 1.0], 2: [0.0, 1.0, 0.0]}
    fixed = TP.weighted_vectors(terms, "id", [1.0, 0.5], ["sql"])
    assert {r.id: r.features.toArray().tolist() for r in fixed.collect()} == {1: [1.0], 2: [0.0]}
    sweep = TP.lda_sweep(feats, [2, 3], max_iter=5)
    k = TP.best_k(sweep)
    assert k in (2, 3) and sweep.count() == 2 and not feats.is_cached
    model = TP.fit_lda(feats, k, max_iter=5)
    assert model.estimatedDocConcentration().size == k
    assigned = TP.assign_topics(model, feats, "id", min_share=0.99)
    assert set(r.topic_label for r in assigned.collect()) <= set(range(k)) | {-1}
    assert TP.topic_sizes(assigned).agg({"count": "sum"}).first()[0] == 2
    assert TP.top_terms(model, TP.vocabulary_frame(spark, vocab), 2).count() == 2 * k
