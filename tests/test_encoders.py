import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from refinery.features import chain as C
from refinery.features import encoders as E
from refinery.features.base import FitError
from refinery.features.reduce import EmbeddingPCA, choose_k


def test_boolean_demo(spark):
    vals = [True, None, False, True, None, True, None, None, False, True]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, b boolean")
    out = E.BooleanEncoder(column="b").fit(df).transform(df).orderBy("i")
    assert [r.b for r in out.collect()] == [1, 1, 0, 1, 1, 1, 1, 1, 0, 1]
    allnull = spark.createDataFrame([(1, None)], "i int, b boolean")
    assert E.BooleanEncoder(column="b").fit(allnull).transform(allnull).first().b == 0


def test_numeric_demo_standard_minmax_robust(spark):
    vals = [1.0, 2.0, 3.0, 4.0, float("nan"), 6.0, 100.0, 200.0, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    finite = [v for v in vals if math.isfinite(v)]
    mean = sum(finite) / len(finite)
    std = math.sqrt(sum((v - mean) ** 2 for v in finite) / len(finite))
    out = [r.x for r in E.NumericScaler(column="x").fit(df).transform(df).orderBy("i").collect()]
    assert out[4] == 0.0 and out[8] == 0.0
    assert math.isclose(out[0], (1 - mean) / std)
    mm = [r.x for r in E.NumericScaler(column="x", kind="minmax").fit(df).transform(df).orderBy("i").collect()]
    assert mm[0] == 0.0 and mm[7] == 1.0
    rb = [r.x for r in E.NumericScaler(column="x", kind="robust").fit(df).transform(df).orderBy("i").collect()]
    # quartiles of [1,2,3,4,6,100,200] by linear interpolation: 2.5 and 53
    assert math.isclose(rb[6], 100 / 50.5)
    const = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x double")
    for kind in ("standard", "minmax", "robust"):
        got = [r.x for r in E.NumericScaler(column="x", kind=kind).fit(const).transform(const).collect()]
        assert got == ([0.0, 0.0] if kind != "robust" else [5.0, 5.0])


def test_onehot_demo(spark):
    cats = list("ABACABCCCADEFA")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "i int, category string")
    model = E.OneHotEncoder(column="category", threshold=0.7).fit(df)
    out = model.transform(df)
    assert out.columns == ["i", "category_a", "category_c", "category_others"]
    rows = out.orderBy("i").collect()
    assert [(r.category_a, r.category_c, r.category_others) for r in rows[:4]] == [(1, 0, 0), (0, 0, 1), (1, 0, 0),
                                                                                   (0, 1, 0)]
    for r in rows:
        assert r.category_a + r.category_c + r.category_others == 1
    all_model = E.OneHotEncoder(column="category").fit(df)
    assert len(all_model.transform(df).columns) == 1 + 6


def test_onehot_name_collision_merged(spark):
    df = spark.createDataFrame([("Web Design",), ("web design",), ("x",)], "c string")
    out = E.OneHotEncoder(column="c").fit(df).transform(df)
    assert sorted(out.columns) == ["c_web_design", "c_x"]
    assert [r.c_web_design for r in out.collect()] == [1, 1, 0]


def test_frequency_demo_and_unseen(spark):
    cats = list("ABACABCCCADA")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "i int, c string")
    model = E.FrequencyEncoder(column="c").fit(df)
    got = {cats[r.i]: r.c for r in model.transform(df).collect()}
    assert got == {"A": 5 / 12, "B": 2 / 12, "C": 4 / 12, "D": 1 / 12}
    new = spark.createDataFrame([(0, "Z"), (1, None)], "i int, c string")
    assert [r.c for r in model.transform(new).orderBy("i").collect()] == [0.0, 0.0]


def test_ordinal_demo(spark):
    df = spark.createDataFrame([(0, "low", 0.0), (1, "medium", 1.0), (2, "high", 2.0), (3, "low", 0.0),
                                (4, "high", 2.0), (5, None, None)], "i int, s string, n double")
    s = E.OrdinalEncoder(column="s").fit(df).transform(df).orderBy("i")
    assert [r.s for r in s.collect()] == [1, 2, 0, 1, 0, 0]
    n = E.OrdinalEncoder(column="n").fit(df).transform(df).orderBy("i")
    assert [r.n for r in n.collect()] == [0, 1, 2, 0, 2, 0]
    mapped = E.OrdinalEncoder(column="s", mapping={"low": 1, "high": 3}).fit(df)
    with pytest.raises(Exception):
        mapped.transform(df).collect()
    lenient = E.OrdinalEncoder(column="s", mapping={"low": 1, "high": 3}, handle_invalid="null").fit(df)
    assert [r.s for r in lenient.transform(df).orderBy("i").collect()] == [1, None, 3, 1, 3, 3]


def test_list_demo(spark):
    lists = [["Python", "SQL", "Pandas"], ["Python", "Java", "C++"], ["Python", "R", "Statistics"], ["SQL", "Pandas"],
             ["Java", "C++"], ["Python"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, skills array<string>")
    out = E.MultiLabelEncoder(column="skills").fit(df).transform(df).orderBy("i")
    assert "skills_others" not in out.columns
    assert set(out.columns) == {"i", "skills_python", "skills_sql", "skills_pandas", "skills_java", "skills_c++",
                                "skills_r", "skills_statistics"}
    r0 = out.first()
    assert (r0.skills_python, r0.skills_sql, r0.skills_java) == (1, 1, 0)
    thr = E.MultiLabelEncoder(column="skills", threshold=0.5).fit(df).transform(df).orderBy("i").collect()
    # counts: Python 4, C++ 2, Java 2, Pandas 2, SQL 2, R 1, Statistics 1 (total 14): cut keeps Python, C++, Java
    assert [r.skills_others for r in thr] == [1, 0, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        E.MultiLabelEncoder(column="skills", threshold=1.5)


def test_mode_imputer(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a"), (4, None)], "i int, c string")
    out = E.ModeImputer(column="c").fit(df).transform(df).orderBy("i")
    assert [r.c for r in out.collect()] == ["b", "a", "b", "a", "a"]


def test_fit_errors_are_wrapped(spark):
    df = spark.createDataFrame([(1,)], "i int")
    with pytest.raises(FitError):
        E.ModeImputer(column="missing").fit(df)
    nan_only = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(FitError):
        E.NumericScaler(column="x").fit(nan_only)


def test_chain_demo_save_load_and_report(spark):
    df = spark.createDataFrame([(True, "low"), (False, "medium"), (True, "high"), (None, None)],
                               "boolean_col boolean, ordinal_col string")
    chain = C.FeatureChain([E.BooleanEncoder(column="boolean_col"), E.OrdinalEncoder(column="ordinal_col")])
    model, out = chain.fit_transform(df)
    assert [(r.boolean_col, r.ordinal_col) for r in out.collect()] == [(1, 1), (0, 2), (1, 0), (1, 0)]
    path = os.path.join(tempfile.mkdtemp(prefix="refinery-model-"), "m")
    C.save_model(model, path)
    again = C.load_model(path).transform(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    rep = C.report(spark, model).collect()
    assert [r.processor_class for r in rep] == ["BooleanModel", "OrdinalModel"]


def test_frequency_model_persists(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    model = C.FeatureChain([E.FrequencyEncoder(column="c")]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="refinery-model-"), "f")
    C.save_model(model, path)
    got = sorted(r.c for r in C.load_model(path).transform(df).collect())
    assert got == [1 / 3, 2 / 3, 2 / 3]


def test_pca_matches_numpy(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    model = EmbeddingPCA(column="embedding", threshold=0.85).fit(rows)
    out = model.transform(rows).orderBy("vec_id")
    pcs = [c for c in out.columns if c.startswith("embedding_PC")]
    got = np.array([[r[c] for c in pcs] for r in out.collect()])
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], dtype=float)
    xc = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    var = s ** 2 / (s ** 2).sum()
    k = choose_k(list(var), 0.85)
    assert len(pcs) == k
    ref = xc @ vt[:k].T
    for i in range(k):
        sign = np.sign(vt[i][np.argmax(np.abs(vt[i]))])
        assert np.allclose(got[:, i], ref[:, i] * sign, atol=1e-6)


def test_choose_k():
    assert choose_k([0.5, 0.3, 0.2], 0.8) == 2
    assert choose_k([0.5, 0.3, 0.2], 1.0) == 3
    assert choose_k([0.4, 0.3], 0.99) == 2


def test_pca_and_text_pca_persist(spark):
    from refinery.features.reduce import TextPCA

    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    base = tempfile.mkdtemp(prefix="refinery-model-")
    for df, enc, key in [(emb, EmbeddingPCA(column="embedding", threshold=0.5), "vec_id"),
                         (docs, TextPCA(column="text", n_components=3), "doc_id")]:
        model = C.FeatureChain([E.PassThrough(column=key), enc]).fit(df)
        out = model.transform(df)
        path = os.path.join(base, key)
        C.save_model(model, path)
        again = C.load_model(path).transform(df)
        assert again.columns == out.columns and len(out.columns) >= 2
        a = sorted(tuple(round(x, 9) for x in r) for r in out.collect())
        b = sorted(tuple(round(x, 9) for x in r) for r in again.collect())
        assert a == b


def test_chain_stacked_passes_equal_single_fits(spark):
    df = spark.createDataFrame([
        (1, "a", 2, ["x", "y"], ["p"]), (2, "b", 10, ["x"], None), (3, "a", 2, [], ["q", "p"]),
        (4, None, None, ["z", None], ["p"]), (5, "c", 10, None, [])],
        "id int, cat string, num int, l1 array<string>, l2 array<string>")
    encs = [E.OneHotEncoder(column="cat", threshold=0.7), E.FrequencyEncoder(column="num"),
            E.OneHotEncoder(column="num"), E.MultiLabelEncoder(column="l1", threshold=0.5),
            E.MultiLabelEncoder(column="l2")]
    chained = C.FeatureChain([E.PassThrough(column="id")] + encs).fit(df).transform(df)
    single = df
    for e in encs:
        single = e.fit(df).transform(single)
    assert sorted(chained.columns) == sorted(single.columns)
    cols = sorted(chained.columns)
    assert sorted(map(tuple, chained.select(cols).collect())) == sorted(map(tuple, single.select(cols).collect()))


def test_save_report_writes_tables(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "c string, f boolean")
    model = C.FeatureChain([E.FrequencyEncoder(column="c"), E.BooleanEncoder(column="f")]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="refinery-report-"), "r")
    C.save_report(spark, model, path)
    stages = spark.read.json(f"{path}/stages").orderBy("processor").collect()
    assert [s.processor_class for s in stages] == ["FrequencyModel", "BooleanModel"]
    mapping = {r.value: r.share for r in spark.read.json(f"{path}/tables/1_c_frequency_mapping").collect()}
    assert mapping == {"a": 2 / 3, "b": 1 / 3}


def test_frequency_encoder_beside_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), (None, 5, 6)], "c string, share int, value int")
    out = E.FrequencyEncoder(column="c").fit(df).transform(df)
    assert out.columns == ["c", "share", "value"]
    assert sorted(tuple(r) for r in out.collect()) == [(1 / 3, 5, 6), (2 / 3, 1, 2), (2 / 3, 3, 4)]


def test_null_vectors_get_null_components(spark):
    from refinery.features.reduce import EmbeddingPCA

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None), (3, [0.0, 5.0])],
                               "id int, v array<double>")
    out = {r.id: r.v_PC1 for r in EmbeddingPCA(column="v", n_components=1).fit(df).transform(df).collect()}
    assert out[2] is None and all(out[i] is not None for i in (0, 1, 3))


def test_ordinal_table_survives_save_without_scheme(spark, tmp_path):
    from refinery.features import chain as C

    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    model = C.from_spec([("c", "ordinal", {})]).fit(df)
    path = str(tmp_path / "model")  # no scheme: the cluster's default file system
    C.save_model(model, path)
    assert sorted(r.c for r in C.load_model(path).transform(df).collect()) == [0, 1, 1, 1]
    given = C.from_spec([("c", "ordinal", {"mapping": {"a": 5, "b": 6}})]).fit(df)
    C.save_model(given, path)
    assert sorted(r.c for r in C.load_model(path).transform(df).collect()) == [5, 6, 6, 6]
