import math

from pyspark.sql import functions as F

from refinery import functions as RF


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ",".join(f"{k} string" for k in cols))
    return df.select(expr.alias("r")).first()["r"]


def test_normalize_name_folds_accents_and_strips(spark):
    assert one(spark, RF.normalize_name("x"), x="  São Paulo ") == "sao paulo"
    assert one(spark, RF.normalize_name("x"), x="Straße") == "strasse"
    assert one(spark, RF.normalize_name("x"), x="Łódź") == "lodz"
    assert one(spark, RF.normalize_name("x", {"м": "m", "о": "o", "с": "s", "к": "k", "в": "v", "а": "a"}),
               x="Москва") == "moskva"


def test_title_case_matches_python(spark):
    for s in ["winston-salem", "st. john's", "rio de janeiro", "1st avenue", "o'neill", "ÉCOLE du nord", ""]:
        assert one(spark, RF.title_case("x"), x=s) == s.title(), s
    assert one(spark, RF.title_case("x"), x=None) is None


def test_snake_name(spark):
    assert one(spark, RF.snake_name("x"), x="Web Design") == "web_design"
    assert RF.snake_name_py("Web Design") == "web_design"


def python_indel(a, b):
    if not a and not b:
        return 1.0
    prev = [0] * (len(b) + 1)
    for ca in a:
        row = [0]
        for j, cb in enumerate(b, start=1):
            row.append(prev[j - 1] + 1 if ca == cb else max(prev[j], row[j - 1]))
        prev = row
    return 2 * prev[-1] / (len(a) + len(b))


def test_indel_ratio_known_values(spark):
    pairs = [("new york", "newyork"), ("kitten", "sitting"), ("aarhus c", "aarhus"), ("abc", "xyz"), ("", ""),
             ("a", ""), ("banana", "ananas"), ("ééa", "éa")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", RF.indel_ratio("a", "b").alias("s")).collect()}
    for a, b in pairs:
        assert math.isclose(got[(a, b)], python_indel(a, b), abs_tol=1e-12), (a, b)
    assert math.isclose(got[("new york", "newyork")], 0.9333333333, abs_tol=1e-9)


def test_prefilter_is_lossless(spark):
    import random

    rnd = random.Random(7)
    alphabet = "abcde "
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            if b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.choice(alphabet))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", RF.indel_upper_bound_ok("a", "b", 0.8).alias("ok")).collect()
    for r in rows:
        if python_indel(r.a, r.b) > 0.8:
            assert r.ok, (r.a, r.b)


def test_safe_ratio_and_clip(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0), (1.0, 4.0), (-1.0, 2.0)],
                               "f double, p double")
    got = [r[0] for r in df.select(RF.safe_ratio("f", "p")).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 0.25, 0.0]


def test_null_marker(spark):
    df = spark.createDataFrame([("\\N",), ("a\\\\N b",), ("N",), ("plain",), (None,)], "x string")
    got = [r[0] for r in df.select(RF.null_marker_to_null("x")).collect()]
    assert got == [None, None, "N", "plain", None]
    exact = [r[0] for r in df.select(RF.null_marker_to_null("x", match="exact")).collect()]
    assert exact == [None, "a\\\\N b", "N", "plain", None]


def test_parse_list_literal(spark):
    df = spark.createDataFrame([("['a', 'b c']",), ('["x"]',), ("",), (None,), ("['a', ",), ("[]",)], "x string")
    got = [r[0] for r in df.select(RF.parse_list_literal("x")).collect()]
    assert got == [["a", "b c"], ["x"], [], [], None, []]


def test_blank_answers(spark):
    df = spark.createDataFrame([("",), ('""',), ("''",), (" ",), ("Paris",)], "x string")
    assert [r[0] for r in df.select(RF.blank_to_null("x")).collect()] == [None, None, None, None, "Paris"]


def test_dates(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2020-03-31 10:00:00' AS d, TIMESTAMP_NTZ'2020-04-01 16:30:00' AS e")
    r = df.select(RF.calendar_months_since("d", "2024-12-01").alias("m"), RF.hours_between("d", "e").alias("h"),
                  RF.hours_between("d", F.lit(None)).alias("n")).first()
    assert r.m == 4 * 12 + 9
    assert r.h == 30.5
    assert r.n is None
    bad = spark.createDataFrame([("2020-01-02 03:04:05",), ("garbage",)], "s string")
    got = [x[0] for x in bad.select(RF.parse_timestamp_coerce("s")).collect()]
    assert got[1] is None and str(got[0]) == "2020-01-02 03:04:05"


def test_list_flags(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["z", None],)], "x array<string>")
    r = df.select(RF.contains_flag("x", "a").alias("c"), RF.any_outside_flag("x", ["a", "b"]).alias("o")).collect()
    assert [x.c for x in r] == [1, 0, 0, 0]
    assert [x.o for x in r] == [0, 0, 0, 1]
    arr = spark.createDataFrame([([0.1, 0.7, 0.2],)], "p array<double>")
    assert arr.select(RF.argmax("p")).first()[0] == 1


def test_literal_map_and_templates(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["z"]), ("q", None, [])], "k string, s array<string>, t array<string>")
    r = df.select(RF.literal_map_lookup("k", {"a": 1}, "int").alias("m"),
                  RF.list_template("Skills: %s; Additional: %s", "s", "t").alias("txt"),
                  RF.join_items(RF.lower_items(F.array(F.lit("A"), F.lit("B"))), " ").alias("j")).collect()
    assert [x.m for x in r] == [1, None]
    assert r[0].txt == "Skills: x,y; Additional: z" and r[1].txt == "Skills: ; Additional: "
    assert r[0].j == "a b"
    arr = spark.createDataFrame([(["a", "b", "a"],), (None,)], "x array<string>")
    got = arr.select(RF.append_item("x", F.lit("c")).alias("ap"), RF.remove_item("x", "a").alias("rm")).collect()
    assert got[0].ap == ["a", "b", "a", "c"] and got[0].rm == ["b"] and got[1].ap == ["c"]


def test_list_literal_with_none_and_odd_items(spark):
    from refinery.functions.text import parse_list_literal

    rows = {"['a', None]": ["a", None], "[None]": [None], "['None', \"it's None, really\", None]":
            ["None", "it's None, really", None], "['a, None, b']": ["a, None, b"], r"['it\'s', None]": ["it's", None],
            '["x", null]': ["x", None], "['a', ": None, "": [], "['Nonesuch']": ["Nonesuch"]}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    got = {r.s: r.p for r in df.select("s", parse_list_literal("s").alias("p")).collect()}
    assert got == rows
