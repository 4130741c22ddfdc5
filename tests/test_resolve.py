"""Entity resolution tests; the brute-force matcher below scores every pair in a
block and exists only as the reference the prefix-filtered matcher must equal."""

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refinery.functions.similarity import indel_ratio
from refinery.functions.text import normalize_name
from refinery.operators import resolve


def bruteforce_best_match(queries: DataFrame, name_col: str, block_col: str, dim: DataFrame,
                          alias_col: str = "alias", dim_block_col: str = "block", canonical_col: str = "canonical",
                          priority_col: str | None = "population", threshold: float = 0.80,
                          normalize: bool = True) -> DataFrame:
    """Reference implementation for tests: every pair within a block is scored."""
    q = (queries.select(F.col(name_col).alias("_raw"), F.col(block_col).alias("_blk"))
         .filter(F.col("_raw").isNotNull()).distinct()
         .withColumn("_q", normalize_name(F.col("_raw")) if normalize else F.col("_raw")))
    prio = F.col(priority_col) if priority_col else F.lit(0)
    d = dim.select(F.col(alias_col).alias("_a"), F.col(dim_block_col).alias("_blk"),
                   F.col(canonical_col).alias("_canon"), prio.cast("double").alias("_prio"))
    pairs = (q.join(d, "_blk").withColumn("_score", indel_ratio("_q", "_a"))
             .filter(F.col("_score") > F.lit(threshold)))
    w = Window.partitionBy("_raw", "_blk").orderBy(F.desc("_score"), F.desc("_prio"), F.asc("_canon"))
    top = pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return (q.join(top.select("_raw", "_blk", F.col("_canon").alias("match"), F.col("_score").alias("score")),
                   ["_raw", "_blk"], "left")
            .select(F.col("_raw").alias(name_col), F.col("_blk").alias(block_col), "match", "score"))


def _rows(df, *cols):
    return sorted(tuple((round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.select(*cols).collect())


def test_city_demo_with_alternates_and_exclusion(spark):
    countries = spark.createDataFrame([("US", "USA"), ("DE", "DEU"), ("RU", "RUS")], "iso2 string, iso3 string")
    cities = spark.createDataFrame([
        (1, "New York City", "US", 8000000, ["New York", "NYC", "Nueva York"]),
        (2, "Winston-Salem", "US", 250000, []),
        (3, "München", "DE", 1500000, ["Munich", "Monaco di Baviera"]),
        (4, "Tiny", "US", 10, None),
        (5, "Moscow", "RU", 12000000, ["Moskva"]),
        (6, "Nowhere", "ZZ", 1000, None),
    ], "geonameid int, name string, countrycode string, population long, alternatenames array<string>")
    excl = spark.createDataFrame([(1, "NYC")], "geonameid int, alias string")
    dim = resolve.build_alias_dimension(cities, countries, min_population=500, exclusions=excl)
    aliases = {(r.block, r.alias) for r in dim.collect()}
    assert ("USA", "new york") in aliases and ("USA", "nyc") not in aliases
    assert ("DEU", "munchen") in aliases and not any(a == "tiny" for _, a in aliases)
    queries = spark.createDataFrame([
        ("new york ", "USA"), ("Newyork", "USA"), ("winston salem", "USA"), ("Munchen", "DEU"),
        ("Muenchen", "DEU"), ("Paris", "USA"), ("moskwa", "RUS"), (None, "USA"),
    ], "city string, iso3 string")
    got = {(r.city, r.iso3): (r.match, r.score) for r in
           resolve.fuzzy_best_match(queries, "city", "iso3", dim).collect()}
    assert got[("new york ", "USA")] == ("New York City", 1.0)
    assert got[("Newyork", "USA")][0] == "New York City"
    assert got[("winston salem", "USA")][0] == "Winston-Salem"
    assert got[("Munchen", "DEU")] == ("Munchen", 1.0)
    assert got[("Paris", "USA")] == (None, None)
    assert got[("moskwa", "RUS")][0] == "Moscow"
    assert (None, "USA") not in got


def test_prefix_filter_equals_bruteforce_random(spark):
    rnd = random.Random(11)
    alphabet = "abcdeilnorst "
    names = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 14))) for _ in range(120)]
    dim = spark.createDataFrame(
        [(n.strip() or "x", rnd.choice(["A", "B"]), n.title(), rnd.randint(1, 5)) for n in names],
        "alias string, block string, canonical string, population int")
    qs = []
    for n in names:
        s = list(n)
        for _ in range(rnd.randint(0, 2)):
            if s and rnd.random() < 0.5:
                s.pop(rnd.randrange(len(s)))
            else:
                s.insert(rnd.randrange(len(s) + 1), rnd.choice(alphabet))
        qs.append(("".join(s), rnd.choice(["A", "B"])))
    q = spark.createDataFrame(qs, "name string, block string")
    for t in (0.6, 0.8):
        fast = resolve.fuzzy_best_match(q, "name", "block", dim, threshold=t)
        slow = bruteforce_best_match(q, "name", "block", dim, threshold=t)
        assert _rows(fast, "name", "block", "match", "score") == _rows(slow, "name", "block", "match", "score")


def test_prefix_filter_equals_bruteforce_part(spark):
    from refinery.plans.queries_resolution import _dimension, _perturbed

    sf = "/root/testdata/sf0.01"
    q, d = _perturbed(spark, sf), _dimension(spark, sf)
    fast = resolve.fuzzy_best_match(q, "name", "block", d)
    slow = bruteforce_best_match(q, "name", "block", d)
    assert _rows(fast, "name", "block", "match", "score") == _rows(slow, "name", "block", "match", "score")


def test_precedence_lookup(spark):
    dim = spark.createDataFrame([("Germany", "DE", "DEU"), ("Deutschland", "DX", "DXX"), ("Österreich", "AT", "AUT")],
                                "name string, iso2 string, iso3 string")
    vals = spark.createDataFrame([(" germany ",), ("de",), ("deu",), ("osterreich",), ("xx",), (None,)], "v string")
    got = {r.v: r.iso3 for r in resolve.precedence_lookup(vals, "v", dim, "name", "iso2", "iso3").collect()}
    assert got == {" germany ": "DEU", "de": "DEU", "deu": "DEU", "osterreich": "AUT", "xx": None}


def test_confidence_split_and_fallback(spark):
    m = spark.createDataFrame([("a", "X", "A", 0.95), ("b", "X", "B", 0.85), ("c", "X", None, None),
                               ("d", "X", None, None)], "name string, block string, match string, score double")
    acc, rest = resolve.confidence_split(m, 0.88)
    assert [r.name for r in acc.collect()] == ["a"]
    res = spark.createDataFrame([("b", "X", "  big city "), ("c", "X", '""')], "old string, ctry string, ans string")
    fb = resolve.fallback_resolve(rest, ["name", "block"], res, ["old", "ctry"], answer_col="ans", out_col="resolved")
    got = {r.name: r.resolved for r in fb.collect()}
    assert got == {"b": "Big City", "c": None, "d": None}


def test_resolver_callable_runs_on_distinct_keys(spark):
    import pandas as pd

    residue = spark.createDataFrame([("paris", "FRA"), ("paris", "FRA"), ("lyon", "FRA"), ("boom", "FRA")],
                                    "city string, country string")

    def resolver(pdf: pd.DataFrame) -> pd.Series:
        if (pdf["city"] == "boom").any():
            raise RuntimeError("service down")
        return pdf["city"].str.upper()

    out = resolve.resolve_with_callable(residue, ["city", "country"], resolver, batch_rows=1)
    got = sorted((r.city, r.match, r.resolve_error) for r in out.collect())
    assert got[0] == ("boom", None, "service down")
    assert ("lyon", "Lyon", None) in got and got.count(("paris", "Paris", None)) == 2
