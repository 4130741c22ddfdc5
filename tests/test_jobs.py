import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from refinery.features.chain import from_spec
from refinery.operators import resolve
from refinery.plans import jobs
from refinery.streaming.apply import read_parquet_stream, score_stream, write_stream


def _ts(s):
    return dt.datetime.fromisoformat(s)


def test_integrate_end_to_end(spark):
    t = {
        "jobs": spark.createDataFrame([("1", _ts("2024-01-01"), "c1", "FIXED"), ("1", _ts("2024-02-01"), "c1", "FIXED"),
                                       ("2", _ts("2024-01-01"), "c2", "HOURLY"), ("3", _ts("2024-01-01"), "\\N", "X")],
                                      "ID string, PARSED timestamp_ntz, COMPANYUID string, JOBTYPE string"),
        "work_history": spark.createDataFrame([("1", _ts("2024-01-01"), 10.0), ("2", _ts("2024-01-01"), 5.0),
                                               ("2", _ts("2024-01-02"), 6.0)],
                                              "JOBID string, PARSED timestamp_ntz, TOTALCHARGE double"),
        "companies": spark.createDataFrame([("c1", _ts("2024-01-01"), "Acme")], "UID string, PARSED timestamp_ntz, NAME string"),
        "segmentation": spark.createDataFrame([("1", "n", "v", "l", "t", 1)],
                                              "JOBID string, NAME string, VALUE string, LABEL string, TYPE string, SORTORDER int"),
        "occupations": spark.createDataFrame([("2", "Dev")], "JOBID string, PREFLABEL string"),
        "job_skill_links": spark.createDataFrame([("1", 10), ("1", 11), ("2", 10)], "JOBID string, SKILLID int"),
        "skill_labels": spark.createDataFrame([(10, "Python"), (11, "SQL")], "ID int, PREFLABEL string"),
        "additional_skills": spark.createDataFrame([("1", "Git")], "JOBID string, PREFLABEL string"),
        "job_tags": spark.createDataFrame([("2", "b"), ("2", "a")], "JOBID string, TAG string"),
    }
    out = jobs.integrate(t)
    rows = {(r.ID, r.WH_TOTALCHARGE): r for r in out.collect()}
    assert set(rows) == {("1", 10.0), ("2", 5.0), ("2", 6.0)}
    r1 = rows[("1", 10.0)]
    assert r1.COMPANY_NAME == "Acme" and r1.SKILLS == ["Python", "SQL"] and r1.TAGS == [] and r1.OCCUPATION is None
    assert r1.SEGMENTATION_DATA_VALUE == "v" and r1.ADDITIONAL_SKILLS == ["Git"]
    assert rows[("2", 6.0)].TAGS == ["a", "b"] and rows[("2", 6.0)].OCCUPATION == "Dev"


def test_clean_enrich_and_featurize(spark):
    df = spark.createDataFrame([
        ("1", "FIXED", None, 100.0, 1.0, 2.0, 4.0, 2.0, "2020-05-17", _ts("2024-01-01 00:00:00"),
         _ts("2024-01-02 12:00:00"), "1 month", "us", "Newyork", "NY", 50.0, True),
        ("2", "HOURLY", "LONG", None, 10.0, 20.0, 0.0, 1.0, "bad", _ts("2024-01-01 00:00:00"), None, "3 months",
         "Germany", "Munchen", None, 20.0, None),
        ("3", "HOURLY", "SHORT", None, 5.0, 6.0, 2.0, 1.0, None, _ts("2024-01-01 00:00:00"), None, "3 months",
         "Atlantis", "Nowhere", None, 1.0, False),
    ], "ID string, JOBTYPE string, HOURLYENGAGEMENTTYPE string, FIXEDPRICEAMOUNT double, HOURLYBUDGETMIN double, "
       "HOURLYBUDGETMAX double, COMPANY_JOBSPOSTEDCOUNT double, COMPANY_JOBSFILLEDCOUNT double, "
       "COMPANY_CONTRACTDATE string, WH_STARTDATE timestamp_ntz, WH_ENDDATE timestamp_ntz, OPENINGDURATION string, "
       "COMPANY_COUNTRY string, COMPANY_CITY string, COMPANY_STATE string, WH_TOTALCHARGE double, PREMIUM boolean")
    countries = spark.createDataFrame([("United States", "US", "USA", 330), ("Germany", "DE", "DEU", 83)],
                                      "name string, iso2 string, iso3 string, population long")
    cities = spark.createDataFrame([(1, "New York City", "US", 8000000, ["New York"]),
                                    (2, "München", "DE", 1500000, ["Munich"])],
                                   "geonameid int, name string, countrycode string, population long, "
                                   "alternatenames array<string>")
    dim = resolve.build_alias_dimension(cities, countries.select("iso2", "iso3"))
    gdp = spark.createDataFrame([("USA", 70000.0), ("DEU", None)], "code string, gdppc double")
    agg = spark.createDataFrame([("New York City", "NY", "USA", "new york metro")],
                                "city string, state string, country string, agglomeration string")
    cfg = jobs.EnrichConfig(flags=["PREMIUM"])
    clean, city_map = jobs.clean_enrich(df, countries, dim, gdp=gdp, agglomerations=agg, cfg=cfg)
    rows = {r.ID: r for r in clean.collect()}
    assert set(rows) == {"1", "2"}
    a, b = rows["1"], rows["2"]
    assert a.COMPANY_COUNTRY == "USA" and a.COMPANY_CITY == "New York City" and a.CITY_POPULATION == 8000000
    assert a.CITY_AGGLOMERATION == "New York Metro" and a.COUNTRY_GDPPC == 70000.0
    assert a.COMPANY_HIRE_RATE == 0.5 and b.COMPANY_HIRE_RATE == 0.0
    assert a.WH_DURATION == 36.0 and b.WH_DURATION is None
    assert a.COMPANY_EXPERIENCE == 4 * 12 + 7 and b.COMPANY_EXPERIENCE is None
    assert a.ENGAGEMENTTYPE == "PROJECT" and b.ENGAGEMENTTYPE == "LONG"
    assert (a.BUDGET_MIN, a.BUDGET_MAX, b.BUDGET_MIN, b.BUDGET_MAX) == (100.0, 100.0, 10.0, 20.0)
    assert a.PREMIUM is True and b.PREMIUM is False and b.COMPANY_CITY == "Munchen"
    assert city_map.count() == 2
    anywhere = spark.createDataFrame([("Munchen", None, "DEU", "munich metro")],
                                     "city string, state string, country string, agglomeration string")
    for require, want in ((False, "Munich Metro"), (True, None)):
        cfg = jobs.EnrichConfig(flags=["PREMIUM"], require_state=require)
        again, _ = jobs.clean_enrich(df, countries, dim, gdp=gdp, agglomerations=anywhere, cfg=cfg)
        assert {r.ID: r.CITY_AGGLOMERATION for r in again.collect()}["2"] == want
    spec = [("ID", "pass", {}), ("JOBTYPE", "onehot", {}), ("WH_TOTALCHARGE", "numeric", {}),
            ("PREMIUM", "boolean", {}), ("COMPANY_CITY", "frequency", {})]
    model, feats = jobs.featurize(clean, spec)
    assert set(feats.columns) == {"ID", "JOBTYPE_fixed", "JOBTYPE_hourly", "WH_TOTALCHARGE", "PREMIUM", "COMPANY_CITY"}


def test_model_scores_a_stream(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    model = from_spec([("o_orderkey", "pass", {}), ("o_orderpriority", "onehot", {"threshold": 0.5}),
                       ("o_orderstatus", "frequency", {})]).fit(orders)
    stream = read_parquet_stream(spark, sf, orders.schema, glob="orders.parquet")
    scored = score_stream(model, stream.select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    base = tempfile.mkdtemp(prefix="refinery-stream-")
    q = write_stream(scored, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out"))
    batch = model.transform(orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    assert got.count() == orders.count()
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_clean_enrich_city_fallback_table(spark):
    df = spark.createDataFrame([
        ("1", "FIXED", None, 1.0, 1.0, 1.0, 1.0, 1.0, None, _ts("2024-01-01"), None, "x", "US", "Big Apple", None, 5.0),
        ("2", "FIXED", None, 1.0, 1.0, 1.0, 1.0, 1.0, None, _ts("2024-01-01"), None, "x", "US", "Gotham", None, 5.0),
    ], "ID string, JOBTYPE string, HOURLYENGAGEMENTTYPE string, FIXEDPRICEAMOUNT double, HOURLYBUDGETMIN double, "
       "HOURLYBUDGETMAX double, COMPANY_JOBSPOSTEDCOUNT double, COMPANY_JOBSFILLEDCOUNT double, "
       "COMPANY_CONTRACTDATE string, WH_STARTDATE timestamp_ntz, WH_ENDDATE timestamp_ntz, OPENINGDURATION string, "
       "COMPANY_COUNTRY string, COMPANY_CITY string, COMPANY_STATE string, WH_TOTALCHARGE double")
    countries = spark.createDataFrame([("United States", "US", "USA", 330)],
                                      "name string, iso2 string, iso3 string, population long")
    cities = spark.createDataFrame([(1, "New York City", "US", 8000000, ["New York"])],
                                   "geonameid int, name string, countrycode string, population long, "
                                   "alternatenames array<string>")
    dim = resolve.build_alias_dimension(cities, countries.select("iso2", "iso3"))
    res = spark.createDataFrame([("Big Apple", "USA", " new york city "), ("Gotham", "USA", '""')],
                                "old_name string, country string, new_name string")
    clean, city_map = jobs.clean_enrich(df, countries, dim, city_resolutions=res,
                                        cfg=jobs.EnrichConfig(target=None))
    rows = {r.ID: r.COMPANY_CITY for r in clean.collect()}
    assert rows == {"1": "New York City"}  # "Gotham" resolves to a blank answer -> dropped as unresolved
    mapping = {r.old_name: r.new_name for r in city_map.collect()}
    assert mapping == {"Big Apple": "New York City", "Gotham": None}
