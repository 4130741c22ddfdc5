"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from refinery.plans.queries import TABLE_NAMES

SF = "/root/testdata/sf0.001"
# Encoders with a coverage threshold emit one column per selected value; the
# oracle names those columns for the sf0.01 data the driver checks.
DATA_DEPENDENT_COLUMNS = {"multilabel_onehot", "onehot_threshold", "encode_chain", "encoder_reload"}
SF_MID = "/root/testdata/sf0.01"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def _con(sf):
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, name):
    sf = SF_MID if name in DATA_DEPENDENT_COLUMNS else SF
    sdf = queries()[name](spark, sf)
    res = _con(sf).execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, sdf.collect()) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "return_flags_a" in df.columns
