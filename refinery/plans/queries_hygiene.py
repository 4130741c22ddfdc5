"""Registered queries for table hygiene, list helpers, sources and sinks, and user hooks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from refinery.features import chain as C
from refinery.features.reduce import embed_with
from refinery.functions import dates, lists, numeric, text
from refinery.operators import grouping, joins, resolve, tables
from refinery.operators.answers import read_answers, resolve_resumable
from refinery.plans.queries import _NATION_CODES_SQL, _nation_codes, _r6, _t, register
from refinery.plans.queries_models import CHAIN_SPEC, chain_input
from refinery.session import checkpoint_dir
from refinery.sources import files, sinks


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("hygiene_steps", """
SELECT c_custkey, c_name AS name, c_name AS label, coalesce(seg, 'NONE') AS c_mktsegment
FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg,
             CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
WHERE bal IS NOT NULL AND c_name IS NOT NULL
""")
def q_hygiene_steps(spark, sf):
    """Rename, copy, fill, drop incomplete rows, strict and lenient drops."""
    c = _t(spark, sf, "customer").withColumns({
        "c_mktsegment": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")),
        "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    c = tables.rename(c, {"c_name": "name", "absent": "x"})
    c = tables.copy_column(c, "name", "label")
    c = tables.drop_incomplete(c, ["c_acctbal", "name"])
    c = tables.fill_constant(c, {"c_mktsegment": "NONE"})
    return tables.lenient_drop(tables.strict_drop(c, ["c_acctbal"]), ["c_nationkey", "absent"])


@register("load_keyed_table", r"""
SELECT user_id, event_id, ts, event_type, round(value, 6) AS value, mark FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, ts, event_type, value,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS mark FROM events WHERE user_id % 5 <> 0))
WHERE rn = 1
""")
def q_load_keyed_table(spark, sf):
    """S2 in one call: null markers, null keys, key cast, latest row per key."""
    ev = _t(spark, sf, "events").select(
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "event_id", "ts", "event_type", "value",
        F.when(F.col("event_id") % 3 == 0, F.lit("\\N")).otherwise(F.col("event_type")).alias("mark"))
    out = files.load_keyed_table(ev, "user_id", "string", "ts")
    return out.withColumn("value", _r6(F.col("value")))


_FLAG_LISTS = """(SELECT l_orderkey, list(lower(l_returnflag) ORDER BY l_returnflag) AS l FROM lineitem
  WHERE l_returnflag <> 'N' GROUP BY 1)"""


@register("list_helpers", f"""
SELECT o_orderkey,
  array_to_string(list_append(coalesce(l, []), 'x'), ',') AS appended,
  array_to_string([v for v in coalesce(l, []) if v <> 'a'], ',') AS removed,
  'flags: ' || coalesce(array_to_string(l, ','), '') || ' (' || o_orderstatus || ')' AS described
FROM orders LEFT JOIN {_FLAG_LISTS} ON o_orderkey = l_orderkey
""")
def q_list_helpers(spark, sf):
    """Append, exclude, template, join and lower-case items; a missing list is empty."""
    li = _t(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    g = grouping.ordered_list(li, "l_orderkey", "l_returnflag", ["l_returnflag"], alias="l")
    o = joins.join_grouped(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), g, "o_orderkey",
                           "l_orderkey", ["l"])
    o = o.withColumn("l", lists.lower_items("l"))
    return o.select("o_orderkey", lists.join_items(lists.append_item("l", F.lit("x"))).alias("appended"),
                    lists.join_items(lists.remove_item("l", "a")).alias("removed"),
                    F.concat(lists.list_template("flags: %s (", "l"), "o_orderstatus", F.lit(")")).alias("described"))


@register("non_empty_lists", f"""
SELECT l_orderkey, CAST(len(l) AS INTEGER) AS n FROM (
  SELECT l_orderkey, [v for v in list(l_returnflag) if v <> 'N'] AS l FROM lineitem GROUP BY 1) WHERE len(l) > 0
""")
def q_non_empty_lists(spark, sf):
    """Orders whose list keeps an item."""
    g = grouping.ordered_list(_t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["l_returnflag"], alias="l")
    return g.withColumn("l", lists.remove_item("l", "N")).filter(lists.non_empty("l")).select(
        "l_orderkey", F.size("l").alias("n"))


@register("flags_and_text", """
SELECT event_id, coalesce(CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END, false) AS flag,
  CASE WHEN event_id % 3 = 0 THEN 'Missing' ELSE event_type END AS label, ts AS parsed
FROM events
""")
def q_flags_and_text(spark, sf):
    """strict timestamp parse, boolean coerce, text placeholder."""
    ev = _t(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit("true")).when(k == 1, F.lit("false"))
    return ev.select("event_id", numeric.to_flag(raw).alias("flag"),
                     text.text_or_placeholder(F.when(F.col("event_id") % 3 != 0, F.col("event_type"))).alias("label"),
                     dates.parse_timestamp_strict(F.col("ts").cast("string")).alias("parsed"))


@register("distinct_columns", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct_columns(spark, sf):
    """D3: distinct combinations of two columns."""
    return grouping.distinct_rows(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("distinct_sorted", "SELECT DISTINCT p_brand FROM part")
def q_distinct_sorted(spark, sf):
    """Distinct values of one column, sorted."""
    return grouping.distinct_values(_t(spark, sf, "part"), "p_brand", sort=True)


@register("row_counts", "SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R'")
def q_row_counts(spark, sf):
    """Rows of a step, observed while another action runs."""
    step, seen = joins.count_rows(_t(spark, sf, "lineitem").filter("l_returnflag = 'R'"), f"step-{uuid.uuid4().hex}")
    step.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


@register("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_orderpriority || ', \"x\"' AS note FROM orders")
def q_csv_round_trip(spark, sf):
    """S1 + S11 + S12: a gzip header CSV with quotes and commas, written and scanned with a schema."""
    path = _folder(spark, "csv")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus",
                                       F.concat("o_orderpriority", F.lit(', "x"')).alias("note"))
    sinks.write_csv(o, path, compression="gzip")
    return files.read_csv(spark, path, o.schema)


@register("csv_lists_round_trip", """
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(l_returnflag, '|' ORDER BY l_returnflag) AS flags
FROM lineitem GROUP BY 1
""")
def q_csv_lists_round_trip(spark, sf):
    """Lists rendered as literals in CSV come back as arrays."""
    path = _folder(spark, "csv-lists")
    g = grouping.ordered_list(_t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["l_returnflag"], alias="l")
    literal = F.concat(F.lit("['"), F.array_join("l", "', '"), F.lit("']"))
    sinks.write_csv(g.select("l_orderkey", literal.alias("l")), path)
    back = files.read_csv_with_lists(spark, path, "l_orderkey long, l string", ["l"])
    return back.select("l_orderkey", F.size("l").alias("n"), F.array_join("l", "|").alias("flags"))


@register("export_manifest", """
SELECT t AS "table", true AS listed, n AS rows FROM (
  SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem)
""")
def q_export_manifest(spark, sf):
    """Tables exported to gzip CSV, their files listed by extension, and the listed files read back."""
    path = _folder(spark, "export")
    given = {t: _t(spark, sf, t) for t in ("customer", "orders", "lineitem")}
    sinks.export_tables(given, path)
    folder = F.element_at(F.split("path", "/"), -2)
    listed = (files.file_manifest(spark, path, extensions=["CSV.GZ"], name_contains="part-")
              .groupBy(folder.alias("table")).agg(F.max("length").alias("largest")))
    counts = None
    for name, df in given.items():
        back = files.read_csv(spark, f"{path}/{name}", df.schema).agg(F.count("*").alias("rows"))
        one = back.select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(listed, "table", "left").select("table", (F.col("largest") > 0).alias("listed"), "rows")


@register("parquet_round_trip", "SELECT p_partkey, p_brand, p_type FROM part")
def q_parquet_round_trip(spark, sf):
    """S13 + S5: a partitioned Parquet table, read with column pruning."""
    path = _folder(spark, "parquet")
    sinks.write_parquet(_t(spark, sf, "part"), path, partition_by=["p_type"])
    return files.read_columns(spark, path, ["p_partkey", "p_brand", "p_type"])


@register("report_sink", "SELECT * FROM (VALUES {}) t(processor, column_name, processor_class)".format(", ".join(
    f"({i}, '{c}', '{m}')" for i, (c, m) in enumerate(zip(
        [c for c, _, _ in CHAIN_SPEC], ["PassThroughModel", "OneHotModel", "OrdinalModel", "FrequencyModel", "NumericModel",
                                        "NumericModel", "BooleanModel", "ModeModel", "DropModel"]), start=1))))
def q_report_sink(spark, sf):
    """S14 + E12: the report of a fitted chain as JSON, read back."""
    path = _folder(spark, "report")
    C.save_report(spark, C.from_spec(CHAIN_SPEC).fit(chain_input(spark, sf)), path)
    return spark.read.json(f"{path}/stages").select(F.col("processor").cast("int").alias("processor"), "column_name",
                                                    "processor_class")


@register("city_aliases", f"""
WITH d AS {_NATION_CODES_SQL},
x AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS k, 400 + s_suppkey * 7 AS pop FROM supplier),
c AS (SELECT x.*, iso3 AS block FROM x JOIN d ON d.iso2 = 'N' || chr(k + 65) WHERE pop >= 500)
SELECT DISTINCT block, lower(trim(a)) AS alias, CAST(pop AS BIGINT) AS population
FROM (SELECT block, pop, unnest([name, 'Alt ' || name]) AS a, id FROM c)
WHERE NOT (id % 10 = 0 AND a LIKE 'Alt %')
""")
def q_city_aliases(spark, sf):
    """S6 + S7 + F21: alternate names exploded, small and excluded ones dropped, two- to three-letter codes."""
    s = _t(spark, sf, "supplier")
    cities = s.select(F.col("s_suppkey").alias("geonameid"), F.col("s_name").alias("name"),
                      F.concat(F.lit("N"), F.char(F.col("s_nationkey") + 65)).alias("countrycode"),
                      (400 + F.col("s_suppkey") * 7).cast("bigint").alias("population"),
                      F.array(F.concat(F.lit("Alt "), "s_name")).alias("alternatenames"))
    gone = cities.filter("geonameid % 10 = 0").select("geonameid", F.concat(F.lit("Alt "), "name").alias("alias"))
    countries = resolve.country_dimension(_nation_codes(spark, sf)).select("iso2", "iso3")
    return resolve.build_alias_dimension(cities, countries, 500, gone).select("block", "alias", "population")


@register("resolver_hook", """
SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS match FROM customer
""")
def q_resolver_hook(spark, sf):
    """A user's resolver on the distinct keys only, in batches."""
    c = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")

    def answer(keys: pd.DataFrame) -> pd.Series:
        return keys["c_mktsegment"].str.lower()

    return resolve.resolve_with_callable(c, ["c_mktsegment"], answer).select("c_custkey", "match")


@register("resumable_resolver", """
WITH k AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || c_nationkey AS match, CAST(NULL AS VARCHAR)
  AS resolve_error, (SELECT count(*) FROM k) AS answered FROM customer
""")
def q_resumable_resolver(spark, sf):
    """J13 + X4: a resolver's answers kept in a table; the second call finds them all there and asks nothing."""
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    path = _folder(spark, "answers")
    keys = ["c_nationkey", "c_mktsegment"]

    def answer(asked: pd.DataFrame) -> pd.Series:
        return asked["c_mktsegment"].str.lower() + " " + asked["c_nationkey"].astype(str)

    def unreachable(asked: pd.DataFrame) -> pd.Series:
        raise RuntimeError("asked again")

    resolve_resumable(c, keys, answer, path)
    out = resolve_resumable(c, keys, unreachable, path, tries=1)
    kept = read_answers(spark, path, [c.schema[k] for k in keys]).agg(F.count("*").alias("answered"))
    return out.select("c_custkey", "match", "resolve_error").join(kept)  # one row


@register("embedding_hook", """
SELECT item_id, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS n_e FROM benchmark
""")
def q_embedding_hook(spark, sf):
    """M1: a user's embedding function over a text column, in batches."""
    b = _t(spark, sf, "benchmark")
    v = embed_with(b, "text", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts], "v")
    return v.select("item_id", F.col("v")[0].cast("int").alias("n_chars"), F.col("v")[1].cast("int").alias("n_e"))


@register("argmax_vectors", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS at FROM embeddings
""")
def q_argmax_vectors(spark, sf):
    """T4: place of the largest element."""
    return _t(spark, sf, "embeddings").select("vec_id", lists.argmax("embedding").alias("at"))
