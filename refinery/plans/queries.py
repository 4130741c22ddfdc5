"""Registered queries over the driver tables, each with its DuckDB oracle.

Each query exercises one operator family of the library on whole tables.  The
driver tables have no nulls, NaNs or messy text, so several queries inject
them with deterministic ``CASE`` rules that the oracle repeats verbatim.
Doubles are rounded to 6 places and lists rendered as strings on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery import functions as RF
from refinery.features import encoders as E
from refinery.operators import counts, dedup, grouping, joins, resolve, tables
from refinery.session import read_table, spread

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def _r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ flagship
def return_flag_lists(spark, sf) -> DataFrame:
    """J1 + D1 + J5: orders with the ordered list of their lines' return flags."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    flags = grouping.ordered_list(lines, "l_orderkey", "l_returnflag", ["l_returnflag"], alias="return_flags")
    return joins.join_grouped(orders, flags, "o_orderkey", "l_orderkey", ["return_flags"])


@register("flagship_return_flags", """
WITH f AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_returnflag) AS fl FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus,
  CAST(coalesce(list_contains(fl, 'A'), false) AS INTEGER) AS return_flags_a,
  CAST(coalesce(list_contains(fl, 'N'), false) AS INTEGER) AS return_flags_n,
  CAST(coalesce(list_contains(fl, 'R'), false) AS INTEGER) AS return_flags_r
FROM orders LEFT JOIN f ON o_orderkey = l_orderkey
""")
def q_flagship(spark, sf):
    """Minimum slice: integrate, aggregate lists, multi-label one-hot (E5, all items)."""
    df = return_flag_lists(spark, sf)
    # the items of the lists are the lines of the orders, so the fit counts the lines
    lines = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    items = lines.groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return E.MultiLabelEncoder(column="return_flags").fit_counts(items).transform(df)


# ------------------------------------------------------------------ hygiene
@register("load_keyed_latest", """
SELECT user_id, event_id, ts, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE user_id IS NOT NULL) WHERE rn = 1
""")
def q_load_keyed_latest(spark, sf):
    ev = tables.require_not_null(_t(spark, sf, "events"), "user_id")
    ev = tables.cast_key(ev, "user_id", "bigint").select("user_id", "event_id", "ts", "event_type", "value")
    out = dedup.latest_per_key(ev, "user_id", "ts", tie_break=["event_id"])
    return out.withColumn("value", _r6(F.col("value")))


@register("row_dedup", """
SELECT max(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority
FROM orders GROUP BY o_orderstatus, o_orderpriority
""")
def q_row_dedup(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return dedup.row_dedup(o, "o_orderkey", "o_orderstatus")


@register("null_marker_clean", r"""
SELECT doc_id,
  CASE WHEN regexp_matches(raw, '\\+N') THEN NULL ELSE raw END AS source_clean
FROM (SELECT doc_id, CASE k WHEN 0 THEN '\N' WHEN 1 THEN 'x\\\N y' WHEN 2 THEN 'N' || source
                         ELSE source END AS raw
      FROM (SELECT doc_id, source, doc_id % 4 AS k FROM documents))
""")
def q_null_marker_clean(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source")
    raw = (F.when(F.col("doc_id") % 4 == 0, F.lit("\\N")).when(F.col("doc_id") % 4 == 1, F.lit("x\\\\\\N y"))
           .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("N"), F.col("source"))).otherwise(F.col("source")))
    d = d.select("doc_id", raw.alias("source_clean"))
    return tables.clean_null_markers(d, exclude=["doc_id"])


@register("strict_projection", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price FROM orders
""")
def q_strict_projection(spark, sf):
    """P1 + P4: rename and keep mapped columns in map order (missing = error)."""
    o = _t(spark, sf, "orders")
    return tables.rename_and_keep(o, {"o_orderkey": "order_id", "o_custkey": "customer_id",
                                      "o_totalprice": "total_price"})


# ------------------------------------------------------------------ joins
@register("join_inner_prefix", """
SELECT o.*, l.l_partkey AS wh_l_partkey, l.l_suppkey AS wh_l_suppkey, l.l_linenumber AS wh_l_linenumber,
  l.l_quantity AS wh_l_quantity, l.l_extendedprice AS wh_l_extendedprice, l.l_discount AS wh_l_discount,
  l.l_tax AS wh_l_tax, l.l_returnflag AS wh_l_returnflag, l.l_linestatus AS wh_l_linestatus,
  l.l_shipdate AS wh_l_shipdate
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
""")
def q_join_inner_prefix(spark, sf):
    return joins.join_prefixed(_t(spark, sf, "orders"), _t(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "wh_")


@register("join_left_string_key", """
SELECT o_orderkey, o_totalprice, c.l_orderkey, c.n_lines
FROM orders LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, count(*) AS n_lines
                       FROM lineitem GROUP BY l_orderkey) c
  ON CAST(o_orderkey AS VARCHAR) = c.l_orderkey
""")
def q_join_left_string_key(spark, sf):
    li = _t(spark, sf, "lineitem")
    cnt = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    cnt = tables.cast_key(cnt, "l_orderkey", "string")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return joins.join_on_string_key(o, cnt, "o_orderkey", "l_orderkey")


@register("lookup_guarded", """
SELECT c_custkey, c_name, n_name, n_regionkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def q_lookup_guarded(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return joins.guarded_lookup(c, n, "c_nationkey", "n_nationkey").drop("c_nationkey")


@register("join_group_list", """
WITH g AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts,
                  count(*) AS n_parts
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(parts, '') AS parts, CAST(coalesce(n_parts, 0) AS INTEGER) AS n_parts
FROM orders LEFT JOIN g ON o_orderkey = l_orderkey
""")
def q_join_group_list(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    g = grouping.ordered_list(li, "l_orderkey", "l_partkey", ["l_partkey"], alias="parts_list")
    o = _t(spark, sf, "orders").select("o_orderkey")
    j = joins.join_grouped(o, g, "o_orderkey", "l_orderkey", ["parts_list"])
    return j.select("o_orderkey", F.array_join(F.transform("parts_list", lambda x: x.cast("string")), ",").alias("parts"),
                    F.size("parts_list").alias("n_parts"))


@register("group_list", """
SELECT l_orderkey,
  string_agg(coalesce(v, 'NULL'), ',' ORDER BY v ASC NULLS FIRST) AS flags,
  CAST(count(*) AS INTEGER) AS n_items,
  CAST(count(*) - count(v) AS INTEGER) AS n_null
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS v FROM lineitem)
GROUP BY l_orderkey
""")
def q_group_list(spark, sf):
    """D1 with nulls kept and duplicates kept."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("R")).alias("v"))
    g = grouping.ordered_list(li, "l_orderkey", "v", ["v"], alias="items")
    return g.select("l_orderkey", F.array_join("items", ",", "NULL").alias("flags"), F.size("items").alias("n_items"),
                    F.size(F.filter("items", lambda x: x.isNull())).alias("n_null"))


@register("link_labels", """
SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def q_link_labels(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = _t(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return joins.link_join(li, p, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_brand")


def _nation_codes(spark, sf) -> DataFrame:
    """A country-like dimension derived from ``nation``: name, 2- and 3-letter codes."""
    n = _t(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name"),
                    F.concat(F.lit("N"), F.char(F.col("n_nationkey") + 65)).alias("iso2"),
                    F.concat(F.lit("X"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
                    ((F.col("n_regionkey") + 1) * 1000000 + F.col("n_nationkey")).cast("bigint").alias("population"))


_NATION_CODES_SQL = """(SELECT n_name AS name, 'N' || chr(n_nationkey + 65) AS iso2,
   'X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3,
   CAST((n_regionkey + 1) * 1000000 + n_nationkey AS BIGINT) AS population FROM nation)"""

_RAW_COUNTRY_SQL = """(SELECT DISTINCT CASE c_custkey % 4
     WHEN 0 THEN '  ' || lower(n_name) || ' '
     WHEN 1 THEN lower('N' || chr(n_nationkey + 65))
     WHEN 2 THEN lower('X' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'))
     ELSE 'unknown_' || CAST(c_custkey % 7 AS VARCHAR) END AS raw
   FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@register("dim_lookup_precedence", f"""
WITH d AS {_NATION_CODES_SQL}, r AS {_RAW_COUNTRY_SQL}
SELECT raw, coalesce(d1.iso3, d2.iso3, d3.iso3) AS iso3
FROM r LEFT JOIN d d1 ON strip_accents(lower(trim(raw))) = strip_accents(lower(trim(d1.name)))
       LEFT JOIN d d2 ON upper(trim(raw)) = d2.iso2
       LEFT JOIN d d3 ON upper(trim(raw)) = d3.iso3
""")
def q_dim_lookup_precedence(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
           .when(k == 1, F.lower(F.concat(F.lit("N"), F.char(F.col("n_nationkey") + 65))))
           .when(k == 2, F.lower(F.concat(F.lit("X"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))))
           .otherwise(F.concat(F.lit("unknown_"), (F.col("c_custkey") % 7).cast("string"))))
    vals = c.select(raw.alias("raw"))
    return resolve.precedence_lookup(vals, "raw", _nation_codes(spark, sf), "name", "iso2", "iso3")


@register("dim_population", f"""
SELECT s_suppkey, s_name, d.population FROM supplier
LEFT JOIN (SELECT n_nationkey, CAST((n_regionkey + 1) * 1000000 + n_nationkey AS BIGINT) AS population FROM nation) d
  ON s_nationkey = d.n_nationkey
""")
def q_dim_population(spark, sf):
    n = _t(spark, sf, "nation").select(
        "n_nationkey", ((F.col("n_regionkey") + 1) * 1000000 + F.col("n_nationkey")).cast("bigint").alias("population"))
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return joins.guarded_lookup(s, n, "s_nationkey", "n_nationkey").drop("s_nationkey")


@register("two_key_lookup", """
SELECT o_orderkey, d.avg_price FROM orders LEFT JOIN (
  SELECT o_orderstatus AS st, o_orderpriority AS pr, round(avg(o_totalprice), 6) AS avg_price
  FROM orders GROUP BY 1, 2) d ON o_orderstatus = d.st AND o_orderpriority = d.pr
""")
def q_two_key_lookup(spark, sf):
    o = _t(spark, sf, "orders")
    dim = o.groupBy("o_orderstatus", "o_orderpriority").agg(_r6(F.avg("o_totalprice")).alias("avg_price"))
    return joins.guarded_lookup(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), dim,
                                ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "avg_price")


@register("three_key_lookup", """
SELECT p_partkey, d.agglomeration FROM part LEFT JOIN (
  SELECT DISTINCT p_brand AS b, p_type AS t, p_size AS s,
    CASE WHEN p_size > 25 THEN p_brand || '/' || p_type ELSE NULL END AS agglomeration FROM part) d
  ON p_brand = d.b AND p_type = d.t AND p_size = d.s
""")
def q_three_key_lookup(spark, sf):
    p = _t(spark, sf, "part")
    dim = p.select("p_brand", "p_type", "p_size", F.when(F.col("p_size") > 25, F.concat_ws("/", "p_brand", "p_type"))
                   .alias("agglomeration")).distinct()
    return joins.guarded_lookup(p.select("p_partkey", "p_brand", "p_type", "p_size"), dim,
                                ["p_brand", "p_type", "p_size"]).select("p_partkey", "agglomeration")


@register("frequency_lookup_null_safe", """
WITH f AS (SELECT b, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN NULL ELSE p_brand END AS b FROM part) GROUP BY b)
SELECT p_partkey, CAST(coalesce(f.n, 0) AS BIGINT) AS brand_rows
FROM (SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE p_brand END AS b FROM part) x
LEFT JOIN f ON x.b IS NOT DISTINCT FROM f.b
""")
def q_frequency_lookup_null_safe(spark, sf):
    """Null-safe value lookup (null keys match the null row)."""
    p = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 5, F.lit(None)).otherwise(
        F.col("p_brand")).alias("b"))
    f = p.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    j = joins.null_safe_lookup(p, f, "b")
    return j.select("p_partkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("brand_rows"))


# ------------------------------------------------------------------ scalars
@register("hire_rate", """
WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r
           FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o_orderkey,
        CAST(coalesce(r, 0) + CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS filled,
        CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE coalesce(n, 0) END AS DOUBLE) AS posted
      FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
SELECT o_orderkey, round(CASE WHEN posted = 0 OR filled / posted IS NULL THEN 0.0
                              ELSE least(greatest(filled / posted, 0.0), 1.0) END, 6) AS hire_rate
FROM x
""")
def q_hire_rate(spark, sf):
    li = _t(spark, sf, "lineitem")
    c = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = _t(spark, sf, "orders").select("o_orderkey")
    x = o.join(c, o.o_orderkey == c.l_orderkey, "left")
    filled = F.coalesce("r", F.lit(0)) + F.when(F.col("o_orderkey") % 11 == 0, 3).otherwise(0)
    posted = F.when(F.col("o_orderkey") % 13 == 0, F.lit(0)).otherwise(F.coalesce("n", F.lit(0)))
    return x.select("o_orderkey", _r6(RF.safe_ratio(filled, posted)).alias("hire_rate"))


@register("duration_hours", """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_linenumber = 1 THEN NULL
             ELSE date_diff('microsecond', o_orderdate, l_shipdate) / 3.6e9 END, 6) AS wh_duration
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def q_duration_hours(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    end = F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", _r6(RF.hours_between("o_orderdate", end)).alias("wh_duration"))


@register("experience_months", """
SELECT o_orderkey, CAST((2024 - year(o_orderdate)) * 12 + (12 - month(o_orderdate)) AS INTEGER) AS experience_months
FROM orders
""")
def q_experience_months(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", RF.calendar_months_since("o_orderdate", "2024-12-01").cast("int")
                    .alias("experience_months"))


@register("timestamp_coerce", """
SELECT event_id, TRY_CAST(txt AS TIMESTAMP) AS parsed FROM (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not a date'
                        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM events)
""")
def q_timestamp_coerce(spark, sf):
    ev = _t(spark, sf, "events")
    txt = F.when(F.col("event_id") % 10 == 0, F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", RF.parse_timestamp_coerce(txt).alias("parsed"))


@register("conditional_budget", """
SELECT o_orderkey,
  round(CASE WHEN st = 'F' THEN o_totalprice ELSE o_totalprice * 0.5 END, 6) AS budget_min,
  round(CASE WHEN st = 'F' THEN o_totalprice ELSE o_totalprice * 2.0 END, 6) AS budget_max,
  CASE WHEN st = 'F' THEN 'PROJECT' ELSE o_orderpriority END AS engagement_type
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS st FROM orders)
""")
def q_conditional_budget(spark, sf):
    o = _t(spark, sf, "orders").withColumn("st", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    p = F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        _r6(RF.when_equals("st", "F", p, p * 0.5)).alias("budget_min"),
        _r6(RF.when_equals("st", "F", p, p * 2.0)).alias("budget_max"),
        RF.when_equals("st", "F", F.lit("PROJECT"), F.col("o_orderpriority")).alias("engagement_type"))


@register("value_replace", """
SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'MACHINERY' THEN 'INDUSTRY'
                  ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def q_value_replace(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return tables.replace_values(c, "c_mktsegment", {"HOUSEHOLD": "HOME", "MACHINERY": "INDUSTRY"})


_TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all(lower({x}), '([a-z]+|[^a-z]+)'), "
              "lambda t: CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END), '')")


@register("title_case", f"""
SELECT p_partkey, {_TITLE_SQL.format(x="p_name || '-' || p_type || ' st. john''s'")} AS title,
  lower(replace(p_type || ' ' || p_brand, ' ', '_')) AS snake
FROM part
""")
def q_title_case(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey",
                    RF.title_case(F.concat_ws("", "p_name", F.lit("-"), "p_type", F.lit(" st. john's"))).alias("title"),
                    RF.snake_name(F.concat_ws(" ", "p_type", "p_brand")).alias("snake"))


@register("indel_similarity", """
WITH x AS (SELECT p_partkey, lower(p_name) AS a,
             lower(substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER)) || 'x' ||
                   substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 2)) AS b
           FROM part)
SELECT p_partkey, a, b, round(2.0 * list_reduce(
      list_transform(string_split(a, ''), lambda ch: [unicode(ch)::BIGINT]),
      lambda prev, chl: list_reduce(
          list_transform(range(1, length(b) + 1), lambda j: [j::BIGINT]),
          lambda row, jl: list_append(row, CASE WHEN unicode(substring(b, jl[1]::INT, 1)) = chl[1]
                                   THEN prev[jl[1]] + 1 ELSE greatest(prev[jl[1] + 1], row[jl[1]]) END),
          [0::BIGINT]),
      list_transform(range(0, length(b) + 1), lambda z: 0::BIGINT))[-1] / (length(a) + length(b)), 6) AS score
FROM x
""")
def q_indel_similarity(spark, sf):
    """F5 on each part name against a one-letter substitution of itself."""
    p = spread(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")  # per-row DP: use every core
    b = F.lower(F.concat(F.expr("substr(p_name, 1, CAST(p_partkey % length(p_name) AS INT))"), F.lit("x"),
                         F.expr("substr(p_name, CAST(p_partkey % length(p_name) AS INT) + 2)")))
    x = p.select("p_partkey", F.lower("p_name").alias("a"), b.alias("b"))
    return x.select("p_partkey", "a", "b", _r6(RF.indel_ratio("a", "b")).alias("score"))


# ------------------------------------------------------------------ counts
@register("value_counts", """
SELECT c_mktsegment AS value, count(*) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1
""")
def q_value_counts(spark, sf):
    return counts.value_counts(_t(spark, sf, "customer"), "c_mktsegment")


@register("value_shares", """
SELECT c_mktsegment AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1
""")
def q_value_shares(spark, sf):
    s = counts.value_shares(_t(spark, sf, "customer"), "c_mktsegment")
    return s.withColumn("share", _r6(F.col("share")))


@register("value_shares_with_null", """
SELECT v AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS v FROM customer) GROUP BY 1
""")
def q_value_shares_with_null(spark, sf):
    c = _t(spark, sf, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("v"))
    s = counts.value_shares(c, "v", dropna=False)
    return s.withColumn("share", _r6(F.col("share")))


_COMBO_LISTS_SQL = """(SELECT l_orderkey, list(l_linestatus || l_returnflag) AS items FROM lineitem GROUP BY 1)"""


def combo_lists(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem").select("l_orderkey", F.concat("l_linestatus", "l_returnflag").alias("combo"),
                                          "l_linenumber", "l_partkey")
    return grouping.ordered_list(li, "l_orderkey", "combo", ["combo"], alias="items")


@register("list_item_coverage", f"""
WITH f AS (SELECT item AS value, count(*) AS count FROM (SELECT unnest(items) AS item FROM {_COMBO_LISTS_SQL}) GROUP BY 1),
w AS (SELECT *, sum(count) OVER (ORDER BY count DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(count) OVER () AS total,
             row_number() OVER (ORDER BY count DESC, value) AS rn FROM f)
SELECT value, count, round(count / total, 6) AS ratio, round(cum / total, 6) AS cumulative_ratio
FROM w WHERE cum - count < 0.5 * total OR rn = 1
""")
def q_list_item_coverage(spark, sf):
    """D8 + W1 + W2: items kept by an inclusive 50% coverage cut."""
    # the items of all lists are the child rows: they are counted without building the lists
    li = _t(spark, sf, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("item"))
    out = counts.coverage_table(counts.value_counts(li, "item"), 0.5, inclusive=True)
    return out.select("value", "count", _r6(F.col("ratio")).alias("ratio"),
                      _r6(F.col("cumulative_ratio")).alias("cumulative_ratio"))


@register("coverage_exclusive", """
WITH f AS (SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1),
w AS (SELECT *, sum(count) OVER (ORDER BY count DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(count) OVER () AS total FROM f)
SELECT value, count, round(count / total, 6) AS ratio, round(cum / total, 6) AS cumulative_ratio
FROM w WHERE cum < 0.7 * total
""")
def q_coverage_exclusive(spark, sf):
    """Categories whose running share stays below 70%."""
    out = counts.coverage_table(counts.value_counts(_t(spark, sf, "part"), "p_type"), 0.7, inclusive=False)
    return out.select("value", "count", _r6(F.col("ratio")).alias("ratio"),
                      _r6(F.col("cumulative_ratio")).alias("cumulative_ratio"))


@register("coverage_tokens", """
WITH f AS (SELECT t AS value, count(*) AS count FROM (
             SELECT unnest(regexp_split_to_array(lower(text), '[^\\pL]+')) AS t FROM documents)
           WHERE t <> '' GROUP BY 1),
w AS (SELECT *, sum(count) OVER (ORDER BY count DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(count) OVER () AS total FROM f)
SELECT value, count, round(cum / total, 6) AS cumulative_ratio FROM w WHERE cum - count < 0.8 * total
""")
def q_coverage_tokens(spark, sf):
    """W2 on a large vocabulary: the words of all documents up to 80% coverage."""
    docs = spread(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("t")).filter("t <> ''")
    out = counts.coverage_table(counts.value_counts(words, "t"), 0.8, inclusive=True)
    return out.select("value", "count", _r6(F.col("cumulative_ratio")).alias("cumulative_ratio"))


@register("top_k_share", """
WITH f AS (SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1),
t AS (SELECT *, sum(count) OVER () AS total FROM f ORDER BY count DESC, value LIMIT 40)
SELECT value, count, round(count / total, 6) AS ratio,
  round(sum(count) OVER (ORDER BY count DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / total, 6)
    AS cumulative_ratio
FROM t
""")
def q_top_k_share(spark, sf):
    """Share covered by the 40 most frequent part names (limit is the feature)."""
    out = counts.top_k_share(_t(spark, sf, "part"), "p_name", 40)
    return out.select("value", "count", _r6(F.col("ratio")).alias("ratio"),
                      _r6(F.col("cumulative_ratio")).alias("cumulative_ratio"))


@register("distinct_items", f"""
SELECT DISTINCT unnest(items) AS value FROM {_COMBO_LISTS_SQL}
""")
def q_distinct_items(spark, sf):
    return counts.distinct_items(combo_lists(spark, sf), "items")


@register("profile_columns", """
SELECT 'o_orderstatus' AS "column", count(*) FILTER (WHERE o_orderstatus IS NULL) AS nulls,
       count(o_orderstatus) AS non_nulls, count(DISTINCT o_orderstatus) AS "distinct" FROM orders
UNION ALL
SELECT 'o_orderpriority', count(*) FILTER (WHERE p IS NULL), count(p), count(DISTINCT p)
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p FROM orders)
UNION ALL
SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL), count(o_custkey), count(DISTINCT o_custkey) FROM orders
""")
def q_profile_columns(spark, sf):
    """Null / non-null / distinct counts in one aggregate pass."""
    o = _t(spark, sf, "orders").select("o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
                                       .alias("o_orderpriority"), "o_custkey")
    return counts.null_profile(o)


@register("describe_columns", """
SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean,
  round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS min,
  round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
  round(quantile_cont(o_totalprice, 0.75), 6) AS p75, max(o_totalprice) AS max FROM orders
UNION ALL
SELECT 'o_custkey', count(o_custkey), round(avg(o_custkey), 6), round(stddev_samp(o_custkey), 6),
  CAST(min(o_custkey) AS DOUBLE), round(quantile_cont(CAST(o_custkey AS DOUBLE), 0.25), 6),
  round(quantile_cont(CAST(o_custkey AS DOUBLE), 0.5), 6), round(quantile_cont(CAST(o_custkey AS DOUBLE), 0.75), 6),
  CAST(max(o_custkey) AS DOUBLE) FROM orders
""")
def q_describe_columns(spark, sf):
    """describe() statistics with interpolated quartiles."""
    d = counts.describe(_t(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return d.select("column", "count", *[_r6(F.col(c)).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75",
                                                                          "max"]])


@register("describe_ties", """
WITH x AS (SELECT l_quantity AS q, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_discount END AS d FROM lineitem)
SELECT 'q' AS "column", count(q) AS count, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS std, min(q) AS min,
  quantile_cont(q, 0.25) AS p25, quantile_cont(q, 0.5) AS p50, quantile_cont(q, 0.75) AS p75, max(q) AS max FROM x
UNION ALL
SELECT 'd', count(d), round(avg(d), 6), round(stddev_samp(d), 6), min(d), round(quantile_cont(d, 0.25), 6),
  round(quantile_cont(d, 0.5), 6), round(quantile_cont(d, 0.75), 6), max(d) FROM x WHERE NOT isnan(d)
""")
def q_describe_ties(spark, sf):
    """D15 on 50 distinct quantities (heavy ties) and on a column with NaN, which counts as missing."""
    li = _t(spark, sf, "lineitem")
    x = li.select(F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") == 2, F.lit(float("nan")))
                  .otherwise(F.col("l_discount")).alias("d"))
    d = counts.describe(x, ["q", "d"])
    return d.select("column", "count", *[_r6(F.col(c)).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75",
                                                                          "max"]])


@register("two_column_bins", """
SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS x_bin, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y_bin,
       count(*) AS count FROM lineitem GROUP BY 1, 2
""")
def q_two_column_bins(spark, sf):
    """Two-column extract binned in 2-D (the data behind a scatter plot)."""
    return counts.bin2d(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10, 10000)


# Further query families register themselves on import.
from refinery.plans import queries_encoding, queries_hygiene, queries_models, queries_resolution  # noqa: E402,F401
