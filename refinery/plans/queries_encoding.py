"""Registered encoder queries (E1-E7) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from refinery.features import encoders as E
from refinery.features.sparse import IndexEncoder
from refinery.operators import grouping
from refinery.plans.queries import _r6, _t, combo_lists, register
from refinery.session import cut_lineage

_NUM_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Infinity'::DOUBLE
                              WHEN p_partkey % 10 = 1 THEN NULL
                              WHEN p_partkey % 10 = 2 THEN 'NaN'::DOUBLE
                              WHEN p_partkey % 10 = 3 THEN '-Infinity'::DOUBLE
                              ELSE p_retailprice END AS v FROM part)"""
_FINITE = "(v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"


def _num_input(spark, sf):
    p = _t(spark, sf, "part")
    k = F.col("p_partkey") % 10
    v = (F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(None).cast("double"))
         .when(k == 2, F.lit(float("nan"))).when(k == 3, F.lit(float("-inf"))).otherwise(F.col("p_retailprice")))
    return p.select("p_partkey", v.alias("v"))


def _scaled(kind):
    def q(spark, sf):
        df = _num_input(spark, sf)
        out = E.NumericScaler(column="v", kind=kind).fit(df).transform(df)
        return out.select("p_partkey", _r6(F.col("v")).alias("v"))
    q.__doc__ = f"E3: {kind} scaling with NaN/inf/null injected (non-finite -> 0 after scaling)."
    return q


register("scale_standard", f"""
WITH x AS {_NUM_SQL}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM x WHERE {_FINITE})
SELECT p_partkey, round(CASE WHEN {_FINITE} THEN (v - (SELECT m FROM s)) /
   (SELECT CASE WHEN sd = 0 OR sd IS NULL THEN 1.0 ELSE sd END FROM s) ELSE 0.0 END, 6) AS v FROM x
""")(_scaled("standard"))

register("scale_minmax", f"""
WITH x AS {_NUM_SQL}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM x WHERE {_FINITE})
SELECT p_partkey, round(CASE WHEN {_FINITE} THEN (v - (SELECT lo FROM s)) /
   (SELECT CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END FROM s) ELSE 0.0 END, 6) AS v FROM x
""")(_scaled("minmax"))

register("scale_robust", f"""
WITH x AS {_NUM_SQL},
s AS (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM x WHERE {_FINITE})
SELECT p_partkey, round(CASE WHEN {_FINITE} THEN v /
   (SELECT CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END FROM s) ELSE 0.0 END, 6) AS v FROM x
""")(_scaled("robust"))


@register("mode_impute", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS p
           FROM orders),
m AS (SELECT p FROM x WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
SELECT o_orderkey, coalesce(x.p, (SELECT p FROM m)) AS o_orderpriority FROM x
""")
def q_mode_impute(spark, sf):
    """Fill nulls with the mode (ties -> smallest value)."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
                                       .alias("o_orderpriority"))
    return E.ModeImputer(column="o_orderpriority").fit(o).transform(o)


@register("majority_bool", """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE NULL END AS f
           FROM orders),
m AS (SELECT coalesce(avg(CAST(f AS INTEGER)) >= 0.5, false) AS maj FROM x)
SELECT o_orderkey, CAST(coalesce(f, (SELECT maj FROM m)) AS INTEGER) AS is_filled FROM x
""")
def q_majority_bool(spark, sf):
    """Null -> majority value, emitted as 0/1."""
    st = F.col("o_orderstatus")
    f = F.when(st == "F", F.lit(True)).when(st == "O", F.lit(False))
    o = _t(spark, sf, "orders").select("o_orderkey", f.alias("is_filled"))
    return E.BooleanEncoder(column="is_filled").fit(o).transform(o)


@register("onehot_threshold", """
WITH x AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS s FROM customer),
f AS (SELECT s AS value, count(*) AS n FROM x WHERE s IS NOT NULL GROUP BY 1),
w AS (SELECT value, sum(n) OVER (ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(n) OVER () AS total FROM f),
sel AS (SELECT value FROM w WHERE cum < 0.6 * total)
SELECT c_custkey,
  CAST(coalesce(s = 'MACHINERY' AND 'MACHINERY' IN (SELECT value FROM sel), false) AS INTEGER) AS c_mktsegment_machinery,
  CAST(coalesce(s = 'FURNITURE' AND 'FURNITURE' IN (SELECT value FROM sel), false) AS INTEGER) AS c_mktsegment_furniture,
  CAST(s IS NULL OR s NOT IN (SELECT value FROM sel) AS INTEGER) AS c_mktsegment_others
FROM x
""")
def q_onehot_threshold(spark, sf):
    """E4 with an exclusive 60% coverage cut; null counts as 'others'."""
    c = _t(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD"))
                                         .alias("c_mktsegment"))
    return E.OneHotEncoder(column="c_mktsegment", threshold=0.6).fit(c).transform(c)


@register("onehot_all", """
WITH x AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS t FROM part)
SELECT p_partkey,
  CAST(coalesce(t = 'ECONOMY', false) AS INTEGER) AS p_type_economy,
  CAST(coalesce(t = 'LARGE', false) AS INTEGER) AS p_type_large,
  CAST(coalesce(t = 'MEDIUM', false) AS INTEGER) AS p_type_medium,
  CAST(coalesce(t = 'SMALL', false) AS INTEGER) AS p_type_small,
  CAST(coalesce(t = 'STANDARD', false) AS INTEGER) AS p_type_standard
FROM x
""")
def q_onehot_all(spark, sf):
    """E4 without threshold: every non-null category, null -> all zeros."""
    p = _t(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("p_type"))
    return E.OneHotEncoder(column="p_type").fit(p).transform(p)


@register("multilabel_onehot", """
WITH l AS (SELECT l_orderkey, list(l_linestatus || l_returnflag) AS items FROM lineitem GROUP BY 1),
f AS (SELECT item AS value, count(*) AS n FROM (SELECT unnest(items) AS item FROM l) GROUP BY 1),
w AS (SELECT value, n, sum(n) OVER (ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, value) AS rn FROM f),
sel AS (SELECT value FROM w WHERE cum - n < 0.5 * total OR rn = 1)
SELECT l_orderkey,
  CAST(list_contains(items, 'OR') AND 'OR' IN (SELECT value FROM sel) AS INTEGER) AS items_or,
  CAST(list_contains(items, 'OA') AND 'OA' IN (SELECT value FROM sel) AS INTEGER) AS items_oa,
  CAST(list_contains(items, 'FR') AND 'FR' IN (SELECT value FROM sel) AS INTEGER) AS items_fr,
  CAST(len(list_distinct(items)) > len(list_intersect(list_distinct(items), (SELECT list(value) FROM sel)))
       AS INTEGER) AS items_others
FROM l
""")
def q_multilabel_onehot(spark, sf):
    """E5 with an inclusive 50% coverage cut and the 'others' indicator."""
    lists = cut_lineage(combo_lists(spark, sf))  # fitted and transformed: build once
    return E.MultiLabelEncoder(column="items", threshold=0.5).fit(lists).transform(lists)


@register("ordinal_auto", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS p
           FROM orders),
m AS (SELECT p FROM x WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
k AS (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT p FROM x WHERE p IS NOT NULL))
SELECT o_orderkey, k.code AS o_orderpriority FROM x JOIN k ON coalesce(x.p, (SELECT p FROM m)) = k.p
""")
def q_ordinal_auto(spark, sf):
    """Sorted distinct values numbered from 0; nulls take the mode first."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM"))
                                       .alias("o_orderpriority"))
    return E.OrdinalEncoder(column="o_orderpriority").fit(o).transform(o)


@register("ordinal_mapped", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders),
m AS (SELECT s FROM x WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT o_orderkey, CAST(CASE coalesce(s, (SELECT s FROM m)) WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END
                        AS INTEGER) AS o_orderstatus FROM x
""")
def q_ordinal_mapped(spark, sf):
    """E2 with an explicit mapping."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return E.OrdinalEncoder(column="o_orderstatus", mapping={"F": 1, "O": 2, "P": 3}).fit(o).transform(o)


@register("frequency_encode", """
WITH x AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE p_brand END AS b FROM part),
f AS (SELECT b, count(*) / (SELECT count(*) FROM x) AS share FROM x GROUP BY b)
SELECT p_partkey, round(coalesce(f.share, 0.0), 6) AS p_brand FROM x LEFT JOIN f ON x.b IS NOT DISTINCT FROM f.b
""")
def q_frequency_encode(spark, sf):
    """Share of rows per value, null included (null-safe lookup)."""
    p = _t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 5, F.lit(None))
                                     .otherwise(F.col("p_brand")).alias("p_brand"))
    out = E.FrequencyEncoder(column="p_brand").fit(p).transform(p)
    return out.select("p_partkey", _r6(F.col("p_brand")).alias("p_brand"))


@register("onehot_indices", """
WITH f AS (SELECT c_name AS value, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1),
m AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS i FROM f),
b AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),
w AS (SELECT value, n, sum(n) OVER (ORDER BY n DESC, value) AS cum, sum(n) OVER () AS total FROM b),
k AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS i FROM w WHERE cum < 0.5 * total)
SELECT 'customer' AS t, c_custkey AS id, CAST((SELECT count(*) FROM m) AS INTEGER) AS width, CAST(m.i AS BIGINT) AS place
FROM customer LEFT JOIN m ON c_name = value AND c_custkey % 5 <> 0
UNION ALL
SELECT 'part', p_partkey, CAST((SELECT count(*) FROM k) + 1 AS INTEGER), coalesce(k.i, (SELECT count(*) FROM k))
FROM part LEFT JOIN k ON p_brand = value
""")
def q_onehot_indices(spark, sf):
    """E4 as places in a sparse vector: every customer name (nulls have none), and brands up to half of all parts."""
    c = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("v"))
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("v"))
    out = []
    for name, df, key, threshold in (("customer", c, "c_custkey", None), ("part", p, "p_partkey", 0.5)):
        model = IndexEncoder("v", threshold).fit(df)
        out.append(model.transform(df).select(F.lit(name).alias("t"), F.col(key).cast("long").alias("id"),
                                              F.lit(model.getOrDefault(model.width)).alias("width"),
                                              F.try_element_at("v_indices", F.lit(1)).alias("place")))
    return out[0].unionByName(out[1])


@register("multilabel_indices", """
WITH l AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS items FROM lineitem GROUP BY 1),
f AS (SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS i FROM f),
u AS (SELECT l_orderkey, unnest(items) AS item FROM l)
SELECT l_orderkey, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS places
FROM u JOIN m ON item = value GROUP BY 1
""")
def q_multilabel_indices(spark, sf):
    """E5 as places in a sparse vector: the parts of an order, without a threshold."""
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    lists = cut_lineage(grouping.ordered_list(line, "l_orderkey", "l_partkey", ["l_partkey"], alias="parts"))
    out = IndexEncoder("parts").fit(lists).transform(lists)
    return out.select("l_orderkey", F.array_join(F.col("parts_indices").cast("array<string>"), ",").alias("places"))
