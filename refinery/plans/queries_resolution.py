"""Registered entity-resolution queries (J10-J13, U1, U2) with their oracles.

The dimension is built from ``part``: each distinct ``(p_name, p_type)`` is a
canonical entity blocked by type, its popularity (row count) is the priority.
Queries are deterministic perturbations of every part row's name: one letter
deleted, one substituted, or the name upper-cased with padding (exact pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.functions.text import normalize_name
from refinery.operators import joins, resolve
from refinery.plans.queries import _TITLE_SQL, _r6, _t, register
from refinery.session import spread

_PERTURB_SQL = """CASE p_partkey % 3
     WHEN 0 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER)) ||
                 substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 2)
     WHEN 1 THEN substr(p_name, 1, CAST(p_partkey % length(p_name) AS INTEGER)) || 'q' ||
                 substr(p_name, CAST(p_partkey % length(p_name) AS INTEGER) + 2)
     ELSE ' ' || upper(p_name) || ' ' END"""

_RATIO_SQL = """2.0 * list_reduce(
      list_transform(string_split({a}, ''), lambda ch: [unicode(ch)::BIGINT]),
      lambda prev, chl: list_reduce(
          list_transform(range(1, length({b}) + 1), lambda j: [j::BIGINT]),
          lambda row, jl: list_append(row, CASE WHEN unicode(substring({b}, jl[1]::INT, 1)) = chl[1]
                                   THEN prev[jl[1]] + 1 ELSE greatest(prev[jl[1] + 1], row[jl[1]]) END),
          [0::BIGINT]),
      list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[-1] / (length({a}) + length({b}))"""

_BEST_SQL = f"""
d AS (SELECT lower(trim(p_name)) AS a, p_type AS blk, p_name AS canon, count(*) AS prio FROM part GROUP BY ALL),
q AS (SELECT DISTINCT {_PERTURB_SQL} AS raw, p_type AS blk FROM part),
s AS (SELECT q.raw, q.blk, d.canon, d.prio, {_RATIO_SQL.format(a="lower(trim(q.raw))", b="d.a")} AS score
      FROM q JOIN d ON q.blk = d.blk),
b AS (SELECT raw, blk, canon, score,
             row_number() OVER (PARTITION BY raw, blk ORDER BY score DESC, prio DESC, canon) AS rn
      FROM s WHERE score > 0.8),
best AS (SELECT q.raw AS name, q.blk AS block, b.canon AS match, b.score AS score
         FROM q LEFT JOIN b ON q.raw = b.raw AND q.blk = b.blk AND b.rn = 1)"""


def _perturbed(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    pos = "CAST(p_partkey % length(p_name) AS INT)"
    k = F.col("p_partkey") % 3
    raw = (F.when(k == 0, F.expr(f"concat(substr(p_name, 1, {pos}), substr(p_name, {pos} + 2))"))
           .when(k == 1, F.expr(f"concat(substr(p_name, 1, {pos}), 'q', substr(p_name, {pos} + 2))"))
           .otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))))
    return p.select(raw.alias("name"), F.col("p_type").alias("block"), "p_partkey", "p_size", "p_name")


def _dimension(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    return p.groupBy(normalize_name(F.col("p_name")).alias("alias"), F.col("p_type").alias("block"),
                     F.col("p_name").alias("canonical")).agg(F.count(F.lit(1)).alias("population"))


def best_matches(spark, sf) -> DataFrame:
    return resolve.fuzzy_best_match(_perturbed(spark, sf), "name", "block", _dimension(spark, sf), threshold=0.80)


@register("fuzzy_best_match", f"""
WITH {_BEST_SQL}
SELECT name, block, match, round(score, 6) AS score FROM best
""")
def q_fuzzy_best_match(spark, sf):
    """J10 + W5: best alias per distinct (name, block) above 0.80 Indel similarity."""
    return best_matches(spark, sf).withColumn("score", _r6(F.col("score")))


@register("confidence_split", f"""
WITH {_BEST_SQL}
SELECT name, block, match, round(score, 6) AS score,
       CASE WHEN score >= 0.88 THEN 'accepted' ELSE 'fallback' END AS route FROM best
""")
def q_confidence_split(spark, sf):
    """Accept at >= 0.88, everything else (null score included) to the fallback."""
    acc, rest = resolve.confidence_split(best_matches(spark, sf), 0.88)
    out = acc.withColumn("route", F.lit("accepted")).unionByName(rest.withColumn("route", F.lit("fallback")))
    return out.withColumn("score", _r6(F.col("score")))


_RESOLUTION_SQL = f"""(SELECT {_PERTURB_SQL} AS old_name, p_type AS country,
   CASE WHEN p_size <= 10 THEN '' WHEN p_size <= 20 THEN '""' ELSE p_name || ' city' END AS new_name FROM part)"""


def _resolutions(spark, sf) -> DataFrame:
    p = _perturbed(spark, sf)
    ans = (F.when(F.col("p_size") <= 10, F.lit("")).when(F.col("p_size") <= 20, F.lit('""'))
           .otherwise(F.concat("p_name", F.lit(" city"))))
    return p.select(F.col("name").alias("old_name"), F.col("block").alias("country"), ans.alias("new_name"))


@register("fallback_resolve", f"""
WITH {_BEST_SQL},
r AS (SELECT old_name, country, max(new_name) AS ans FROM {_RESOLUTION_SQL} GROUP BY 1, 2),
fb AS (SELECT name, block, CASE WHEN trim(r.ans) IN ('', '""', '''''') OR r.ans IS NULL THEN NULL
                          ELSE {_TITLE_SQL.format(x="lower(trim(r.ans))")} END AS resolved
       FROM best LEFT JOIN r ON best.name = r.old_name AND best.block = r.country
       WHERE NOT coalesce(best.score >= 0.88, false))
SELECT name, block, match AS resolved FROM best WHERE coalesce(score >= 0.88, false)
UNION ALL SELECT name, block, resolved FROM fb
""")
def q_fallback_resolve(spark, sf):
    """J12 + F13 + U2: residue resolved by a resolution table; union with accepted matches."""
    acc, rest = resolve.confidence_split(best_matches(spark, sf), 0.88)
    fb = resolve.fallback_resolve(rest, ["name", "block"], _resolutions(spark, sf), ["old_name", "country"],
                                  answer_col="new_name", out_col="resolved")
    return resolve.accepted_union(acc.withColumnRenamed("match", "resolved"), fb, ["name", "block", "resolved"])


_TRIPLE_SQL = """(SELECT p_partkey, p_brand AS city,
   CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 3 AS VARCHAR) END AS state, p_type AS country,
   CASE WHEN p_retailprice > 1500 THEN 'metro ' || lower(p_brand) ELSE NULL END AS agglomeration FROM part)"""


@register("agglomeration_resolve", f"""
WITH t AS {_TRIPLE_SQL},
r AS (SELECT city, state, country, max(agglomeration) AS ans FROM t GROUP BY ALL),
m AS (SELECT d.city, d.state, d.country,
             CASE WHEN trim(r.ans) IN ('', '""', '''''') OR r.ans IS NULL THEN NULL
                  ELSE {_TITLE_SQL.format(x="lower(trim(r.ans))")} END AS agglomeration
      FROM (SELECT DISTINCT city, state, country FROM t) d
      LEFT JOIN r ON d.city = r.city AND d.state IS NOT DISTINCT FROM r.state AND d.country = r.country)
SELECT t.p_partkey, m.agglomeration FROM t
LEFT JOIN m ON t.city = m.city AND t.state IS NOT DISTINCT FROM m.state AND t.country = m.country
""")
def q_agglomeration_resolve(spark, sf):
    """J13 + J9: resolve distinct (city, state, country) triples (null-safe state), join back."""
    p = _t(spark, sf, "part")
    t = p.select("p_partkey", F.col("p_brand").alias("city"),
                 F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise((F.col("p_size") % 3).cast("string"))
                 .alias("state"), F.col("p_type").alias("country"),
                 F.when(F.col("p_retailprice") > 1500, F.concat(F.lit("metro "), F.lower("p_brand")))
                 .alias("agglomeration"))
    triples = t.select("city", "state", "country").distinct()
    res = t.select("city", "state", "country", "agglomeration")
    mapped = resolve.fallback_resolve(triples, ["city", "state", "country"], res, answer_col="agglomeration",
                                      out_col="agglomeration", null_safe=["state"])
    cond = [t.city == mapped.city, t.state.eqNullSafe(mapped.state), t.country == mapped.country]
    return t.select("p_partkey", "city", "state", "country").join(
        joins.checked_broadcast(mapped), cond, "left").select(t.p_partkey, mapped.agglomeration)


_WORDS_SQL = "unnest(regexp_split_to_array(lower(text), '[^\\pL]+'))"


@register("vocab_union", f"""
SELECT token FROM (SELECT {_WORDS_SQL} AS token FROM documents
                   UNION SELECT {_WORDS_SQL} AS token FROM benchmark) WHERE length(token) > 0
""")
def q_vocab_union(spark, sf):
    """Distinct word vocabulary across two text tables (whole texts)."""
    def words(df):
        # Whole texts are split on every core, then tokens are de-duplicated by shuffle.
        return spread(df.select("text")).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token"))
    u = words(_t(spark, sf, "documents")).union(words(_t(spark, sf, "benchmark"))).distinct()
    return u.filter(F.length("token") > 0)
