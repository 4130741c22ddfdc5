"""Entity resolution: dimension lookups by key precedence and fuzzy name matching.

Every resolver works on the *distinct* keys of the fact table and joins the
answer back, so the expensive part runs once per distinct name, not per row.

Fuzzy matching (J10) scores candidates by normalised Indel similarity
(``functions.similarity``) and keeps the best candidate above a threshold.
Candidate pairs come from a lossless **prefix filter** over character
multisets instead of all pairs within a block:

* LCS(a, b) <= |chars(a) ∩ chars(b)| (multiset overlap), and a similarity
  above ``t`` needs 2*LCS > t*(la + lb); with the length band this means an
  overlap of at least ``floor(t*la/(2-t)) + 1`` characters for any admissible
  partner of ``a``.
* Two multisets with overlap >= alpha share a token among the first
  ``|x| - alpha + 1`` tokens of each, under any fixed global token order
  (tokens = character + occurrence number).  Rare tokens go first, so common
  letters rarely meet in the join.

Names that equal an alias are settled by an equi-join first.  For the others
the join is an equi-join on ``(block, token)`` over short prefixes,
followed by a length-band test, a Levenshtein prefilter (Levenshtein <= Indel
distance), and the exact score.  Tested equal to brute force in
``tests/test_resolve.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions.similarity import indel_ratio, indel_upper_bound_ok
from refinery.functions.text import blank_to_null, code_key, display_name, normalize_name
from refinery.operators.joins import checked_broadcast
from refinery.session import cut_lineage


# --------------------------------------------------------------------------- J7
def precedence_lookup(values: DataFrame, value_col: str, dim: DataFrame, name_col: str, code2_col: str,
                      code3_col: str, out_col: str = "iso3") -> DataFrame:
    """Resolve raw names/codes to a canonical code by key precedence.

    Precedence: normalised name (1), then upper-cased 2-letter code (2), then
    upper-cased 3-letter code (3).  Returns ``(value_col, out_col)`` for the
    distinct values of ``values``; unresolved values get null.
    """
    keyed = (dim.select(normalize_name(F.col(name_col)).alias("_k"), F.lit(1).alias("_p"),
                        F.col(code3_col).alias("_iso3"))
             .unionByName(dim.select(code_key(F.col(code2_col)).alias("_k"), F.lit(2).alias("_p"),
                                     F.col(code3_col).alias("_iso3")))
             .unionByName(dim.select(code_key(F.col(code3_col)).alias("_k"), F.lit(3).alias("_p"),
                                     F.col(code3_col).alias("_iso3")))
             .groupBy("_k", "_p").agg(F.max("_iso3").alias("_iso3")))
    v = F.col(f"`{value_col}`")
    distinct = values.select(v).filter(v.isNotNull()).distinct()
    probes = distinct.select(
        v, F.inline(F.array(F.struct(normalize_name(v).alias("_k"), F.lit(1).alias("_p")),
                            F.struct(code_key(v).alias("_k"), F.lit(2).alias("_p")),
                            F.struct(code_key(v).alias("_k"), F.lit(3).alias("_p")))))
    hits = probes.join(checked_broadcast(keyed), ["_k", "_p"], "inner")
    best = hits.groupBy(v).agg(F.min_by("_iso3", "_p").alias(out_col))
    return distinct.join(best, value_col, "left")


# ------------------------------------------------------------------------- S6/S7
def country_dimension(countries: DataFrame, name_col: str = "name", translit: dict[str, str] | None = None
                      ) -> DataFrame:
    """A country table with its normalised-name comparison key (``name_key``)."""
    return countries.withColumn("name_key", normalize_name(F.col(name_col), translit))


def build_alias_dimension(cities: DataFrame, countries: DataFrame, min_population: int = 500,
                          exclusions: DataFrame | None = None, translit: dict[str, str] | None = None) -> DataFrame:
    """One row per ``(block, alias)`` from a city table with alternate names.

    ``cities``: ``geonameid, name, countrycode (iso2), population, alternatenames``.
    ``countries``: ``iso2, iso3``.  ``exclusions``: ``(geonameid, alias)`` pairs to
    remove.  Output: ``block (iso3), alias (normalised), canonical, population``;
    if an alias maps to several canonical names in a block all are kept and
    the matcher breaks the tie.
    """
    names = F.array_append(F.coalesce(F.col("alternatenames"), F.array().cast("array<string>")), F.col("name"))
    c = cities.filter(F.col("population") >= F.lit(min_population)).select(
        "geonameid", "countrycode", "population",
        F.col("name").alias("canonical_raw"), F.explode(names).alias("alias_raw"))
    if exclusions is not None:
        c = c.join(exclusions.select("geonameid", F.col("alias").alias("alias_raw")),
                   ["geonameid", "alias_raw"], "left_anti")
    iso = checked_broadcast(countries.select(F.col("iso2").alias("countrycode"), F.col("iso3").alias("block")))
    out = c.join(iso, "countrycode", "inner").select(
        "block", normalize_name(F.col("alias_raw"), translit).alias("alias"),
        display_name(F.col("canonical_raw"), translit).alias("canonical"), "population")
    return out.filter(F.length("alias") > 0).distinct()


# --------------------------------------------------------------------------- J10
def _tokens(col: F.Column) -> F.Column:
    """Characters tagged with their occurrence number: 'banana' -> b#1 a#1 n#1 a#2 n#2 a#3."""
    chars = F.filter(F.split(col, ""), lambda ch: F.length(ch) > 0)
    return F.transform(
        chars, lambda ch, i: F.concat(ch, F.lit("#"), (F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == ch))
                                                      ).cast("string")))


def _prefix_len(length: F.Column, threshold: float) -> F.Column:
    alpha = F.floor(F.lit(threshold) * length / F.lit(2.0 - threshold)) + 1
    return F.greatest(length - alpha + 1, F.lit(1))


def _prefixes(df: DataFrame, id_col: str, text_col: str, block_col: str, rank: DataFrame,
              threshold: float) -> DataFrame:
    toks = df.select(id_col, block_col, F.length(text_col).alias("_len"),
                     F.explode(_tokens(F.col(text_col))).alias("_tok"))
    # Global token order = (document frequency, token); unseen tokens first (df 0).
    ranked = toks.join(rank, "_tok", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    w = Window.partitionBy(id_col).orderBy("_df", "_tok")
    return (ranked.withColumn("_pos", F.row_number().over(w))
            .filter(F.col("_pos") <= _prefix_len(F.col("_len"), threshold))
            .select(id_col, block_col, "_len", "_tok"))


def fuzzy_best_match(queries: DataFrame, name_col: str, block_col: str, dim: DataFrame,
                     alias_col: str = "alias", dim_block_col: str = "block", canonical_col: str = "canonical",
                     priority_col: str | None = "population", threshold: float = 0.80,
                     normalize: bool = True, materialize: bool = True) -> DataFrame:
    """J10 + W5: best dimension entry per distinct ``(name, block)`` with score > threshold.

    Returns ``name_col, block_col, match, score`` for every distinct query pair;
    ``match``/``score`` are null when nothing clears the threshold.  Ties on
    score go to the larger ``priority_col``, then the smaller canonical name.
    """
    # Candidate tables are keyed by the exact natural keys (as structs), never by a hash.
    q = (queries.select(F.col(name_col).alias("_raw"), F.col(block_col).alias("_blk"))
         .filter(F.col("_raw").isNotNull()).distinct()
         .withColumn("_q", normalize_name(F.col("_raw")) if normalize else F.col("_raw"))
         .withColumn("_qid", F.struct("_raw", "_blk")))
    prio = F.col(priority_col) if priority_col else F.lit(0)
    d = (dim.select(F.col(alias_col).alias("_a"), F.col(dim_block_col).alias("_blk"),
                    F.col(canonical_col).alias("_canon"), prio.cast("double").alias("_prio"))
         .filter(F.col("_a").isNotNull())
         .groupBy("_a", "_blk", "_canon").agg(F.max("_prio").alias("_prio"))
         .withColumn("_did", F.struct("_a", "_blk", "_canon")))
    if materialize:
        # Both distinct-name tables are read three times below; compute each once.
        q, d = cut_lineage(q), cut_lineage(d)

    # Exact pass: a score of 1.0 cannot be beaten, so equal names need no candidates.
    worst = F.lit(0.0) - F.coalesce(F.col("_prio"), F.lit(float("-inf")))
    exact = (q.join(d, (F.col("_q") == F.col("_a")) & (q["_blk"] == d["_blk"])).groupBy("_qid")
             .agg(F.min(F.struct(worst.alias("p"), F.col("_canon").alias("c"))).alias("_m"))
             .select("_qid", F.col("_m.c").alias("match"), F.lit(1.0).alias("score")))
    if materialize:
        exact = cut_lineage(exact)
    everyone, q = q, q.join(exact.select("_qid"), "_qid", "left_anti")
    if materialize:
        q = cut_lineage(q)

    # Global token order: rare first (document frequency over the dimension),
    # ties by token.  No ranking window: each string orders its own tokens by
    # (df, token), which is the same total order everywhere.
    rank = (d.select(F.explode(F.array_distinct(_tokens(F.col("_a")))).alias("_tok"))
            .groupBy("_tok").agg(F.count(F.lit(1)).alias("_df")))
    rank = checked_broadcast(cut_lineage(rank))

    qp = _prefixes(q, "_qid", "_q", "_blk", rank, threshold)
    dp = _prefixes(d, "_did", "_a", "_blk", rank, threshold).withColumnRenamed("_len", "_dlen")
    t = float(threshold)
    cand = (qp.join(dp, ["_blk", "_tok"])
            .filter(F.least("_len", "_dlen") * 2 > F.lit(t) * (F.col("_len") + F.col("_dlen")))
            .select("_qid", "_did").distinct())
    pairs = (cand.join(q.select("_qid", "_q", "_blk"), "_qid")
             .join(d.select("_did", "_a", "_canon", "_prio"), "_did")
             .filter(indel_upper_bound_ok("_q", "_a", t))
             .withColumn("_score", indel_ratio("_q", "_a"))
             .filter(F.col("_score") > F.lit(t)))
    # Best = highest score, then highest priority, then smallest canonical name:
    # the minimum of (-score, -priority, name), one aggregate with partial merge.
    neg_prio = F.lit(0.0) - F.coalesce(F.col("_prio"), F.lit(float("-inf")))
    top = (pairs.groupBy("_qid")
           .agg(F.min(F.struct((F.lit(0.0) - F.col("_score")).alias("s"), neg_prio.alias("p"),
                               F.col("_canon").alias("c"))).alias("_m"))
           .select("_qid", F.col("_m.c").alias("match"), (F.lit(0.0) - F.col("_m.s")).alias("score")))
    return (everyone.join(exact.unionByName(top), "_qid", "left")
            .select(F.col("_raw").alias(name_col), F.col("_blk").alias(block_col), "match", "score"))


# ---------------------------------------------------------------------- J11-J13
def confidence_split(matches: DataFrame, accept: float = 0.88, score_col: str = "score",
                     materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, residue); a null score goes to the residue.

    Both halves read ``matches``; ``materialize`` checkpoints it once so the
    (expensive) matching is not run twice.
    """
    if materialize:
        matches = cut_lineage(matches)
    ok = F.coalesce(F.col(score_col) >= F.lit(accept), F.lit(False))
    return matches.filter(ok), matches.filter(~ok)


def fallback_resolve(residue: DataFrame, keys: Sequence[str], resolutions: DataFrame,
                     resolution_keys: Sequence[str] | None = None, answer_col: str = "new_name",
                     out_col: str = "match", null_safe: Sequence[str] = (),
                     normalize_answer: bool = True) -> DataFrame:
    """Resolve the residue by a user-supplied resolution table.

    Blank or quote-only answers become null; others are normalised for output
    (F2).  ``null_safe`` keys match null to null (e.g. an optional state).
    The resolution table is looked up once per distinct residue key.
    """
    rkeys = list(resolution_keys or keys)
    r = resolutions.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(rkeys)],
                           F.col(answer_col).alias("_ans"))
    r = r.groupBy(*[f"_r{i}" for i in range(len(rkeys))]).agg(F.max("_ans").alias("_ans"))
    cond = None
    for i, k in enumerate(keys):
        c = (residue[k].eqNullSafe(F.col(f"_r{i}")) if k in null_safe else residue[k] == F.col(f"_r{i}"))
        cond = c if cond is None else cond & c
    j = residue.join(checked_broadcast(r), cond, "left")
    ans = blank_to_null(F.col("_ans"))
    ans = display_name(ans) if normalize_answer else ans
    return j.withColumn(out_col, ans).drop("_ans", *[f"_r{i}" for i in range(len(rkeys))])


def resolve_with_callable(residue: DataFrame, keys: Sequence[str], resolver: Callable[[pd.DataFrame], pd.Series],
                          out_col: str = "match", batch_rows: int = 1000) -> DataFrame:
    """Run a user resolver on the distinct residue keys, in Arrow batches.

    ``resolver`` gets a pandas frame of key columns and returns one answer per
    row (None for unknown).  Failures of a batch become null answers plus an
    error text, never a name (R18).  Runs on executors; each distinct key is
    resolved once per attempt.
    """
    distinct = residue.select(*keys).distinct()
    # A fresh StructType: ``StructType.add`` would mutate the frame's cached schema.
    schema = T.StructType(list(distinct.schema.fields) + [T.StructField(out_col, T.StringType()),
                                                          T.StructField("resolve_error", T.StringType())])

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                chunk = pdf.iloc[start:start + batch_rows].copy()
                try:
                    ans = pd.Series(resolver(chunk[list(keys)]), index=chunk.index).astype(object)
                    chunk[out_col] = ans.where(ans.notna(), None)
                    chunk["resolve_error"] = None
                except Exception as e:  # noqa: BLE001 -- recorded per row
                    chunk[out_col] = None
                    chunk["resolve_error"] = str(e)
                yield chunk

    answered = distinct.mapInPandas(run, schema)
    answered = answered.withColumn(out_col, display_name(blank_to_null(F.col(out_col))))
    return residue.join(answered, list(keys), "left")


def accepted_union(accepted: DataFrame, resolved: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mapping rows from the fuzzy pass and from the fallback in one table."""
    return accepted.select(*cols).unionByName(resolved.select(*cols))

