"""The registered queries of the dealt operators, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.session import read_table

from . import chunk_bpe, collocations, ctw, decontaminate, licenses, line_dedup, merkle, packing, quality, secrets
from . import simhash, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_BLANK = "[\\x20\\x09-\\x0D]"
QUALITY_SQL = f"""
quality_texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
quality_words AS (
  SELECT r, doc_id, t, [x for x in regexp_split_to_array(t, '{_BLANK}+') if x <> ''] AS w,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ln
  FROM quality_texts),
quality_positions AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM quality_words WHERE len(w) >= {quality.WINDOW}),
quality_windows AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' ||
         lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS s
  FROM quality_positions WINDOW p AS (PARTITION BY r ORDER BY i)),
quality_repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM quality_windows WHERE s IS NOT NULL)
  WHERE c > 1),
quality_covered AS (
  SELECT r, CAST(sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM quality_repeated) GROUP BY r),
quality_metrics AS (
  SELECT q.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len([x for x in w if x IN ({_STOPS})]) AS n_stop_words, len(ln) AS n_lines,
         len([x for x in ln if rtrim(x) LIKE '%...']) AS n_ellipsis_lines
  FROM quality_words q LEFT JOIN quality_covered c ON q.r = c.r),
quality_scored AS (
  SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
         AS base_failed FROM quality_metrics)
"""
ORACLE["op7_quality_rules"] = f"""
WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       ({quality.kept_sql()}) AS kept
FROM quality_scored
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    phrases = "\nUNION ALL\n".join(
        "SELECT r, i, '{}' AS label FROM license_next WHERE {}".format(
            label, " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split())))
        for p, label in licenses.PHRASES.items())
    rows = ", ".join(
        "('{}', [{}], {}, {})".format(label, ", ".join(f"'{w}'" for w in sorted(set(words))),
                                      math.ceil(licenses.THRESHOLD * len(set(words)) - 1e-9), licenses.RUN * len(words))
        for label, words in ((k, licenses.template_words(t)) for k, t in licenses.TEMPLATES.items()))
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sep = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
worded AS (SELECT r, doc_id, t, [x for x in regexp_split_to_array(t, '{sep}') if x <> ''] AS w FROM texts),
places_in AS (SELECT r, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS i FROM worded WHERE len(w) > 0),
license_next AS (
  SELECT r, i, w0, lead(w0, 1) OVER p AS w1, lead(w0, 2) OVER p AS w2 FROM places_in
  WINDOW p AS (PARTITION BY r ORDER BY i)),
places AS ({phrases}),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY r),
templates(label, words, need, run) AS (VALUES {rows}),
-- a line of no more words than a run lies in a run, so the runs of all texts that hold enough words suffice
whole AS (
  SELECT r, w, label, words, need, run
  FROM worded JOIN templates ON len(list_intersect(words, list_distinct(w))) >= need),
runs AS (
  SELECT r, label, need, len(words) AS n,
         list_max([len(list_intersect(words, list_distinct(w[i:i + run - 1])))
                   for i in range(1, greatest(len(w) - run + 1, 1) + 1)]) AS common
  FROM whole),
matches AS (SELECT r, label, common / n AS c FROM runs WHERE common >= need),
method AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS best FROM matches GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
                                                                    coalesce(method.labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM worded LEFT JOIN base ON worded.r = base.r LEFT JOIN method ON worded.r = method.r
"""


ORACLE["op4_license_scan"] = _license_sql()


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # places and a checksum of each piece's ids; packing.pack_documents carries the ids themselves by default
    return packing.pack_documents(
        read_table(spark, sf_dir, "documents"), tokenizer_file(), carry={"ids_crc32": F.crc32("ids")})


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != "entropy")
    n = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
                        secrets.span_list(spans).alias("spans"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.delete_repeated_lines(docs, mark="lines")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_deleted"),
                      F.array_join(F.col("lines").cast("array<string>"), ",").alias("deleted_lines"), "text")


def line_dedup_sql(source: str, min_words: int = line_dedup.MIN_WORDS) -> str:
    """CTEs that end in ``line_kept(doc_id, gone, text)``: brute force over whole blocks of text."""
    return f"""
line_raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM {source}),
line_worded AS (
  SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i,
         len([x for x in regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+') if x <> '']) AS n
  FROM line_raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
line_sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line_worded),
line_docs AS (SELECT doc_id, list(line ORDER BY i) AS seq FROM line_worded GROUP BY doc_id),
line_ends AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM line_sums a JOIN line_sums b
  ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {min_words} GROUP BY 1, 2),
line_starts AS (
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM line_sums a JOIN line_sums b
  ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {min_words} GROUP BY 1, 3),
line_blocks AS (
  SELECT doc_id, s, e, array_to_string(seq[s:e], chr(10)) AS block
  FROM (SELECT * FROM line_ends UNION SELECT doc_id, s, e FROM line_starts) JOIN line_docs USING (doc_id)),
line_first AS (
  SELECT doc_id, s, e, row_number() OVER (PARTITION BY block ORDER BY doc_id, s) AS k FROM line_blocks),
line_gone AS (
  SELECT DISTINCT w.doc_id, w.no FROM line_worded w JOIN line_first f
  ON w.doc_id = f.doc_id AND w.i BETWEEN f.s AND f.e WHERE f.k > 1),
line_lists AS (SELECT doc_id, list(no ORDER BY no) AS gone FROM line_gone GROUP BY doc_id),
line_kept AS (
  SELECT d.doc_id, coalesce(gone, []) AS gone,
         CASE WHEN gone IS NULL THEN d.text ELSE coalesce((
           SELECT string_agg(r.line, chr(10) ORDER BY r.no) FROM line_raw r
           WHERE r.doc_id = d.doc_id AND NOT list_contains(gone, r.no)), '') END AS text
  FROM {source} d LEFT JOIN line_lists g ON d.doc_id = g.doc_id)
"""


ORACLE["op10_line_dedup"] = f"""
WITH {line_dedup_sql('documents')}
SELECT doc_id, CAST(len(gone) AS BIGINT) AS n_deleted, array_to_string(gone, ',') AS deleted_lines, text
FROM line_kept
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("h1", "h2")


def decontamination_sql(source: str, items: str = "benchmark") -> str:
    """CTEs that end in ``leak_pairs(doc_id, item_id, n_shared, n_shingles, containment)``."""
    k = decontaminate.SHINGLE_WORDS
    words = "[x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> '']"
    cut = f"[array_to_string(w[i:i + {k} - 1], ' ') for i in range(1, len(w) - {k} + 2)]"
    return f"""
leak_docs AS (SELECT doc_id, unnest(list_distinct({cut})) AS s FROM (SELECT doc_id, {words} AS w FROM {source})),
leak_items AS (
  SELECT item_id, unnest(list_distinct({cut})) AS s FROM (SELECT item_id, {words} AS w FROM {items})),
leak_sizes AS (SELECT item_id, count(*) AS n_shingles FROM leak_items GROUP BY item_id),
leak_pairs AS (
  SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
  FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM leak_docs JOIN leak_items USING (s) GROUP BY 1, 2)
  JOIN leak_sizes USING (item_id) WHERE n_shared >= {decontaminate.THRESHOLD} * n_shingles - 1e-9)
"""


ORACLE["op3_decontamination"] = f"""
WITH {decontamination_sql('documents')}
SELECT doc_id, item_id, n_shared, n_shingles, containment FROM leak_pairs
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


ORACLE["op9_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n,
                  sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= {warc.MIN_REVISIT} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d
"""


@query
def op6_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(read_table(spark, sf_dir, "documents"))


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read_table(spark, sf_dir, "documents"))


def _phrase_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    longest, least, top = collocations.LONGEST, collocations.MIN_COUNT, collocations.TOP
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, {k} AS m, " + " || ' ' || ".join(f"w{j}" for j in range(k)) +
        f" AS phrase, count(*) AS a FROM phrase_next WHERE w{k - 1} IS NOT NULL GROUP BY ALL" for k in range(1, longest + 1))
    leads = ", ".join(f"lead(w0, {j}) OVER p AS w{j}" for j in range(1, longest))
    return f"""
WITH phrase_pieces AS (
  SELECT row_number() OVER () AS r, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
phrase_words AS (
  SELECT r, lang, unnest(w) AS w0, generate_subscripts(w, 1) AS i
  FROM (SELECT r, lang, [x for x in regexp_split_to_array(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM phrase_pieces)),
phrase_next AS (SELECT lang, w0, {leads} FROM phrase_words WINDOW p AS (PARTITION BY r ORDER BY i)),
grams AS ({grams}),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND a >= {least}),
cuts AS (
  SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k + 1:], ' ') AS t
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r,
         CAST((CAST({collocations.SCALE} AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase
                            ORDER BY (CAST({collocations.SCALE} AS HUGEINT) * c.a) // (x.a + y.a), k) AS nth
  FROM cuts c JOIN grams x ON c.lang = x.lang AND c.h = x.phrase JOIN grams y ON c.lang = y.lang AND c.t = y.phrase),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM cand WHERE m > 2))),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score,
         row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer USING (lang, phrase)
  WHERE nth = 1 AND NOT coalesce(100 * most >= {collocations.INSIDE_PERCENT} * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""


ORACLE["op11_phrase_mining"] = _phrase_sql()


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row by checksum is tampered with after the manifest is made; its fold must miss the root."""
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(f) for f in merkle.FIELDS]
    forged = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    claimed = F.when(tampered, merkle.leaf_digest(forged)).otherwise(merkle.leaf_digest(fields))
    out = merkle.manifest(docs, carry={"claimed": claimed})
    return (out.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def _merkle_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = "sha256(" + " || ".join(part(f) for f in merkle.FIELDS) + ")"
    forged = "sha256(" + " || ".join(part("(n_chars + 1)" if f == "n_chars" else f) for f in merkle.FIELDS) + ")"
    # CRC-32 bit by bit: a byte is folded in, then eight steps (-1) shift it out
    steps = ("list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] "
             "for c in string_split(CAST(doc_id AS VARCHAR), '')]))")
    crc = (f"xor(4294967295, list_reduce({steps}, lambda x, s: CASE WHEN s >= 0 THEN xor(x, s) "
           "ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END))")
    return f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {leaf} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {forged} ELSE {leaf} END AS claimed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1
  GROUP BY lang, lvl, i // 2, n),
subroots AS (SELECT lang, lvl AS depth, h AS subroot FROM tree WHERE n = 1),
langs AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS li, count(*) OVER () AS ln FROM subroots),
upper_tree AS (
  SELECT 0 AS lvl, li AS i, ln AS n, subroot AS h FROM langs
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1
  GROUP BY lvl, i // 2, n),
walk AS (
  SELECT r, 0 AS lvl, p.i, p.n, 0 AS high, claimed AS cur, '' AS proof, p.lang, li, ln, depth
  FROM placed p JOIN langs ON p.lang IS NOT DISTINCT FROM langs.lang
  UNION ALL
  SELECT r, lvl + 1, i // 2, (n + 1) // 2, high,
         sha256(CASE WHEN i % 2 = 0 THEN cur || coalesce(sib, '') ELSE sib || cur END), proof || coalesce(sib, ''),
         lang, li, ln, depth
  FROM (SELECT w.*, t.h AS sib FROM walk w LEFT JOIN tree t
        ON w.lang IS NOT DISTINCT FROM t.lang AND w.lvl = t.lvl AND t.i = xor(w.i, 1) WHERE w.n > 1)),
top_walk AS (
  SELECT r, 0 AS lvl, li AS i, ln AS n, cur, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT r, lvl + 1, i // 2, (n + 1) // 2,
         sha256(CASE WHEN i % 2 = 0 THEN cur || coalesce(sib, '') ELSE sib || cur END), proof || coalesce(sib, '')
  FROM (SELECT w.*, t.h AS sib FROM top_walk w LEFT JOIN upper_tree t ON w.lvl = t.lvl AND t.i = xor(w.i, 1) WHERE w.n > 1)),
root AS (SELECT h AS root FROM upper_tree WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM placed p JOIN langs ON p.lang IS NOT DISTINCT FROM langs.lang JOIN top_walk w ON p.r = w.r AND w.n = 1, root
"""


ORACLE["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    coded = chunk_bpe.encode_documents(read_table(spark, sf_dir, "documents"), path)
    out = chunk_bpe.decode_documents(coded, path)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
