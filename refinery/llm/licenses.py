"""License scans: phrases in place, and an exact set-similarity join against notice templates.

For a template of n words a text block is every run of ``RUN`` x n words of a
text, over line breaks too, and every line of no more words: a notice that
wraps is found wherever its lines end, and words that a long line holds far
apart are none.  A template labels a block
when the block holds at least ``threshold`` of the template's distinct words.
The join is exact:

  1. one pass counts how often each template word occurs in the whole corpus;
     words are ordered by that count, rarest first;
  2. a template of n words that needs k of them must share one of its first
     n - k + 1 words with any matching block (prefix filter), and the block
     must hold at least k template words (length filter);
  3. a shared word at position i of the template and j of the block leaves at
     most ``min(i, j) + 1 + min(rest of template, rest of block)`` common
     words; pairs below k go (positional filter);
  4. what is left is verified by counting the common words.

Runs need no list of their own: a matching one holds a word of the template's
prefix, so only the words around each such word are looked at, filtered by the
same bounds and verified run by run.

The driver sees the word counts of the template vocabulary only, whose size
the template list fixes.

Defined results
  - null or empty text: 0 words, no places (null first and last), no labels, score 0;
  - rows with the same text get the same labels, whatever their id; repeated
    rows are all returned; a null id is kept;
  - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: What separates words, for texts in any letter case.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices as authors write them.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "public-domain": "released into the public domain",
}
THRESHOLD = 0.9
#: Words of a run that crosses line breaks, for each word of the template.
RUN = 2


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda x: x != "")


def _spaces(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def phrase_places(text: Column, phrases: Mapping[str, str] = PHRASES) -> Column:
    """Struct of n_words, n_base, first_word, last_word and base_labels of a text."""
    none = F.lit(None).cast("long")

    def place(norm: Column, n: Column, phrase: str) -> Column:
        # " a b cc by c " -> pieces around the phrase; the words before it are the spaces before it
        return let(F.split(norm, f" {phrase}(?= )"), lambda p: F.struct(
            (F.size(p) - 1).cast("long").alias("n"),
            F.when(F.size(p) > 1, _spaces(p[0]).cast("long")).alias("first"),
            F.when(F.size(p) > 1, (n - _spaces(F.element_at(p, -1)) + 1 - len(phrase.split())).cast("long"))
            .alias("last")))

    def build(norm: Column, n: Column) -> Column:
        found = F.array(*[place(norm, n, p) for p in phrases])
        labels = F.array(*[F.lit(x) for x in phrases.values()])
        return let(found, lambda f: F.struct(
            n.alias("n_words"),
            F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(f["first"]).alias("first_word"), F.array_max(f["last"]).alias("last_word"),
            F.array_sort(F.array_distinct(F.filter(labels, lambda _, i: F.get(f, i)["n"] > 0))).alias("base")))

    empty = lambda n: F.struct(n.alias("n_words"), F.lit(0).cast("long").alias("n_base"), none.alias("first_word"),
                               none.alias("last_word"), F.array().cast("array<string>").alias("base"))

    def scan(w: Column) -> Column:
        n = F.size(w).cast("long")
        norm = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

        def with_norm(s: Column) -> Column:
            low, seen = F.lower(s), F.lit(False)
            for p in phrases:
                seen = seen | low.contains(f" {p} ")
            return F.when(seen, let(ascii_lower(s), lambda x: build(x, n))).otherwise(empty(n))

        return let(norm, with_norm)

    return let(_words(F.coalesce(text, F.lit(""))), scan)


def word_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each vocabulary word occurs in all texts."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = (docs.select(F.explode(F.split(low, SEPARATORS)).alias("w"))
            .filter(F.col("w").isin(vocabulary)).groupBy("w").count().collect())
    return {r["w"]: r["count"] for r in rows}


def template_words(template: str) -> list[str]:
    """The words of a template by the rule of the texts: A-Z in lower case, split at all other ASCII signs."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in template)
    return [w for w in re.split(SEPARATORS, low) if w]


def _sides(docs: DataFrame, text: str, templates: Mapping[str, str],
           threshold: float) -> tuple[list[str], list[str], DataFrame]:
    """Template words rarest first, the words of all prefixes, and a row per template and prefix word."""
    listed = {label: words for label, t in templates.items() if (words := template_words(t))}
    if not listed:
        raise ValueError("no template holds a word")
    vocabulary = sorted(set().union(*listed.values()))
    counts = word_counts(docs, vocabulary, text)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix, rows = set(), []
    for label, words in listed.items():
        ordered = sorted(set(words), key=rank.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        for i, w in enumerate(ordered[:len(ordered) - need + 1]):
            prefix.add(w)
            values = {"t_label": label, "t_word": w, "t_pos": i, "t_need": need, "t_run": RUN * len(words)}
            rows.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()],
                                 F.array(*[F.lit(x) for x in ordered]).alias("t_words")))
    return order, sorted(prefix), docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _reach(size: Column, pos: Column) -> Column:
    """Whether a block of ``size`` template words that shares the one at ``pos`` can hold enough of them."""
    rest = F.least(F.size("t_words") - F.col("t_pos") - 1, size - pos - 1)
    return (size >= F.col("t_need")) & (F.least(F.col("t_pos"), pos) + 1 + rest >= F.col("t_need"))


def _line_matches(docs: DataFrame, keep: tuple[str, ...], text: str, order: list[str], prefix: list[str],
                  sides: DataFrame) -> DataFrame:
    low = F.lower(F.col("_line"))
    literal = F.array(*[F.lit(w) for w in order])
    blocks = (docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                          .alias("_line_no", "_line"))
              .filter(F.arrays_overlap(F.split(low, SEPARATORS), F.array(*[F.lit(w) for w in prefix]))))
    # the block's template words in global order (the literal is in that order, and so is the intersection)
    blocks = blocks.withColumn("_set", F.array_intersect(literal, F.split(ascii_lower(F.col("_line")), SEPARATORS)))
    tokens = blocks.select("*", F.posexplode("_set").alias("_pos", "_word"))
    common = F.size(F.array_intersect("t_words", "_set"))
    pairs = tokens.join(F.broadcast(sides), (F.col("_word") == F.col("t_word")) & _reach(F.size("_set"), F.col("_pos")))
    return (pairs.filter((common >= F.col("t_need")) & (F.size(_words(F.col("_line"))) <= F.col("t_run")))
            .select(*keep, F.col("_line_no").alias("line_no"), F.col("_line").alias("line"),
                    F.col("t_label").alias("label"), (common / F.size("t_words")).alias("containment")))


def _run_matches(docs: DataFrame, keep: tuple[str, ...], text: str, order: list[str], prefix: list[str],
                 sides: DataFrame, longest: int) -> DataFrame:
    """Runs around every prefix word: the best one of each word and template, without a line number."""
    literal, rare = F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(w) for w in prefix])
    worded = (docs.filter(F.arrays_overlap(F.split(F.lower(F.col(text)), SEPARATORS), rare))
              .select(*keep, _words(ascii_lower(F.col(text))).alias("_w")))

    def around(w: Column) -> Column:
        first = lambda i: F.greatest(i - longest + 1, F.lit(0))
        return F.filter(F.transform(w, lambda x, i: F.when(x.isin(prefix), F.struct(
            x.alias("word"), (i - first(i)).alias("at"),
            F.slice(w, first(i) + 1, i - first(i) + longest).alias("near")))), lambda x: x.isNotNull())

    near = worded.select(*keep, F.explode(around(F.col("_w"))).alias("_hit")).select(*keep, "_hit.*")
    pairs = near.join(F.broadcast(sides), F.col("word") == F.col("t_word"))
    # the words that any run of this template through the hit can hold
    first = F.greatest(F.col("at") - F.col("t_run") + 1, F.lit(0))
    pairs = pairs.withColumn("_span", F.slice("near", first + 1, F.col("at") - first + F.col("t_run")))
    pairs = pairs.withColumn("_set", F.array_intersect(literal, F.col("_span")))
    pairs = pairs.filter(_reach(F.size("_set"), F.array_position("_set", F.col("word")).cast("int") - 1)
                         & (F.size(F.array_intersect("t_words", "_set")) >= F.col("t_need")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_span") - F.col("t_run") + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: let(F.slice("_span", i, F.col("t_run")), lambda r: F.struct(
        F.size(F.array_intersect("t_words", r)).alias("n"), F.array_join(r, " ").alias("words"))))
    best = pairs.withColumn("_best", F.array_max(runs)).filter(F.col("_best.n") >= F.col("t_need"))
    return best.select(*keep, F.lit(None).cast("int").alias("line_no"), F.col("_best.words").alias("line"),
                       F.col("t_label").alias("label"), (F.col("_best.n") / F.size("t_words")).alias("containment"))


def license_blocks(docs: DataFrame, keep: tuple[str, ...], text: str = "text",
                   templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Blocks that reach a template: the ``keep`` columns, line number, line, label, containment.

    Every such line is there; a run has a null line number and its words as the line.
    """
    order, prefix, sides = _sides(docs, text, templates, threshold)
    longest = max(RUN * len(template_words(t)) for t in templates.values())
    return (_line_matches(docs, keep, text, order, prefix, sides)
            .unionByName(_run_matches(docs, keep, text, order, prefix, sides, longest)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: places of the phrases, all labels, and the best containment as score."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"),
                        F.struct(F.xxhash64(text), F.xxhash64(F.col(text), F.lit(1))).alias("_text"))
    found = (license_blocks(keyed, ("_text",), "text", templates, threshold)
             .groupBy("_text").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")))
    rows = keyed.select("doc_id", "_text", phrase_places(F.col("text")).alias("p"))
    joined = rows.join(found, "_text", "left")
    labels = F.array_sort(F.array_union(F.col("p.base"), F.coalesce("_labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "p.n_words", "p.n_base", "p.first_word", "p.last_word",
        F.array_join("p.base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("p.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
