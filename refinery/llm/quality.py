"""Quality rules: a threshold table compiled into one projection.

``THRESHOLDS`` is data.  ``verdict`` turns it into a single Boolean column over
the metrics of a text; the metrics are one struct expression over the text
column.  Nothing here runs Python on executors and nothing shuffles: the
operator is a scan, a projection and (for ``filter_documents``) a filter.

Defined results
  - null, empty or blank text: all counts 0, ``base_failed`` true, not kept;
  - very long text: every step is linear or n log n in the words of that text;
  - repeated rows are judged one by one; an empty table gives an empty result;
  - the stop-word ratio is asked of texts whose ``lang`` value names a language
    with a list; other languages, a null one and a table without that column
    are not asked.  Stop words count in any letter case;
  - the word length is not asked of texts of which a quarter or more is in words
    of scripts that set no blanks between words (Chinese, Japanese, Thai ...);
  - other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Function words of English, French, Spanish and German.
STOP_WORDS = tuple(
    "a an and are as at be by de del den der des die das du ein eine el en es est et for from have he in is "
    "ist it la las le les los mit nicht not of on or para pas por pour que qui se sich sur that the this to "
    "un una und une von was with y zu".split())

#: Values of ``lang`` (before any region or script) whose function words are in the list.
LISTED = ("en", "eng", "fr", "fra", "fre", "es", "spa", "de", "deu", "ger")

#: Letters of scripts without blanks between words: Thai to Myanmar, Khmer, Tai, Balinese, Javanese, Han, Kana, Yi.
UNSPACED = ("[\\x{0E00}-\\x{109F}\\x{1780}-\\x{17FF}\\x{1950}-\\x{19FF}\\x{1A20}-\\x{1AAF}\\x{1B00}-\\x{1B7F}"
            "\\x{2E80}-\\x{2FDF}\\x{3005}-\\x{3007}\\x{3040}-\\x{312F}\\x{31A0}-\\x{31FF}\\x{3400}-\\x{4DBF}"
            "\\x{4E00}-\\x{A4CF}\\x{A980}-\\x{A9DF}\\x{F900}-\\x{FAFF}\\x{FF66}-\\x{FF9F}\\x{20000}-\\x{3FFFF}]")
_MAYBE_UNSPACED = "[\\x{0E00}-\\x{10FFFF}]"
UNSPACED_SHARE = 0.25


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low <= metric <= high``.

    Ask only from ``min_words`` words on, only of the ``languages`` named (all
    if none are), and with ``spaced`` only of texts with blanks between words.
    """

    metric: str
    low: float
    high: float
    min_words: int = 0
    languages: tuple[str, ...] = ()
    spaced: bool = False


#: The threshold table.  Ratios are per word, or per line with a word.
THRESHOLDS = (
    Rule("n_words", MIN_WORDS, 100_000_000),
    Rule("mean_word_chars", 2.0, 14.0, spaced=True),
    Rule("symbol_ratio", 0.0, 0.1),
    Rule("stop_word_ratio", 0.04, 1.0, min_words=30, languages=LISTED),
    Rule("dup_line_ratio", 0.0, 0.5, min_words=30),
    Rule("ellipsis_line_ratio", 0.0, 0.5, min_words=30),
)


def _repeat_words(w: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text.  Most texts have no
    repeated window and stop after the distinct count.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        # each start covers up to the next start, and at most WINDOW words
        gaps = F.transform(starts, lambda s, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def starts_of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])),
            lambda x: x["i"])))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(starts_of(h), covered))

    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def metrics(text: Column) -> Column:
    """All metrics of one text as a struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def build(w: Column, ln: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.char_length(F.regexp_replace(text, BLANK_RUN, "")).cast("long")
        symbols = F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")
        dup = (F.size(ln) - F.size(F.array_distinct(ln))).cast("long")
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long")
        # most texts have no letter this high, and ASCII ones are known by their size
        unspaced = F.when((F.octet_length(text) > F.char_length(text)) & text.rlike(_MAYBE_UNSPACED), F.aggregate(
            F.filter(w, lambda x: x.rlike(UNSPACED)), F.lit(0).cast("long"),
            lambda a, x: a + F.char_length(x))).otherwise(F.lit(0).cast("long"))
        dots = F.size(F.filter(ln, lambda x: F.rtrim(x).endswith("..."))).cast("long")
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"), stop.alias("n_stop_words"),
            F.size(ln).cast("long").alias("n_lines"), dots.alias("n_ellipsis_lines"),
            unspaced.alias("n_unspaced_chars"))

    return let(words_of(text), lambda w: let(lines, lambda ln: build(w, ln)))


def _per(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def ratios(m: Column) -> dict[str, Column]:
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": _per(m["word_chars"], m["n_words"]),
        "symbol_ratio": _per(m["n_symbols"], m["n_words"]),
        "stop_word_ratio": _per(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": _per(m["n_dup_lines"], m["n_lines"]),
        "ellipsis_line_ratio": _per(m["n_ellipsis_lines"], m["n_lines"]),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _language(docs: DataFrame, lang: str) -> Column:
    """The first part of a language tag in lower case; null where the table has no such column."""
    name = next((c for c in docs.columns if c.lower() == lang.lower()), None)
    return F.lit(None).cast("string") if name is None else F.lower(
        F.split(F.btrim(F.col(f"`{name}`").cast("string")), "[-_]")[0])


def verdict(m: Column, rules: tuple[Rule, ...] = THRESHOLDS, language: Column | None = None) -> Column:
    """The threshold table as one Boolean column (the base rules included)."""
    value, ok = ratios(m), ~base_failed(m)
    language = F.lit(None).cast("string") if language is None else language
    for r in rules:
        good = value[r.metric].between(r.low, r.high)
        if r.min_words:
            good = (m["n_words"] < r.min_words) | good
        if r.languages:
            good = ~F.coalesce(language.isin(*r.languages), F.lit(False)) | good
        if r.spaced:
            good = (_per(m["n_unspaced_chars"], m["word_chars"]) >= UNSPACED_SHARE) | good
        ok = ok & good
    return ok


def score_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                    rules: tuple[Rule, ...] = THRESHOLDS, lang: str = "lang") -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` of every row, next to the ``keep`` columns."""
    language = _language(docs, lang)
    scored = docs.select(*keep, let(metrics(F.col(text)), lambda x: F.struct(
        x.alias("m"), base_failed(x).alias("base_failed"), verdict(x, rules, language).alias("kept"))).alias("v"))
    return scored.select(*keep, F.col("v.m").alias("m"), "v.base_failed", "v.kept").select(
        *keep, "m.*", "base_failed", "kept")


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS,
                     lang: str = "lang") -> DataFrame:
    """The rows whose text the rules keep, all columns unchanged."""
    language = _language(docs, lang)
    return docs.filter(let(metrics(F.col(text)), lambda m: verdict(m, rules, language)))


def kept_sql(rules: tuple[Rule, ...] = THRESHOLDS) -> str:
    """The verdict as SQL over the metric columns (for the oracle), every rule asked of every text.

    It equals ``verdict`` on texts of listed languages with blanks between words.
    """
    per = lambda a, b: f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0 END)"
    value = {
        "n_words": "CAST(n_words AS DOUBLE)", "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"), "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
    }
    parts = [f"(n_words < {r.min_words} OR {value[r.metric]} BETWEEN {r.low} AND {r.high})" for r in rules]
    return " AND ".join(["NOT base_failed", *parts])
