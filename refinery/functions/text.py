"""String column functions (normalisation, casing, null markers, list literals).

Every function maps Column -> Column with built-in expressions only, so the
work stays inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Latin letters whose ASCII spelling is longer than one letter
# (cannot go through ``translate``, which maps one character to one).
MULTI_LETTER_FOLDS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH",
}
# Latin letters with no canonical decomposition to ASCII.
SINGLE_LETTER_FOLDS = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŀ": "l", "Ŀ": "L", "ŧ": "t", "Ŧ": "T",
}


def _latin_fold_table() -> tuple[str, str]:
    """Build the accent-folding table from Unicode decomposition.

    Rule: every code point of Latin-1 Supplement and Latin Extended-A/B whose
    NFKD form starts with an ASCII letter folds to that letter.
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        if ch in MULTI_LETTER_FOLDS:
            continue
        if ch in SINGLE_LETTER_FOLDS:
            src.append(ch)
            dst.append(SINGLE_LETTER_FOLDS[ch])
            continue
        base = unicodedata.normalize("NFKD", ch)[:1]
        if base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _latin_fold_table()
_WS = r"[\s\p{Z}]"


def strip(c: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace of any Unicode kind (like ``str.strip``)."""
    return F.regexp_replace(_c(c), rf"^{_WS}+|{_WS}+$", "")


def fold_to_ascii(c: ColumnOrName, extra_map: dict[str, str] | None = None) -> Column:
    """Transliterate Latin letters to ASCII; ``extra_map`` adds other scripts.

    Full transliteration of every script needs tables this library does not
    ship; callers pass one (e.g. Cyrillic) as ``extra_map``.
    """
    col = _c(c)
    multi = dict(MULTI_LETTER_FOLDS)
    single_src, single_dst = _FOLD_SRC, _FOLD_DST
    for k, v in (extra_map or {}).items():
        if len(k) == 1 and len(v) == 1:
            single_src += k
            single_dst += v
        else:
            multi[k] = v
    col = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), multi.items(), col)
    return F.translate(col, single_src, single_dst)


def normalize_name(c: ColumnOrName, extra_map: dict[str, str] | None = None) -> Column:
    """lower-case, strip, fold accents -- the comparison key for names."""
    return fold_to_ascii(strip(F.lower(_c(c))), extra_map)


def title_case(c: ColumnOrName) -> Column:
    """``str.title`` semantics -- every run of letters is capitalised.

    ``initcap`` only splits on spaces (``Winston-salem``); this splits on any
    non-letter (``Winston-Salem``, ``St. John'S``).
    """
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cased = F.transform(
        runs,
        lambda r: F.when(r.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
        .otherwise(r),
    )
    return F.when(_c(c).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(cased, ""))


def display_name(c: ColumnOrName, extra_map: dict[str, str] | None = None) -> Column:
    """normalised then title-cased (the output spelling of a resolved name)."""
    return title_case(normalize_name(c, extra_map))


def code_key(c: ColumnOrName) -> Column:
    """upper-cased, stripped code (ISO2/ISO3 lookups)."""
    return F.upper(strip(_c(c)))


def snake_name(c: ColumnOrName) -> Column:
    """spaces to underscores, lower case."""
    return F.lower(F.replace(_c(c), F.lit(" "), F.lit("_")))


def snake_name_py(value) -> str:
    """Driver-side twin of :func:`snake_name`, used for output column names."""
    return str(value).replace(" ", "_").lower()


# Fixed value: the warehouse null marker is one or more backslashes then ``N``.
NULL_MARKER_PATTERN = r"\\+N"


def null_marker_to_null(c: ColumnOrName, match: str = "contains") -> Column:
    """A cell holding the null marker becomes null.

    ``match='contains'`` nulls any cell containing the marker (the reference's
    behaviour); ``'exact'`` only cells that are the marker.
    """
    col = _c(c)
    pattern = NULL_MARKER_PATTERN if match == "contains" else rf"^{NULL_MARKER_PATTERN}$"
    return F.when(col.rlike(pattern), F.lit(None).cast("string")).otherwise(col)


# Answers that mean "no answer".
BLANK_ANSWERS = ["", '""', "''"]


def blank_to_null(c: ColumnOrName) -> Column:
    """empty or quote-only answer becomes null."""
    col = _c(c)
    return F.when(F.trim(col).isin(*BLANK_ANSWERS), F.lit(None).cast("string")).otherwise(col)


# The parts of a list literal: quoted strings whole, any other character alone (blanks outside strings go).
_LITERAL_PARTS = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\bNone\b|[^\s]"""


def parse_list_literal(c: ColumnOrName) -> Column:
    """parse a Python/JSON list literal of strings; blank/null -> [], malformed -> null.

    ``None`` outside quotes is a null item, as ``null`` is.
    """
    col = _c(c)
    parts = F.regexp_extract_all(col, F.lit(_LITERAL_PARTS), F.lit(0))
    text = F.array_join(F.transform(parts, lambda x: F.when(x == "None", F.lit("null")).otherwise(x)), "")
    parsed = F.from_json(
        F.when(col.contains("None"), text).otherwise(col),
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"},
    )
    return F.when(col.isNull() | (F.trim(col) == ""), F.array().cast("array<string>")).otherwise(parsed)


def text_or_placeholder(c: ColumnOrName, placeholder: str = "Missing") -> Column:
    """missing text gets a placeholder before featurising."""
    return F.coalesce(_c(c), F.lit(placeholder))
