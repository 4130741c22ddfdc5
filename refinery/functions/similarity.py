"""normalised Indel similarity ``2*LCS(a, b) / (len(a) + len(b))``.

This is not Levenshtein: substitutions cost 2.  The longest common subsequence
is computed bit-parallel: one bit per character of ``a`` in a long word, and a
few word operations per character of ``b``.  Strings too long for a word take
the row-by-row dynamic programme.  Both are built-in expressions, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WORD = 62  # characters of ``a`` that fit a long, with room for the carry of the addition


def _by_words(a: str, b: str) -> str:
    """Bit i of ``v`` is 0 where character i of ``a`` ends one more common character than its left neighbour."""
    chars = f"filter(split({a}, ''), x -> length(x) > 0)"
    masks = (f"map_from_entries(transform(array_distinct({chars}), c -> struct(c, aggregate("
             f"transform({chars}, (x, i) -> IF(x = c, shiftleft(1L, i), 0L)), 0L, (m, y) -> m | y))))")
    full = f"(shiftleft(1L, length({a})) - 1L)"
    hit = "(v & coalesce(try_element_at(m, c), 0L))"
    run = f"aggregate(filter(split({b}, ''), x -> length(x) > 0), {full}, (v, c) -> ((v + {hit}) | (v - {hit})) & {full})"
    return f"element_at(transform(array({masks}), m -> length({a}) - bit_count({run})), 1)"


def _by_rows(a: str, b: str) -> str:
    # prev: row for the characters of ``a`` seen so far (length lb + 1).
    # row:  the row being built; element j+1 (1-based) holds LCS(a[:i], b[:j]).
    return (
        f"element_at(aggregate(split({a}, ''), "
        f"transform(sequence(0, length({b})), z -> 0), "
        f"(prev, ca) -> aggregate(sequence(1, length({b})), array(0), "
        f"(row, j) -> concat(row, array(CASE WHEN substring({b}, j, 1) = ca "
        f"THEN element_at(prev, j) + 1 "
        f"ELSE greatest(element_at(prev, j + 1), element_at(row, j)) END)))), -1)"
    )


def _sql(a: str, b: str) -> str:
    lcs = f"CASE WHEN length({a}) <= {WORD} THEN {_by_words(a, b)} ELSE {_by_rows(a, b)} END"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(NULL AS DOUBLE) "
        f"WHEN length({a}) + length({b}) = 0 THEN 1.0D "
        f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0D "
        f"ELSE 2.0D * ({lcs}) / (length({a}) + length({b})) END"
    )


def indel_ratio(a: str, b: str) -> Column:
    """Similarity in [0, 1] between the string columns named ``a`` and ``b``."""
    return F.expr(_sql(f"`{a}`", f"`{b}`"))


def indel_upper_bound_ok(a: str, b: str, threshold: float) -> Column:
    """Lossless prefilter for ``indel_ratio(a, b) > threshold``.

    Both tests are necessary conditions: LCS <= min(la, lb) (length band) and
    Levenshtein distance <= Indel distance = la + lb - 2*LCS.
    """
    la, lb = F.length(F.col(a)), F.length(F.col(b))
    total = la + lb
    band = F.least(la, lb) * 2 > F.lit(threshold) * total
    slack = F.lit(1.0 - threshold) * total
    lev = F.levenshtein(F.col(a), F.col(b))
    return band & (lev.cast("double") < slack)
