"""Secret scans: fixed patterns, and sliding-window entropy per character class.

Patterns find assignments, access keys and long hexadecimal runs.  Besides
them every long candidate string is searched with a window of ``WINDOW``
characters, as a whole and between its separators: counts are kept
incrementally while the window slides, so the Shannon entropy of each window
costs a constant number of steps.  Windows at or above the limit of the
character class of the candidate or its part merge into spans of kind
``entropy``.  An allow-list suppresses strings that are random but public: a
candidate that one of its matches overlaps or directly precedes.  A placeholder
word suppresses the part of the candidate that holds it, not what stands beside
it.  URLs are public unless they are webhooks or signed, which carry a secret.

The scan is a map over rows: no shuffle, memory bounded by one Arrow batch.

Defined results
  - null or empty text: no spans; spans are in code points, end exclusive,
    ordered by start and then by kind (assign, access, hex, entropy);
  - very long texts are scanned whole; repeated rows, null ids and extra
    columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_RUN = re.compile(r"[A-Za-z0-9]{%d,}" % WINDOW)
#: Character class, what a candidate of the class looks like, and the entropy in bits that a window must reach.
#: The last class takes every candidate, so none is left out.
CLASSES = (
    ("hex", re.compile(r"(?=[^0-9]*[0-9])(?=[^a-fA-F]*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)"), 3.0),
    ("lower-digit", re.compile(r"(?=(?:[^0-9]*[0-9]){3})[a-z0-9]+"), 3.6),
    ("upper-digit", re.compile(r"(?=(?:[^0-9]*[0-9]){3})[A-Z0-9]+"), 3.6),
    ("base64", re.compile(r"(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_=-]+"), 3.8),
    ("lower-digit in parts", re.compile(r"(?=(?:[^0-9]*[0-9]){3})[a-z0-9+/_=-]+"), 3.8),
    ("upper-digit in parts", re.compile(r"(?=(?:[^0-9]*[0-9]){3})[A-Z0-9+/_=-]+"), 3.6),
    ("other", re.compile(r"[A-Za-z0-9+/_=-]+"), 4.0),
)
_PART = re.compile(r"[A-Za-z0-9]+")
#: Strings at a candidate that are random by nature but no secret: URLs (not webhooks or signed ones), hashes and
#: addresses.
ALLOWED = (
    r"""(?i)(?:https?://|www\.|://)(?![^\s"'<>]*(?:hook|[?&](?:key|sig|signature|auth|access_?key)=))"""
    r"""[^\s"'<>\\^`{|},;()\[\]]*""",
    r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    r"(?i)(?:sha(?:1|256|384|512)[:-]|md5[:-])[a-z0-9+/_=-]*",
    r"(?i)(?<![a-z0-9])urn:[a-z0-9+/_=.:%-]*",
    r"(?i)(?<![a-z0-9._%+/=-])[a-z0-9._%+/=-]*@[a-z0-9-]+\.[a-z0-9.-]*",
)
#: Placeholder words: the part between separators that holds one is no secret.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "x{8,}")
_SUM_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # a window holds one more while it slides


def entropy_spans(text: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of the text whose entropy reaches the limit."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    most = window * (math.log2(window) - limit) + 1e-9  # entropy >= limit, as a bound on the sum of c log c
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _SUM_TERM[c + 1] - _SUM_TERM[c]
        if i >= window:
            out = text[i - window]
            c = counts[out]
            counts[out] = c - 1
            total -= _SUM_TERM[c] - _SUM_TERM[c - 1]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Spans of a candidate as a whole, and of its long runs between separators, each by its own class."""
    limit = lambda part: next(b for _, shape, b in CLASSES if shape.fullmatch(part))
    spans = entropy_spans(text, limit(text))
    if text.isalnum():
        return spans
    for m in _RUN.finditer(text):
        spans += [(m.start() + a, m.start() + b) for a, b in entropy_spans(m[0], limit(m[0]))]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def stretches(text: str, placeholder: re.Pattern) -> list[tuple[int, str]]:
    """(start, stretch) of a candidate between the parts that hold a placeholder word."""
    if not placeholder.search(text):
        return [(0, text)]
    found, at = [], 0
    for m in _PART.finditer(text):
        if placeholder.search(m[0]):
            found.append((at, text[at:m.start()]))
            at = m.end()
    return [x for x in (*found, (at, text[at:])) if len(x[1]) >= WINDOW]


def find_secrets(text: str | None, allowed: re.Pattern, placeholder: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every span, in order."""
    if not text:
        return []
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    at = 0
    for word in [w for w in text.split() if len(w) >= WINDOW]:
        at = text.index(word, at)
        candidates = list(_CANDIDATE.finditer(word))
        public, k = [m.span() for m in allowed.finditer(word)] if candidates else [], 0
        for m in candidates:
            while k < len(public) and public[k][1] < m.start():
                k += 1
            if k == len(public) or public[k][0] >= m.end():
                for skip, stretch in stretches(m[0], placeholder):
                    start = at + m.start() + skip
                    found += [(start + a, start + b, 3) for a, b in candidate_spans(stretch)]
        at += len(word)
    return sorted(found, key=lambda x: (x[0], x[2], x[1])) if len(found) > 1 else found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 allowed: Sequence[str] = ALLOWED, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """(doc_id, spans) of every row."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    allow = "|".join(f"(?:{x.replace('(?i)', '')})" for x in allowed) or r"(?!)"
    words = "|".join(f"(?:{x})" for x in placeholders) or r"(?!)"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, placeholder = (re.compile(x, re.IGNORECASE | re.ASCII) for x in (allow, words))
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in find_secrets(t.as_py(), pattern, placeholder)]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(struct))], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(scan, schema)


def span_list(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] < acc["at"], F.struct(
            acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], gap, F.lit(mark)).alias("out"), x["end"].alias("at")))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, none, step, rest)
