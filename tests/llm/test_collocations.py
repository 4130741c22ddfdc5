import random
import re
from collections import Counter

import numpy as np
import pytest

from refinery.llm import collocations as C


def brute(rows, least, longest, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(str.maketrans(C.UPPER, C.LOWER))):
            w = [x for x in re.split("[ \t]+", p) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        cand = [p for p, a in c.items() if len(p) > 1 and a >= least]
        longer = {}
        for p in cand:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer.get(p[i:i + m], 0), c[p])
        found = []
        for p in cand:
            a = c[p]
            if 100 * longer.get(p, 0) < 80 * a:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def sample(seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "New", "york", "city", "the", "the", "of", "é", "日本", "a\x01", "a", "b\x00c", "Über", "x1"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!", "\x0b"]
    rows = [(rng.choice(["en", "en", "fr", None, "und"]),
             "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 200)))) for _ in range(60)]
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", " . , "), ("de", "one"),
            ("en", "very long text " * 20_000), *rows[:5]]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 500, "range_entries": 40}, {"id_bits": 17, "range_entries": 100},
                                   {"id_bits": 32, "shard_bytes": 3000, "range_entries": 60}])
def test_phrases_match_plain_counts(spark, sizes):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "lang string, text string, a int, `key` string, `w.x` int")
    got = sorted(tuple(r) for r in C.mine_phrases(docs, min_count=6, **sizes).collect())
    assert got and got == brute(rows, 6, C.LONGEST)


def test_top_and_ties(spark):
    rows = [("en", f"w{i} v{i}") for i in range(50) for _ in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in C.mine_phrases(docs, min_count=3, top=7).collect())
    assert got == brute(rows, 3, 4, 7) and len(got) == 7


def test_no_rows_and_no_phrases(spark):
    assert C.mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.mine_phrases(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).count() == 0


def test_scores_are_exact_past_64_bits(spark):
    big = 9_000_000_000_000_000
    got = spark.sql(f"select (cast({big}L as decimal(20,0)) * {C.SCALE}) div (cast({big}L as decimal(20,0)) + 7L) as s").first()[0]
    assert got == C.SCALE * big // (big + 7)


@pytest.mark.parametrize("n,b", [(2, 1), (2, 7), (3, 5), (3, 21), (3, 22), (4, 16), (4, 17), (4, 31), (4, 32), (2, 32)])
def test_filters_are_lossless(n, b):
    rng = np.random.default_rng(n * 100 + b)
    words = rng.integers(0, 1 << b, (n, 3000))
    words[:, :200] = words[:, :1]
    left, right = C.permute(words, b)
    assert (C.restore(left, right, n, b) == words).all()
    high, low, counts = C.counted(*C._number(left, right, n, b), None)
    counts[0] = 1 << 40
    counts[-1] = 255
    back = C.restore(*C._split(high, low, n, b), n, b)
    assert {tuple(x) for x in back.T} == {tuple(x) for x in words.T}
    for prefix in (0, min(3, n * b - 1)):
        place = C._top(high, low, n * b, prefix)
        for p in np.unique(place):
            at = place == p
            data = C.pack_filter(high[at], low[at], counts[at], n * b, prefix)
            for x, y in zip(C.unpack_filter(data, n * b, prefix, int(p)), (high[at], low[at], counts[at])):
                assert (x == y).all()
