import math
import zlib
from collections import Counter

import numpy as np
import pytest

from refinery.llm import ctw

TEXTS = ["abracadabra abracadabra", "the cat sat on the mat", "The dog sat", None, "", "été à la plage", "zz  top\n",
         "abra cad", "the the the the", "\U0001F600 smile"] * 3


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def decisions(text):
    data = b"\xff" * 3 + (text or "").encode().lower() + b"\xff"
    for k in range(3, len(data)):
        prefix = 1
        for j in range(7, -1, -1):
            bit = data[k] >> j & 1
            yield data[k - 3:k], prefix, bit
            prefix = 2 * prefix + bit


class Tree:
    def __init__(self, texts):
        self.counts, self.children = {}, {}
        for t in texts:
            for ctx, prefix, bit in decisions(t):
                for d in range(4):
                    key = (ctx[3 - d:], prefix)
                    self.counts.setdefault(key, [0, 0])[bit] += 1
                    if d:
                        self.children.setdefault((ctx[4 - d:], prefix), set()).add(key)
        self.weighted, self.share = {}, {}
        for key in sorted(self.counts, key=lambda k: -len(k[0])):
            a, b = self.counts[key]
            own = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(key[0]) == 3:
                self.weighted[key] = own
            else:
                below = sum(self.weighted[c] for c in self.children[key])
                self.weighted[key] = np.logaddexp(own, below) - math.log(2)
                self.share[key] = math.exp(own - math.log(2) - self.weighted[key])

    def log10(self, text):
        total = 0.0
        for ctx, prefix, bit in decisions(text):
            p = None
            for d in (3, 2, 1, 0):
                a, b = self.counts.get((ctx[3 - d:], prefix), (0, 0))
                own = (b + .5) / (a + b + 1)
                s = 1.0 if d == 3 else self.share.get((ctx[3 - d:], prefix), .5)
                p = own if p is None else s * own + (1 - s) * p
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x", 5), (None, "no id", "x", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, uid string, n_tokens int")


def test_scores_match_a_plain_tree(frame, monkeypatch):
    rows, df = frame
    training = [t for i, t, *_ in rows if not held_out(i)]
    tree, c = Tree(training), Counter()
    for t in training:
        c.update((t or "").encode().lower().split())
        c["end"] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        toks = [*(t or "").encode().lower().split(), "end"]
        want.append((repr(i), held_out(i), len(toks), sum(c[w] > 0 for w in toks), n,
                     sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), tree.log10(t)))
    for frequent, sent in ((3, 10 ** 6), (20_000, 0)):
        monkeypatch.setattr(ctw, "FREQUENT", frequent)
        got = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
               for r in ctw.score_documents(df, broadcast_rows=sent).collect()]
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:5] == b[:5]
            assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_bytes_sum_to_one_and_empty_training(spark, frame):
    ones = np.random.default_rng(0).random((5, 255))
    assert np.allclose((10 ** ctw.byte_log10(ones)).sum(axis=1), 1)
    x = np.array([.5, 1, 1.5, 7.5, 1e6 + .5])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    held = next(i for i in range(1000) if held_out(i))
    df = spark.createDataFrame([(held, "abc")], "doc_id long, text string")
    (r,) = ctw.score_documents(df).collect()
    assert r.n_known == r.train_tokens == 0 and r.score == pytest.approx(-4 * 8 * math.log10(2), rel=1e-6)
    assert ctw.score_documents(df.limit(0)).count() == 0
