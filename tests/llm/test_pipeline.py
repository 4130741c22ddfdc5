import random
from collections import Counter

import numpy as np

import corpus_pipeline
from refinery.llm import quality
from refinery.llm.common import Scratch

from .test_line_dedup import brute as brute_lines
from .test_scans import brute_pairs
from .test_simhash import brute_components, brute_fingerprint

STOPS = ["the", "of", "and", "to", "in", "is"]


def prose(rng, n):
    return " ".join(rng.choice(STOPS) if rng.random() < 0.3 else "".join(rng.choices("aeioulmnrst", k=5))
                    for _ in range(n))


def test_stages_match_brute_force(spark, tmp_path, tokenizer_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 20)) for i in range(8)]
    passage = prose(rng, 55)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(30)]
    texts += [texts[0], texts[1], texts[2] + " end", texts[3].replace(" ", "  ", 1)]
    texts += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(3)]
    texts += [prose(rng, 80) + " " + items[i][1] + " " + prose(rng, 80) for i in range(4)]
    texts += ["### *** " * 40, "too short", None, "", "the end " * 60]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, prose(rng, 90))]
    data = [(i, t, "en", None, None) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, state = docs.columns, rows
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.table(stage(spark, before, str(tmp_path)), name)
        got = [tuple(r) for r in docs.collect()]
        if name == "quality_rules":
            ok = {(r.doc_id, r.text) for r in quality.score_documents(before, keep=("doc_id", "text"))
                  .filter("kept").collect()}
            state = [x for x in state if x in ok]
            assert 30 < len(state) < len(rows)
        elif name == "line_dedup":
            gone = brute_lines(state, 50)
            cut = lambda i, t: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), ()))
            state = [(i, cut(i, t)) for i, t in state]
            state = [x for x in state if x[1].strip()]
        elif name == "simhash_near_dedup":
            part = brute_components([brute_fingerprint(t) for _, t in state], [i for i, _ in state])
            stay = set(part.values())
            state = sorted({x for x in state if x[0] in stay}, key=repr)
        elif name == "benchmark_decontamination":
            dirty = {d for d, *_ in brute_pairs(state, items)}
            assert dirty
            state = [x for x in state if x[0] not in dirty]
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert sorted(repr((r[0], r[1])) for r in got) == sorted(map(repr, state)), name

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path)
    want = {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in state}
    pieces = sorted(docs.collect(), key=lambda r: (repr(r.doc_id), r.piece))
    found: dict = {}
    for r in pieces:
        found.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert found == want
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect())) \
        == sorted(map(repr, docs.select("doc_id", "piece", "length").collect()))
