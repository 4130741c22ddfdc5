import random
import re
from collections import Counter

from pyspark.sql import functions as F

from refinery.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = {k for k, c in Counter(windows).items() if c > 1}
    covered = {i + j for i, x in enumerate(windows) if x in many for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_metrics_match_brute_force(spark, corpus, docs):
    got = quality.score_documents(docs, keep=("doc_id", "text")).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_repeats_symbols_and_long_texts(spark):
    texts = ["a b c d e a b c d e f " * 3, "the # of * and " * 20, "w " * 5, "the of and to " * 3 + "x " * 40_000,
             "Zeileé \U0001F600 " * 11]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.score_documents(rows, keep=("text",)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_filter_keeps_columns_and_agrees_with_verdict(docs, no_docs):
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score_documents(docs).filter("kept").count()
    assert quality.filter_documents(no_docs).count() == 0
    assert quality.score_documents(no_docs).count() == 0


def test_rules_are_data(docs):
    none = quality.score_documents(docs, rules=(quality.Rule("n_words", 1e9, 1e10),))
    assert none.filter("kept").count() == 0
    assert quality.score_documents(docs, rules=()).filter(F.col("kept") == F.col("base_failed")).count() == 0


def test_languages_scripts_and_capitals(spark):
    rng = random.Random(2)
    prose = lambda words: " ".join(rng.choice(words.split()) + str(i % 7) * (i % 3) for i in range(60))
    stops = "the of and to"
    cases = [
        (" ".join(f"{w.upper()} word{i}" for i in range(20) for w in stops.split()), "en", True),
        (" ".join(f"{w.title()} word{i}" for i in range(20) for w in stops.split()), "EN-us", True),
        (prose("gatto casa mare sole luna vento strada libro"), "it", True),
        (prose("kot dom morze wiatr droga niebo ptak rzeka"), "pl", True),
        (prose("кошка дом море ветер дорога книга небо"), "ru", True),
        (prose("gatto casa mare sole luna vento strada libro"), None, True),
        (prose("gatto casa mare sole luna vento strada libro"), "en", False),
        (prose("gatto casa mare sole luna vento strada libro"), "de_AT", False),
        ("\n".join("这是一段没有空格的中文文本它的词之间没有空白" + chr(0x4E00 + i) for i in range(40)), "zh", True),
        ("\n".join("ภาษาไทยไม่มีการเว้นวรรคระหว่างคำ" + chr(0x0E01 + i) for i in range(40)), "th", True),
        (" ".join("unbrokenlongwordwithoutend" + str(i) for i in range(40)), "it", False),
        (" ".join("очень" * 4 + str(i) for i in range(40)), "ru", False),
    ]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(cases)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.score_documents(rows).collect()}
    assert got == {i: (False, want) for i, (*_, want) in enumerate(cases)}
    assert {r.doc_id for r in quality.filter_documents(rows).collect()} == {i for i, c in enumerate(cases) if c[2]}
    assert quality.filter_documents(rows.drop("lang").filter("doc_id = 6")).count() == 1
