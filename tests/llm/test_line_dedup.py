from refinery.llm import line_dedup


def brute(rows, min_words):
    """{(id, text): deleted line numbers}; rows with equal id and text are one document."""
    order = sorted({(i is None, i or 0, i, t or "") for i, t in rows}, key=lambda x: x[:2] + (x[3],))
    nulls = [x for x in order if x[2] is None]
    assert len({x[3] for x in nulls if x[3].strip()}) <= 1  # the hash order among null ids is not modelled
    seqs = [((i, t), [(n, ln) for n, ln in enumerate(t.split("\n")) if ln.split()]) for _, _, i, t in order]
    blocks = {}
    for d, (_, lines) in enumerate(seqs):
        for s in range(len(lines)):
            for e in range(s + 1, min(len(lines), s + 60) + 1):
                if sum(len(x.split()) for _, x in lines[s:e]) >= min_words:
                    blocks.setdefault(tuple(x for _, x in lines[s:e]), []).append((d, s, e))
    gone = {}
    for places in blocks.values():
        for d, s, e in sorted(places)[1:]:
            key, lines = seqs[d]
            gone.setdefault(key, set()).update(n for n, _ in lines[s:e])
    return gone


def test_matches_brute_force(corpus, docs):
    for min_words in (50, 20, 1):
        want = brute(corpus, min_words)
        got = line_dedup.delete_repeated_lines(docs, mark="pos_", min_words=min_words)
        assert got.columns == [*docs.columns, "pos_"]
        before = {(i, t or "") for i, t in corpus}
        rows = got.collect()
        assert len(rows) == len(corpus)
        expected = sorted(repr((i, "\n".join(x for n, x in enumerate((t or "").split("\n"))
                                             if n not in want.get((i, t or ""), ())))) for i, t in corpus)
        assert sorted(repr((r.doc_id, r.text or "")) for r in rows) == expected
        assert before


def test_first_copy_stays_and_emptied_documents_can_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (2, long), (9, "intro\n" + long + "\noutro"), (11, "short\nline"), (12, "short\nline")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(df, drop_emptied=True).collect()}
    assert got == {2: long, 9: "intro\noutro", 11: "short\nline", 12: "short\nline"}


def test_runs_of_many_short_lines_and_overlaps(spark):
    lines = [f"a{i} b{i}" for i in range(80)]
    rows = [(1, "\n".join(lines)), (2, "x\n" + "\n".join(lines[10:70]) + "\ny"), (3, "\n".join(lines[5:20])),
            (4, "\n".join(["same"] * 120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    got = line_dedup.delete_repeated_lines(df, mark="gone").collect()
    assert {(r.doc_id): set(r.gone) for r in got if r.gone} == {k[0]: v for k, v in want.items()}


def test_empty_table_and_string_ids(spark, no_docs):
    assert line_dedup.delete_repeated_lines(no_docs).count() == 0
    text = "\n".join("word " * 30 for _ in range(2))
    df = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(df).collect()}
    assert got == {"a": text, "b": ""}


def test_other_columns_keep_their_names_and_values(spark, corpus):
    names = ["_key", "_keyn", "_no_id", "_nos", "a.b", "h1", "pos", "`q`"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    docs = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in corpus], schema)
    out = line_dedup.delete_repeated_lines(docs)
    plain = line_dedup.delete_repeated_lines(docs.select("doc_id", "text"))
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[2 + k] == f"{n}{r.doc_id}" for r in rows for k, n in enumerate(names))
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in plain.collect())
    marked = line_dedup.delete_repeated_lines(docs, mark="x.y")
    assert marked.columns == [*docs.columns, "x.y"] and marked.count() == len(corpus)
