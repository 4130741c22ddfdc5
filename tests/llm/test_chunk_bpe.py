import random

import numpy as np
import public_tokenizers
import pytest

from refinery.llm import chunk_bpe as C

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
BITS = ["a", "b", "Th", "É", "é", "́", "é", "日本", "\n", "  ", "\t", " ", "'s", "'ll", "12", "!!", "<|endoftext|>",
        " ", " ", "ß", "İ", "Σ", "😀", "\x1c", "\x85", "..."]


def text(rng, n):
    gap = rng.choice([0, .3])
    return "".join(rng.choice(BITS) + (" " if rng.random() < gap else "") for _ in range(n))


@pytest.mark.parametrize("path", PATHS)
def test_joins_agree_with_the_library(path):
    lib, rng = C.Library(path), random.Random(5)
    assert lib.by_word == ("word_bpe" in path)
    for _ in range(150):
        s = text(rng, rng.randint(0, 300))
        raw = s.encode()
        places = C.cut_places([raw], average=16, least=4, most=64)[0]
        parts = lib.encode([c.decode() for c in C.chunks_of(raw, places)])
        want = lib.whole([s])[0]
        assert lib.encode([s])[0] == want and lib.join(raw, places, parts) == want
        assert lib.decode([want])[0] == lib.model.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)


def test_cuts_depend_on_content_only():
    rng = random.Random(9)
    shared = " ".join(str(rng.random()) for _ in range(2000)).encode()
    texts = [shared, b"some other beginning " * 40 + shared, "é日本".encode() * 9000, b"", b"a" * 200_000]
    found = C.cut_places(texts)
    chunks = [set(C.chunks_of(t, p)) for t, p in zip(texts, found)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 > 10
    for t, p in zip(texts, found):
        assert b"".join(C.chunks_of(t, p)) == t and p[0] == 0
        for c in C.chunks_of(t, p):
            c.decode()
            assert len(c) <= C.MOST + 3


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("size", [C.FILTER_BYTES, 64])
def test_documents_round_trip(spark, corpus, path, size):
    rng = random.Random(2)
    passage = " ".join(str(rng.random()) for _ in range(900))
    rows = [*corpus, (70, passage), (71, "before " * 99 + passage), (72, passage + " after <|endoftext|>"), (73, "x" * 150_000),
            (74, text(rng, 5000)), (75, "x" * 150_000 + passage)]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "c") for i, t in rows],
                                 "doc_id long, text string, ids int, `key` string, `a.b` int, chunks string")
    got = C.decode_documents(C.encode_documents(docs, path, filter_size=size), path).collect()
    lib = C.Library(path)
    want = []
    for i, t in rows:
        ids = lib.model.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), lib.model.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=order) == sorted(want, key=order)


def test_no_documents(spark, no_docs):
    assert C.decode_documents(C.encode_documents(no_docs, PATHS[0]), PATHS[0]).count() == 0


def test_new_words_are_encoded_in_groups():
    lib = C.Library(PATHS[0])
    mark = lib.mark[0]
    words = [f"w{i}x" for i in range(600)] + ["it's", "<|", "endoftext|>", f"a{mark}b", mark, "́", "é", "ß", "中"]
    expected = [np.array(lib.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    whole, asked = lib.whole, []
    lib.whole = lambda texts: asked.extend(texts) or whole(texts)
    assert list(map(lib._learn(words).get, words)) == expected
    assert len(asked) < len(words)  # the groups, and the words of the one that holds the special token

    lib.mark = None
    lib.words.clear()
    assert list(map(lib._learn(words).get, words)) == expected


def test_a_mark_touches_no_other_token():
    token = dict(special=True, single_word=False, normalized=False, lstrip=False, rstrip=False)
    found = lambda *texts: C.Library._mark({"added_tokens": [token | {"content": t, "id": i} for i, t in enumerate(texts)]})
    assert found("<a>", "<b>") == ("<a>", 0)
    assert found("<a>", "x<") == ("x<", 1)  # "x" and the first would meet in the second
    assert found("<a>", "<a>b") == ("<a>b", 1)
    assert found("a", "ba", "ab") is None and found() is None


def test_letters_and_the_signs_behind_are_words_of_their_own(monkeypatch):
    monkeypatch.setattr(C, "FEW_WORDS", 0)
    lib, rng = C.Library(PATHS[0]), random.Random(4)
    lib.encode([" ".join(c + s for c in ("abc", "ABC", "Ñandú", "ñandÚ".replace("Ú", "ú")) for s in ("", ",", "!!", "'"))])
    assert {"abc", ",", "!!", "'"} <= set(lib.words) and "ABC" not in lib.words and "abc," not in lib.words
    bits = [*BITS, "×", "÷", "ª", "ÿ", "J̌", "̸", "=", "<", "<|ENDOFTEXT|>", "'S", "'", ",", "^", "~", "K", "x_y", "(b)", "B."]
    for _ in range(2000):
        s = "".join(rng.choice(bits) + (" " if rng.random() < .5 else "") for _ in range(rng.randint(0, 40)))
        assert lib.encode([s])[0] == lib.whole([s])[0]


def test_letters_are_encoded_with_blanks_between():
    lib = C.Library(PATHS[0])
    words = [f"w{'xyz'[i % 3]}{'abcdefgh'[i // 3 % 8]}{'klmn'[i // 24 % 4]}{'QRSTUV'[i // 96]}é" for i in range(576)]
    expected = [np.array(lib.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert lib._spaced(words) == expected and C.Library(PATHS[1]).ends is None
    lib.ends = np.zeros_like(lib.ends)  # no piece ends where it should: each word is a text again
    assert lib._spaced(words) == expected
