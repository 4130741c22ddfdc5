import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from refinery.llm import packing, range_coder, token_files, tokens


@pytest.fixture(scope="module")
def model(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def ids_of(model, text):
    return np.array(model.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_chunked_encoding_equals_whole_encoding(tokenizer_path):
    enc = tokens.ChunkEncoder(tokenizer_path, limit=300, longest=20)
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", " \n", "\t", "é", " ", "1", "23", ",", ".", "'s", "don't", "!?", "😀", "\r\n",
            "x" * 60, "　", "\x1c", "K", "end."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", None, " ", "\n"]
    for _ in range(2):  # cold and with what was kept
        want = [np.array(e.ids, "<u4").tobytes()
                for e in enc.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert enc.encode(texts) == want


def test_pieces_and_places(spark, corpus, docs, model, tokenizer_path):
    rows = packing.pack_documents(docs, tokenizer_path, capacity=64).collect()
    want = Counter()
    for i, t in corpus:
        ids = ids_of(model, t)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.update((i, j, a, ids[a:b].tobytes()) for j, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    by = {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) * 1.05 + 1
    whole = packing.sequences(packing.pack_documents(docs, tokenizer_path, capacity=64))
    assert sum(len(r.ids) for r in whole.collect()) == 4 * total


def test_empty_packing(no_docs, tokenizer_path):
    assert packing.pack_documents(no_docs, tokenizer_path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_keeps_all_and_is_never_above_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 20_000), np.minimum(1024, rng.geometric(0.01, 20_000)),
               rng.choice([1024, 700, 400, 30], 5_000), rng.integers(300, 420, 9_000),
               np.clip(rng.lognormal(5.2, 1.0, 20_000).astype(int) + 1, 1, 1024), rng.integers(130, 700, 20_000)][seed]
    histogram = Counter(lengths.tolist())
    runs = packing.plan_packing(histogram)
    got = Counter()
    for count, mix in runs:
        assert sum(n * c for n, c in mix.items()) <= 1024
        for n, c in mix.items():
            got[n] += count * c
    assert got == histogram
    best_fit = sum(c for c, _ in packing._best_fit([], histogram, 1024))
    assert sum(c for c, _ in runs) <= best_fit


@pytest.mark.parametrize("seed", range(6))
def test_range_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    vocabulary = int(rng.integers(3, 60_000))
    blocks = []
    for _ in range(6):
        n = int(rng.integers(1, 600))
        blocks.append([rng.integers(0, vocabulary, n), np.tile(rng.integers(0, vocabulary, n // 9 + 1), 10)[:n],
                       np.full(n, vocabulary - 1)][int(rng.integers(3))].astype(np.uint32))
    coded = range_coder.encode_blocks(blocks, vocabulary)
    back = range_coder.decode_blocks(coded, [len(b) for b in blocks], vocabulary)
    assert all((a == b).all() for a, b in zip(blocks, back))
    alone = range_coder.decode_blocks(coded[2:3], [len(blocks[2])], vocabulary)[0]
    assert (alone == blocks[2]).all()


def test_mixture_is_a_distribution_and_gives_the_size():
    rng = np.random.default_rng(4)
    vocabulary, n = 300, 700
    ids = np.where(rng.random(n) < 0.85, np.tile(rng.integers(0, vocabulary, 40), 18)[:n],
                   rng.integers(0, vocabulary, n)).astype(np.uint32)
    mixer, cum = range_coder._Mixer(1, n), range_coder.prior(vocabulary)
    mixer.ids[0, 1:] = ids
    every, bits, both, past = np.arange(vocabulary), 0.0, 0, 0
    for t, x in enumerate(ids.tolist()):
        past = max((r for r in range_coder.REFRESH if r <= t), default=0)
        mixer.predict(1, past)
        seen = np.bincount(ids[:past], minlength=vocabulary)
        width = mixer.up * np.diff(cum) + mixer.u0 * seen + mixer.w2 * (every == mixer.id2) + mixer.w1 * (every == mixer.id1)
        whole = 1 << range_coder.TOTAL_BITS
        assert width.min() >= 1 and whole * 0.99 < width.sum() <= whole
        # an id that both orders and the counts name has the sum of all
        both += bool(mixer.w2[0] and mixer.id2[0] == mixer.id1[0] == x and seen[x])
        bits -= np.log2(width[x] / whole)
        at = np.array([seen[:x].sum()], np.int32)
        mixer.update(1, t, np.array([x], np.int32), at, at + seen[x].astype(np.int32), width[x:x + 1])
    assert both > 100  # the case occurs
    size = 8 * len(range_coder.encode_blocks([ids], vocabulary)[0])
    assert bits <= size <= bits * 1.01 + 64


def test_repeats_cost_little():
    block = np.tile(np.arange(100, 140, dtype=np.uint32), 100)
    assert len(range_coder.encode_blocks([block], 50_257)[0]) < len(block) * 4 / 30


def test_token_files(spark, corpus, docs, no_docs, model, tokenizer_path, monkeypatch):
    rows = token_files.round_trip(docs, tokenizer_path).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, ids_of(model, t).tobytes()) for i, t in corpus)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    with_id = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    known = [i for i in with_id if i is not None]
    assert known == sorted(known) and with_id[len(known):] == [None] * (len(with_id) - len(known))
    assert token_files.round_trip(no_docs, tokenizer_path).count() == 0


def test_damage_is_found(spark, tmp_path, tokenizer_path):
    df = spark.createDataFrame([(1, "some words to code " * 50)], "doc_id long, text string")
    folder = tmp_path.as_uri()
    manifest = token_files.write_token_files(df, tokenizer_path, folder).collect()
    (path,) = tmp_path.glob("*.tok")
    (_, _, ids), = token_files.read_token_file(folder, manifest[0].file)
    assert zlib.crc32(ids) and len(ids) == 4 * manifest[0].n_tokens
    data = bytearray(path.read_bytes())
    data[40] ^= 0x55
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(token_files.read_token_file(folder, manifest[0].file))
