import random

import numpy as np
import pytest
import xxhash

from refinery.llm import simhash
from refinery.llm.common import Scratch
from refinery.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def test_fingerprint_and_components_match_brute_force(spark, corpus, docs, no_docs):
    assert all(simhash.fingerprint(t) == brute_fingerprint(t) for _, t in corpus)
    fps, ids = [brute_fingerprint(t) for _, t in corpus], [i for i, _ in corpus]
    part = brute_components(fps, ids)
    want = sorted(repr((ids[i], f"{fps[i]:016x}", part[i])) for i in range(len(ids)))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_row_of_every_component(corpus, docs, no_docs):
    fps, ids = [brute_fingerprint(t) for _, t in corpus], [i for i, _ in corpus]
    part = brute_components(fps, ids)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(set(part.values()), key=repr)
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("distance", [2, 4])
def test_large_groups_lose_no_link(spark, distance):
    """Chains and balls of fingerprints that share blocks, with chunks far smaller than the groups."""
    rng = random.Random(distance)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 2))))
    step = rng.getrandbits(64)
    for _ in range(60):  # a long chain
        fps.add(step)
        step ^= sum(1 << b for b in rng.sample(range(64), distance))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark, "test")
    for distinct in (1, 1 << 34):  # few and many blocks
        edges = scratch.table(simhash.links(frame, distinct, distance, chunk=16), "edges")
        a = np.array([r.a for r in edges.collect()], np.int64).view(np.uint64)
        b = np.array([r.b for r in edges.collect()], np.int64).view(np.uint64)
        assert (np.bitwise_count(a ^ b) <= distance).all()
        roots = {r.node: r.root for r in connected_components(edges, scratch).collect()}
        groups = {}
        for f, s in zip(fps, signed):
            groups.setdefault(roots.get(s, s), set()).add(f)
        want = {}
        for i, c in brute_components(fps, fps, distance).items():
            want.setdefault(c, set()).add(fps[i])
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_stars_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 50)] + [(7, 7), (1, 0), (0, 1)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    rows = connected_components(edges, Scratch(spark, "test")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [50, 61]
