import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components
from .data import corpus, documents, empty


def fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def classes(fps, ids, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints():
    texts = [t for t in corpus() if t is None or len(t) < 5000] + ["A b  C\td E", "ÀÉ x", "one two three"]
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(pa.array(texts[:40], pa.string()), shingle=5).tolist() == [fingerprint(t, 5) for t in texts[:40]]


def clusters(rng, n, spread):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n,spread", [(300, 5), (500, 12), (40, 3), (1, 2)])
def test_forest_connects_what_links(n, spread):
    rng = random.Random(n)
    fps = np.array(clusters(rng, n, spread), np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    a, b = simhash.forest(fps, np.zeros(len(fps), int), 4)
    root = simhash.spanning(len(fps), a, b)
    expected = classes([int(f) for f in fps], list(range(len(fps))))
    assert {tuple(np.flatnonzero(root == r)) for r in set(root.tolist())} == {tuple(i for i, e in enumerate(expected) if e == r) for r in set(expected)}


def test_gray_order_and_masks():
    rank = simhash.gray_rank(np.arange(1024, dtype=np.uint64) ^ (np.arange(1024, dtype=np.uint64) >> np.uint64(1)))
    assert rank.tolist() == list(range(1024))  # the i-th Gray code has rank i
    masks = simhash.masks_of(4)
    assert len(masks) == 15
    rng = random.Random(0)
    for _ in range(200):  # four flips leave two segments whole
        flips = sum({1 << rng.randrange(64) for _ in range(4)})
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("block", [4096, 64])
def test_links_match_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    dense = [rng.getrandbits(64)]
    for _ in range(400):  # one large group under the same upper nodes
        dense.append(dense[0] ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)))
    fps = sorted({*clusters(rng, 300, 7), *dense, 0})
    monkeypatch.setattr(simhash, "BLOCK", block)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    expected = classes(fps, signed)
    assert [roots.get(s, s) for s in signed] == expected


def test_near_duplicates(spark):
    texts = corpus()
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [int(found[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [found[i].component_id for i in range(len(texts))] == classes(fps, list(range(len(texts))))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({found[i].component_id for i in found})


def test_a_family_links_where_any_fingerprint_does(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = corpus(4)
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(90)] = f"x{rng.randrange(500)}"
        texts.append(" ".join(own))
    prints = simhash.fingerprint_family(pa.array(texts, pa.string()), 5, 42, 3)
    assert prints[0].tolist() == simhash.fingerprints_of(pa.array(texts, pa.string()), 5).tolist()
    root = list(range(len(texts)))
    for own in prints.tolist():
        for i in range(len(own)):
            for j in range(i):
                if bin(own[i] ^ own[j]).count("1") <= 6:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts), 6, shingle=5, family=3).collect()}
    assert [found[i] for i in range(len(texts))] == root


def test_edges(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    docs = documents(spark, ["same text here now"] * 3)
    assert simhash.one_of_each(docs.union(docs)).count() == 1
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d e")], "doc_id long, text string")
    assert simhash.near_duplicates(nameless).count() == 3 and simhash.one_of_each(nameless).count() == 3


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("kept", [2, 3, 4])
def test_linked_fingerprints_agree_on_a_mask(kept):
    rng = random.Random(kept)
    masks = simhash.masks_of(4, kept)
    assert all(bin(m).count("1") >= kept * (64 // (4 + kept)) for m in masks)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)


def test_masks_follow_the_number_of_fingerprints(spark, monkeypatch):
    assert [simhash.kept_segments(n, 4) for n in (0, 10**6, 10**9, 10**11)] == [2, 2, 3, 4]
    monkeypatch.setattr(simhash, "NODE_MEMBERS", -1)  # always the most segments
    rng = random.Random(3)
    fps = clusters(rng, 300, 5)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(rows)).collect()}
    expected = classes(fps, fps)
    groups = {}
    for f, e in zip(fps, expected):
        groups.setdefault(found.get(f, f), set()).add(e)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected))
