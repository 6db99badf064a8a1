"""Near copies against all pairs of texts."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemark.llm import nearcopies, simhash
from .data import corpus, documents, empty


def shingles(t, k=5):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def cases(seed=3, n=60):
    """Isolated pairs on both sides of 0.8, a chain of edits and a text with its lines repeated."""
    rng = random.Random(seed)
    fresh = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    texts = []
    for i in range(n):
        text = fresh()
        texts += [text, edited(rng, text, i % 8)]
    text = fresh()
    for _ in range(15):
        texts.append(text := edited(rng, text, 2))
    line = fresh()
    return texts + [line, "\n".join([line] * 4)] + [t for t in corpus(2) if t is None or len(t) < 5000]


def test_the_stage_matches_brute_force(spark):
    texts = cases()
    expected = brute(texts)
    kept = corpus_pipeline.without_near_duplicates(spark, documents(spark, texts), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected))
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(spark, texts), family=corpus_pipeline.FAMILY).collect()}
    assert [found[i] for i in range(len(texts))] == expected


@pytest.mark.parametrize("spread", [3, 12])
def test_large_groups_are_cut_into_parts(spark, monkeypatch, spread):
    rng = random.Random(spread)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(150))
    texts = [edited(rng, base, rng.randrange(spread)) for _ in range(150)]
    monkeypatch.setattr(nearcopies, "TASK_SHINGLES", 2000)
    monkeypatch.setattr(nearcopies, "BLOCK", 32)
    monkeypatch.setattr(nearcopies, "TIES", 2)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test data")
def test_recall_on_documents(spark):
    """All pairs of texts that share 0.8 of their shingles, by similarity and by size of their
    group: whole documents and copies of them with some words changed, most of them alone."""
    rng, texts = random.Random(9), {}
    for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect():
        n = len((r.text or "").split())
        texts[r.doc_id] = r.text
        if 60 <= n <= 600:
            for k in range(rng.choice([1] * 9 + [6])):
                texts[(k + 1) * 10**6 + r.doc_id] = edited(rng, r.text, rng.randrange(1, max(2, n // 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    groups = defaultdict(list)
    for i, t in texts.items():
        if own := shingles(t):
            groups[own].append(i)
    sets = list(groups)
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own:
            holders[x].append(k)
    common = Counter()
    for own in holders.values():
        common.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    links = {(a, b): c / (len(sets[a]) + len(sets[b]) - c) for (a, b), c in common.items() if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c)}
    near = Counter(k for pair in links for k in pair)
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, family=corpus_pipeline.FAMILY).collect()}
    caught = defaultdict(list)
    for (a, b), share in links.items():
        hit = found[groups[sets[a]][0]] == found[groups[sets[b]][0]]
        for band in ("all", f"{int(20 * share) / 20:.2f}", "alone" if near[a] == near[b] == 1 else "in a group"):
            caught[band].append(hit)
    print({band: (sum(x), len(x)) for band, x in sorted(caught.items())})
    assert len(links) >= 300 and all(sum(x) >= 0.9 * len(x) for x in caught.values() if len(x) >= 10)
    assert all(len({found[i] for i in own}) == 1 for own in groups.values())  # copies are together


def test_close_pairs_of_many():
    rng = np.random.Generator(np.random.PCG64(1))
    fps = rng.integers(0, 1 << 63, (300, 2), np.uint64)[rng.integers(0, 300, 600)]
    fps[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 600).astype(np.uint64)
    a, b = nearcopies.close_pairs(fps, 2)
    few = nearcopies.spanning(600, a, b)
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps).sum(axis=2) <= 2)
    assert np.array_equal(few == few[:, None], (full := nearcopies.spanning(600, x, y)) == full[:, None])


def wide_clusters(seed, sizes, flips):
    """Rows of four words: of each cluster a centre with so many bits flipped."""
    rng = np.random.Generator(np.random.PCG64(seed))
    fps = np.concatenate([np.repeat(rng.integers(0, 1 << 63, (1, 4), np.uint64), n, 0) for n in sizes])
    for _ in range(flips):
        fps[np.arange(len(fps)), rng.integers(0, 4, len(fps))] ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    return rng.permutation(fps)


def test_gray_order_of_words():
    fps = wide_clusters(0, [5] * 8 + [1] * 60, 3)
    rank = [int("".join(f"{w:064b}" for w in row.tolist()), 2) for row in fps]
    for s in (1, 2, 4, 8, 16, 32, 64, 128):
        rank = [r ^ r >> s for r in rank]
    order = simhash.gray_order(fps).tolist()
    assert [rank[i] for i in order] == sorted(rank)


@pytest.mark.parametrize("flips", [2, 28, 45])
def test_candidates_come_from_the_gray_hierarchy(monkeypatch, flips):
    """Candidates of an upper node are those of all pairs, and the tree leaves pairs out."""
    fps, limit = wide_clusters(flips, [200, 90, 40, 17, 1, 1], flips), 64
    differs = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2)
    full = nearcopies.spanning(len(fps), *np.nonzero(differs <= limit))
    looked, whole = [], simhash._ones
    monkeypatch.setattr(simhash, "_ones", lambda x, wide: looked.append(len(x)) or whole(x, wide))
    a, b = nearcopies.close_forest(fps, np.zeros(len(fps), int), limit)
    found = nearcopies.spanning(len(fps), a, b)
    assert np.array_equal(found == found[:, None], full == full[:, None])
    assert looked and (flips > 40 or sum(looked) < len(fps) * (len(fps) - 1) // 2)  # loose clusters share few bits
    for cut in (1, 16, 100, 340):  # two blocks: pairs of one with the other
        a, b = nearcopies.close_pairs(fps, limit, cut)
        assert (differs[a, b] <= limit).all()
        found = nearcopies.spanning(len(fps), a, b)
        x, y = np.nonzero(differs[:cut, cut:] <= limit)
        assert (found[x] == found[cut + y]).all()


def test_edges(spark):
    assert nearcopies.one_of_each(empty(spark)).count() == 0
    docs = documents(spark, ["same text here now", "", None, " \n"])
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs.union(docs)).collect()) == [0, 1]
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d e")], "doc_id long, text string")
    assert nearcopies.one_of_each(nameless).count() == 3
    reused = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    assert nearcopies.near_copies(reused).count() == 3


def test_sets_have_no_repeats():
    (rows, head, h), = nearcopies.shingle_sets(pa.array(["a b a b a b a b", None, "A  B"]), 5, 42)
    assert rows.tolist() == [0, 2] and np.diff(head).tolist() == [2, 1] and len(h) == 3


def test_columns_may_have_any_name(spark):
    docs = documents(spark, ["same text here now", "same text here now", "other"])
    for n in ("kept_id", "kept_row", "row", "id", "number", "text_hash", "component_id", "fingerprint"):
        docs = docs.withColumn(n, docs.doc_id + 7)
    out = nearcopies.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.kept_id, r.number) for r in out.collect()) == [(0, 7, 7), (2, 9, 9)]
