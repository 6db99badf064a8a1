import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate
from .data import corpus, documents, empty, thue_morse, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w = split(text)
    hit, found = set(), set()
    for name, item in items:
        x = split(item)
        n = min(window, len(x))
        for s in range(len(x) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    texts = corpus(5)
    items = [(i, words(rng, 25)) for i in range(6)] + [(10, "Short one: only, 5"), (11, "!!"), (12, None), (13, "of"), (14, texts[9].split("\n")[1])]
    for i in range(0, len(texts), 7):
        part = (items[i % 6][1] or "").split()
        texts[i] = f"{texts[i] or ''} {' '.join(part[3:16]).upper()}! short ONE (only) 5"
    return texts, items


def test_exact_matches(spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    for passes in (False, True):
        if passes:
            decontaminate.MAX_WORDS, kept = 60, decontaminate.MAX_WORDS
        found = {r.doc_id: r for r in decontaminate.search(decontaminate.positional_index(documents(spark, texts)), bench).collect()}
        if passes:
            decontaminate.MAX_WORDS = kept
        for i, t in enumerate(texts):
            r = found[i]
            assert (r.n_words, r.n_hit, r.items) == brute(t, items), i
            assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit
    clean = decontaminate.without_matches(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not brute(t, items)[1]]


def test_proximity(spark):
    docs = documents(spark, ["a b x c d", "a b c d", "d c b a", "a b x y c d", "a b"])
    bench = spark.createDataFrame([("q", "a b c d")], "item_id string, text string")
    hits = lambda slop: [bool(r.n_hit) for r in sorted(decontaminate.search(decontaminate.positional_index(docs), bench, slop=slop).collect())]
    assert hits(0) == [False, True, False, False, False]
    assert hits(1)[:2] == [True, True] and not hits(1)[4]
    assert hits(2)[3]


def test_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    index = decontaminate.positional_index(documents(spark, ["a b", None]))
    assert [(r.n_words, r.n_hit, r.items) for r in decontaminate.search(index, bench).collect()] == [(2, 0, []), (0, 0, [])]
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.search(decontaminate.positional_index(empty(spark)), one).count() == 0
    twice = one.union(one)
    assert [r.items for r in decontaminate.search(index, twice).collect()] == [["1"], []]


def near(text, item, slop):
    """Words hit by the brute-force form of a proximity match."""
    w, x = split(text), split(item)
    hit = set()
    for s in range(len(w) - len(x) + 1):
        if all(any(0 <= p < len(w) and w[p] == t for p in range(s + k - slop, s + k + slop + 1)) for k, t in enumerate(x)):
            hit |= set(range(s, s + len(x)))
    return len(hit)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_matches_brute_force(spark, slop):
    rng = random.Random(slop)
    texts = ["b a c d", "c a b d", "d a b c"] + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(12))) for _ in range(150)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([("q", "a b c d")], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.matches(docs, bench, slop=slop).collect()}
    assert [found[i] for i in range(len(texts))] == [near(t, "a b c d", slop) for t in texts]
    alone = {i: decontaminate.matches(docs.where(docs.doc_id == i), bench, slop=slop).first().n_hit for i in range(3)}
    assert alone == {i: found[i] for i in range(3)}  # whatever else is in the block


@pytest.mark.parametrize("n", [1024, 2048])
def test_terms_are_compared_exactly(spark, n):
    one, other = thue_morse(n)
    bench = spark.createDataFrame([("q", one)], "item_id string, text string")
    found = decontaminate.matches(documents(spark, [one, other, f"{other} {one}"]), bench).collect()
    assert [r.n_hit for r in sorted(found)] == [1, 0, 1]


def test_items_without_an_id_hit_words(spark):
    bench = spark.createDataFrame([(None, "x y"), (3, "z")], "item_id long, text string")
    docs = documents(spark, ["w x y", "z x y", "w"])
    assert [(r.n_hit, r.items) for r in sorted(decontaminate.matches(docs, bench).collect())] == [(2, []), (3, ["3"]), (0, [])]
    assert [r.doc_id for r in decontaminate.without_matches(docs, bench).collect()] == [2]


def test_one_hash_for_several_terms():
    """Terms with one hash are still told apart by their identities."""
    words = np.array([[5, 1, 1], [5, 2, 2], [5, 1, 1], [4, 3, 3], [5, 2, 2]], np.uint64)
    terms, heads, positions = decontaminate.block_lists(words)
    assert terms.tolist() == [[4, 3, 3], [5, 1, 1], [5, 2, 2]] and heads.tolist() == [0, 1, 3, 5] and positions.tolist() == [3, 0, 2, 1, 4]
    wanted = np.array([[5, 2, 2], [5, 9, 9], [4, 3, 3], [6, 0, 0]], np.uint64)
    assert decontaminate.slots(terms, wanted).tolist() == [2, -1, 0, -1]
