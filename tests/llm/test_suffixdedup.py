import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffixdedup
from .data import corpus, documents, empty, thue_morse


def brute(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
        yield len(t), int(gone.sum()), len(spans) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), spans


@pytest.mark.parametrize("n", [200, 15])
def test_removals(spark, n):
    texts = corpus(3)
    texts += [texts[0][20:] + " tail", "ab" * 300, "é" * 150, "z" * n, "z" * n, "y" * (n + 1), texts[9][:-1] + "é"]
    found = sorted(suffixdedup.deduplicated(documents(spark, texts), n).collect())
    assert [tuple(r)[1:] for r in found] == list(brute(texts, n))


@pytest.mark.parametrize("heavy,run", [(0, 1024), (3, 7)])
def test_large_groups_are_cut_into_strings(spark, monkeypatch, heavy, run):
    """One passage in many surroundings, one letter and a period, with groups cut early and short runs."""
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    monkeypatch.setattr(suffixdedup, "RUN", run)
    monkeypatch.setattr(suffixdedup, "SORT_STARTS", 50)
    rng = random.Random(2)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = noise(60)
    texts = [noise(rng.randrange(30)) + passage[rng.randrange(5) :] + noise(rng.randrange(30)) for _ in range(40)]
    texts += ["z" * 90, "xyz" * 40, "", None, passage] + [t for t in corpus(4) if t is None or len(t) < 2000]
    found = sorted(suffixdedup.deduplicated(documents(spark, texts), 15).collect())
    assert [tuple(r)[1:] for r in found] == list(brute(texts, 15))


def test_strings_are_compared_by_bytes(spark):
    one, other = thue_morse(1024)
    texts = [f"1 {one}", f"2 {other}"]
    found = sorted(suffixdedup.deduplicated(documents(spark, texts), 200).collect())
    assert [tuple(r)[1:] for r in found] == list(brute(texts, 200))


@pytest.mark.parametrize("n", [15, 200])
def test_suffixes_are_in_the_order_of_their_bytes(n):
    c, rng = suffixdedup.Cover(n), random.Random(n)
    for _ in range(40):
        base = "".join(rng.choice("ab") for _ in range(2 * n))
        texts = []
        for _ in range(rng.randrange(1, 9)):
            k = rng.randrange(len(base) - n)
            t = base[k : k + rng.randrange(n, 2 * n)]
            texts.append((t[:3] + rng.choice("abc") + t[4:]).encode())
        texts = [t for t in texts if len(t) >= n] or [b"a" * n]
        data, bounds = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = np.concatenate([np.arange(a, b - n + 1) for a, b in zip(bounds[:-1], bounds[1:])])
        order, same = suffixdedup.sorted_suffixes(c, np.frombuffer(data, np.uint8), bounds, starts, np.array([rng.randrange(c.v) for _ in texts]))
        plain = [data[starts[i] : starts[i] + n] for i in order]
        assert plain == sorted(plain)
        assert same.tolist() == [False] + [x == y for x, y in zip(plain, plain[1:])]


def test_ties_are_settled_by_ranks(monkeypatch):
    """Suffixes that tie in their first v - 1 bytes are never compared byte by byte in the middle."""
    c, seen = suffixdedup.Cover(200), []
    plain = suffixdedup.strings
    monkeypatch.setattr(suffixdedup, "strings", lambda data, starts, n: seen.append((n, len(starts))) or plain(data, starts, n))
    data = np.frombuffer(b"ab" * 200, np.uint8)
    suffixdedup.sorted_suffixes(c, data, np.array([0, 400]), np.arange(201), np.array([0]))
    assert [n for n, _ in seen] == [c.v - 1, c.core, c.v - 1]
    assert seen[1][1] < 400 * len(c.set) / c.v + len(c.set)  # the cover alone is ranked


@pytest.mark.parametrize("n", [200, 15])
def test_the_cover_meets_every_shift(n):
    v, d = suffixdedup.cover(n)
    inside = {(a - b) % v for a in d for b in d}
    assert inside == set(range(v))


def test_edges(spark):
    assert suffixdedup.deduplicated(empty(spark)).count() == 0
    twice = documents(spark, ["q" * 250]).union(documents(spark, ["q" * 250]))
    assert [r.n_removed for r in suffixdedup.deduplicated(twice).collect()] == [250, 250]
    assert [r.n_bytes for r in suffixdedup.deduplicated(documents(spark, [None])).collect()] == [0]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]
    with pytest.raises(ValueError):
        suffixdedup.cover(10)
