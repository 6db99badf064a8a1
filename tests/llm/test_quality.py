import re

import pyarrow as pa

from tidemark.llm import quality
from .data import corpus, documents, empty, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    lines = [line for line in t.split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures():
    texts = [t for t in corpus() if t is None or len(t) < 5000] + ["#a| <b>\x0b%\r\n*", "日本 語 x \x00"]
    found = quality.measures(pa.array(texts, pa.string()))
    assert list(zip(*(m.tolist() for m in found))) == [brute(t) for t in texts]
    assert quality.measures(pa.array(texts, pa.string()).slice(5, 3))[0].tolist() == [brute(t)[0] for t in texts[5:8]]


def test_host_verdicts(spark):
    good, bad = " ".join(f"word{i}" for i in range(25)), "too short"
    rows = [(i, good, "a") for i in range(30)] + [(100 + i, bad, "b") for i in range(30)] + [(200, good, "b"), (300, good, None), (301, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert len(found) == len(rows)
    assert found[0].kept and found[300].kept and not found[100].kept
    assert not found[200].base_failed and not found[200].kept  # its host takes it along
    rates = {r.host: r for r in quality.host_rates(quality.document_measures(docs)).collect()}
    assert 0.9 < rates["b"].short_rate < 30 / 31 + 0.01 and 0 < rates["a"].short_rate < 0.1  # shrunk towards each other


def test_edges(spark):
    assert quality.judged(empty(spark)).count() == 0
    docs = documents(spark, [None, "", "x"])
    assert [r.kept for r in quality.judged(docs.union(docs)).collect()] == [False] * 6


def test_lines_and_windows_are_compared_exactly(monkeypatch):
    one, other = thue_morse(1024)
    texts = [f"{one}\n{other}", f"{one}\n{other}\n{one}", " ".join([one] * 7 + [other] + [one] * 8)]
    expected = [brute(t) for t in texts]
    assert list(zip(*(m.tolist() for m in quality.measures(pa.array(texts))))) == expected
    monkeypatch.setattr(quality.tc, "window_hash", lambda codes, n: codes[n - 1 :] * 0)  # every window has one hash
    assert list(zip(*(m.tolist() for m in quality.measures(pa.array(texts))))) == expected
