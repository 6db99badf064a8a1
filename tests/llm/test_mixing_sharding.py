import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing, sharding
from .data import corpus, documents, empty


def filled(sizes, weights, share, cap):
    """Water-filling by rounds: clamp what is above its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 7, None: 50}, {"a": 5}, {"a": 0, "b": 10}, {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1000, "d": 30}])
@pytest.mark.parametrize("share", [0.5, 1.5, 1.9])
def test_water_filling(spark, sizes, share):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(rows, share=share).collect()}
    expected = filled(sizes, (3, 1, 2), share, 2)
    assert found.keys() == expected.keys()
    for s in sizes:
        assert found[s] == pytest.approx(expected[s], abs=1e-6)


def test_mix_meets_targets_and_repeats(spark):
    docs = documents(spark, corpus())
    found = mixing.mixed(docs).collect()
    assert len(found) == docs.count()
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=repr)


def test_mix_edges(spark):
    assert mixing.mixed(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mixed(documents(spark, [None, ""])).collect()] == [0, 0]
    twice = documents(spark, ["a b c"] * 2).union(documents(spark, ["a b c"] * 2))
    assert mixing.mixed(twice).count() == 4


def test_repeated_rows(spark):
    docs = documents(spark, corpus())
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    count = Counter(r.doc_id for r in out.collect())
    for r in mixing.mixed(docs).collect():
        extra = int(r.part > 0 and 2 * r.part >= r.size)
        assert count[r.doc_id] == (1 if r.size == 0 else r.copies + extra)


def test_one_id_for_many_rows(spark):
    """Null ids share one place for each size; what is left there is dealt out evenly."""
    docs = spark.createDataFrame([(None, "a b c d e", "s")] * 40 + [(i, "x y z", "t") for i in range(30)], "doc_id long, text string, source string")
    found = mixing.mixed(docs).collect()
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
    target = {r.source: r.target for r in found}
    assert len(found) == 70 and all(-1 < target[s] - taken[s] < 40 for s in target)
    again = sorted(tuple(r)[1:] for r in mixing.mixed(docs.repartition(3)).collect())
    assert again == sorted(tuple(r)[1:] for r in found)


def test_many_sources_are_joined(spark, monkeypatch):
    docs = documents(spark, corpus())
    expected = sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(docs).collect()), key=repr) == expected


def test_columns_may_have_any_name(spark):
    names = ["row", "source", "digest", "cut_digest", "times", "copies", "_id", "_size", "_times", "_source", "_words", "col"]
    docs = documents(spark, corpus()[:20])
    for n in names:
        docs = docs if n == "source" else docs.withColumn(n, docs.doc_id * 3)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert all(r[n] == 3 * r.doc_id for r in out.collect() for n in names if n != "source")


def test_no_python_in_the_mix(spark):
    plan = mixing.repeated(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pack_fills_in_every_dimension():
    rng = np.random.default_rng(0)
    v = rng.pareto(2.0, (3000, 3)) + 0.1
    shard = sharding.pack(v, 8)
    loads = np.array([v[shard == s].sum(axis=0) for s in range(8)])
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.02).all()


@pytest.mark.parametrize("own_unit", [2048, 20])
def test_shards(spark, monkeypatch, own_unit):
    """Groups are whole, sizes near equal, slots gapless; with own_unit 20 most groups go through buckets."""
    monkeypatch.setattr(sharding, "OWN_UNIT", own_unit)
    monkeypatch.setattr(sharding, "BUCKETS", 16)
    texts = corpus(n=300)[:-5] + ["copied text of a group"] * 150 + [None, "", ""]
    docs = documents(spark, [t for t in texts if t is None or len(t) < 5000])
    texts = [r.text for r in sorted(docs.collect())]
    rows = sharding.sharded(docs).collect()
    slots, shards_of, size = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        shards_of[texts[r.doc_id] or ""].add(r.shard)
        size[r.shard] += r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards_of.values())
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(size[s] - mean) for s in range(8)) < (0.03 if own_unit == 2048 else 0.06) * mean


def test_a_group_above_a_shard_is_cut_as_little_as_bytes_allow(spark):
    texts = ["x" * 99] * 400 + [f"{i} " + "y" * 95 for i in range(800)]  # a third: 2.7 shards
    rows = sharding.sharded(documents(spark, texts)).collect()
    size, hot = Counter(), set()
    for r in rows:
        size[r.shard] += r["size"]
        hot |= {r.shard} if r.doc_id < 400 else set()
    assert len(hot) == 3 and max(size.values()) < 1.15 * min(size.values())


def test_one_id_for_all_rows_is_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(300)] + [(1, "same")] * 300, "doc_id long, text string")
    rows = sharding.sharded(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 600 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_edges(spark):
    assert sharding.sharded(empty(spark)).count() == 0
    assert [(r["size"], r.text_crc32) for r in sharding.sharded(documents(spark, [None, ""])).collect()] == [(1, 0), (1, 0)]
