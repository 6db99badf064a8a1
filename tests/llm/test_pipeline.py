"""The pipeline's stages against plain versions of their decisions, written without the operators."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import textcore as tc
from tidemark.llm.common import table
from .test_decontaminate import split
from .test_mixing_sharding import filled
from .test_nearcopies import brute as near_groups

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

TOP = 1 << 64
BASE, CODES = int(tc.BASE), [int(c) for c in tc.BYTE_CODE]


def scrambled(h):
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 % TOP
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D % TOP
    return h ^ (h >> 33)


def features(text):
    """Places of a text's words, pairs and skip pairs in the hashed space."""
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    h = [scrambled((sum(CODES[b] * pow(BASE, i, TOP) for i, b in enumerate(w)) + len(w)) % TOP) for w in re.findall(rb"[0-9a-z\x80-\xff]+", lower)]
    pairs = [scrambled((a * BASE + b + salt) % TOP) for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5C5C5C5D)) for a, b in zip(h, h[gap:])]
    return sorted({x >> 44 for x in h + pairs})


def plain_scores(texts, sample):
    """FTRL-proximal one coordinate at a time; ``sample``: (features, label) in their order."""
    met = Counter(f for own, _ in sample for f in own)
    rows = [([f for f in own if met[f] >= 4] + ["intercept"], y) for own, y in sample]
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        l1 = 0 if f == "intercept" else 5.0
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / (1.0 + np.sqrt(n[f]) + 0.1)

    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(4):
        for i in rng.permutation(len(rows)):
            own, y = rows[i]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-min(max(sum(w.values()), -30), 30))) - y
            for f in own:
                z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) * w[f]
                n[f] += g * g
    return {i: 1 / (1 + np.exp(-min(max(weight("intercept") + sum(weight(f) for f in features(t)), -30), 30))) for i, t in texts.items()}


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, kept, rows = docs.columns, {}, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, DATA)
        assert after.columns == columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    texts = {i: r.text for i, r in rows.items()}

    labels = defaultdict(int)
    for r in table(spark, DATA, "labels").collect():
        if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            labels[r.doc_id] = max(labels[r.doc_id], r.toxic)
    places = {r.doc_id: r.place for r in table(spark, DATA, "documents").select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("place")).collect()}
    learned = sorted((i for i in labels if i in texts), key=places.get)
    scores = plain_scores(texts, [(features(texts[i]), labels[i]) for i in learned])
    clean = sorted(i for i in texts if scores[i] < 0.3)
    assert 0 < len(clean) < len(texts) and sorted(kept["toxicity"]) == clean

    groups = near_groups([texts[i] for i in clean])
    single = sorted({clean[g] for g in groups})
    assert len(single) < len(clean) and sorted(kept["near_dedup"]) == single

    windows = defaultdict(set)
    for r in table(spark, DATA, "benchmark").collect():
        w = split(r.text)
        n = min(10, len(w))
        windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    found = {i for i in single for w in [split(texts[i])] for n, own in windows.items() if any(tuple(w[k : k + n]) in own for k in range(len(w) - n + 1))}
    free = [i for i in single if i not in found]
    assert found and sorted(kept["decontaminate"]) == free

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")) for i in free}
    total = Counter()
    for i in free:
        total[rows[i].source] += size[i]
    times = Counter()
    for source, target in filled(total, (3, 1, 2), 1.5, 2).items():
        copies = int(target // total[source]) if total[source] else 0
        quota = round(target - copies * total[source])
        for i in sorted((i for i in free if rows[i].source == source), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), size[i])):
            part = max(0, min(size[i], quota))
            quota -= size[i]
            times[i] = copies + (part > 0 and 2 * part >= size[i]) if size[i] else 1
    assert kept["mix"] == +times

    final = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in final) == kept["mix"]
    slots, shards, bytes_of = defaultdict(list), defaultdict(set), Counter()
    for r in final:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[r.shard].append(r.slot)
        shards[t].add(r.shard)
        bytes_of[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    largest = Counter()
    for r in final:
        largest[texts[r.doc_id]] += r["size"]
    assert max(bytes_of.values()) - min(bytes_of[s] for s in range(8)) <= max(largest.values())


@pytest.mark.parametrize("labels", [[], [(i, None) for i in range(50)]])
def test_nothing_is_toxic_without_labels(spark, tmp_path, labels):
    docs = table(spark, DATA, "documents")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, kept_id long, _words long"
    rows = [(1, None, None, None, None, 0.5, 1, 2), (1, None, None, None, None, 0.5, 1, 2), (None, "a b", "en", "s", 3, None, None, None), (2, "", "en", "s", 0, None, None, None), (3, "x " * 3000, "de", "t", 6000, None, None, None)]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:4]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), schema)
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count() and (docs.count() > 0) == bool(given)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {r.shard for r in rows} <= set(range(8))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry.queries()


@pytest.mark.parametrize("number", range(1, 11))
def test_every_operator_has_a_query(number):
    assert sum(n.startswith(f"op{number}_") for n in entry.queries()) == 1
