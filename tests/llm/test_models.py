"""Toxicity and language: held-out accuracy on planted data, and edges."""

import random
import zlib

import numpy as np

from tidemark.llm import langid, toxicity
from .data import ALPHABET, documents, empty, words


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        parts = words(rng, rng.randrange(20, 120)).split()
        for _ in range(3 if toxic else 0):
            parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "moron", "scum"]))
        texts.append(" ".join(parts))
        labels.append((i, int(toxic)))
    docs = documents(spark, texts + [None, ""])
    model = toxicity.trained(docs, spark.createDataFrame(labels + [(9999, 1), (3, None)], "doc_id long, toxic int"))
    assert 0 < len(model[0]) < 2000
    out = toxicity.scored(docs, model)
    assert out.columns == [*docs.columns, "toxicity"]
    score = {r.doc_id: r.toxicity for r in out.collect()}
    right = [(score[i] >= toxicity.THRESHOLD) == bool(y) for i, y in labels if held_out(i)]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in score.values()) and score[400] == score[401]
    assert toxicity.scored(empty(spark), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b c", None])
    model = toxicity.trained(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.toxicity for r in toxicity.scored(docs, model).collect()] == [0.5, 0.5]


def test_samples_are_bounded(spark):
    """max_rows holds for rows, repeated ids and repeated rows included."""
    rows = [(i % 50, f"text {i}", "en") for i in range(300)] + [(1000, "same", "de")] * 200 + [(i, f"t {i}", "de") for i in range(2000, 2060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, totals = langid.learning_rows(docs, "doc_id", "text", "lang", 20, 5)
    counts = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert all(n <= 20 for n in counts.values()) and counts["en"] > 10 and totals["de"] >= 30
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2, "doc_id long, toxic int")
    learned = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10, 11).collect()
    assert len(learned) == 10


def test_not_toxic_keeps_columns(spark):
    docs = documents(spark, ["a b c", "idiot"]).selectExpr("*", "doc_id * 2 as toxicity")
    model = (np.arange(1 << toxicity.HASH_BITS), np.full(1 << toxicity.HASH_BITS, -1.0), 0.0)
    kept = toxicity.not_toxic(docs, model)
    assert kept.columns == docs.columns and [r.toxicity for r in kept.collect()] == [0, 2]
    assert toxicity.not_toxic(docs, (model[0], -model[1], 0.5)).count() == 0


def test_features_stay_in_their_document():
    import pyarrow as pa

    from tidemark.llm import textcore as tc

    ((_, _, data, offsets),) = list(tc.chunks(pa.array(["a b c", None, "d"])))
    doc, _ = toxicity.features(data, offsets)
    assert np.bincount(doc).tolist() == [3 + 2 + 1, 0, 1]


SYLLABLES = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "ich", "über"], "fr": ["eau", "ère", "que", "çon"]}


def test_language(spark):
    rng = random.Random(6)
    langs = [rng.choice(["en", "en", "de", "fr"]) for _ in range(300)]
    texts = [" ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))) for lang in langs]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))] + [(900, None, "en"), (901, "12 !?", "de"), (902, "", None), (903, "ΑΒΓΔ", None), (904, "THE ANDING", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.trained(docs)
    assert set(filters.languages) == set(SYLLABLES) and (filters.false_rate < 0.05).all()
    found = {r.doc_id: r for r in langid.predicted(docs, filters).collect()}
    assert np.mean([found[i].lang_pred == langs[i] for i in range(300) if held_out(i)]) > 0.97
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[900].lang_score == 0
    assert found[903].lang_pred == filters.languages[0] and found[903].lang_score == 0
    assert found[904].lang_pred == "en" and all(0 <= r.lang_score <= 1 for r in found.values())


def test_filters_hold_every_gram_and_many_languages():
    rng = np.random.default_rng(1)
    grams = [rng.integers(1, 2**63, 50).astype(np.uint64) for _ in range(70)]
    filters = langid.Filters([f"l{i}" for i in range(70)], grams)
    for i, g in enumerate(grams):
        held = (filters.masks(g)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert held.all()
    counts = filters.counts(np.zeros(50, int), grams[66], 1)[0]
    assert counts.argmax() == 66 and counts[66] > 45 and np.delete(counts, 66).max() < 10


def test_language_edges(spark):
    nothing = langid.trained(empty(spark))
    docs = documents(spark, ["abc", None])
    assert [r.lang_pred for r in langid.predicted(docs, nothing).collect()] == ["und", "und"]
    assert langid.predicted(empty(spark), nothing).count() == 0
    assert len(ALPHABET) > 10
