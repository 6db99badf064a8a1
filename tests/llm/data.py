"""Small tables for the operators of the subpackage."""

import random

ALPHABET = "the of and to in is that it was for on are as with his they be at one have this from".split()


def words(rng, n):
    return " ".join(rng.choice(ALPHABET) + rng.choice(["", "", "er", "ing", "é"]) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, empty, null and long ones."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 3, 30, 120])) for _ in range(n)]
    passage = words(rng, 70)
    for i in range(0, n, 9):
        texts[i] = f"{words(rng, 15)}\n{passage}\n{words(rng, 9)}"
    texts += [texts[4], texts[4], texts[7] + " end", "", None, None, " \t\n", "x", "É!", words(rng, 9000), "line one here\nline one here\n\nother\nline one here", "a b c d e f g h i j a b c d e f g h i j"]
    return texts


def thue_morse(n):
    """Two texts of n letters with the same value under every polynomial hash modulo a power of two."""
    text = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return text, text.translate(str.maketrans("ab", "ba"))


def documents(spark, texts, first=0):
    """documents with columns whose names clash with those of results."""
    rows = [(first + i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "hot", "hot"][i % 5], len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard int")


def empty(spark):
    return documents(spark, [""]).limit(0)
