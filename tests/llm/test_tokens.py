"""Token counts, token files and the coder."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import huffman, textcore as tc, tokencounts, tokens
from .data import corpus, documents, empty, thue_morse

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")

FILE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["İstanbul ΑΣ Σας", "<|endoftext|> x", "don't I'LL", "a\u0085d\x1ce ", "日本語 ½ ²", "ß ẞ Œ Ÿ", "😀 x\x00y", "é K Å"]


def test_words_encode_as_the_tokenizer_does(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CACHED_WORDS", 50)
    monkeypatch.setattr(tokens, "MAX_CACHED_PIECES", 50)
    monkeypatch.setattr(tc, "CHUNK_BYTES", 700)
    coder, full = tokens.WordEncoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    rng = random.Random(1)
    texts = corpus() + ODD + ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0x2000)])) for _ in range(40)) for _ in range(200)]
    at = 0
    for first, end, data, offsets in tc.chunks(pa.array(texts, pa.string())):
        ids, each = coder.encode(data, offsets, 1)
        cut = np.cumsum(each)
        for i, n, e in zip(range(first, end), each, cut):
            assert ids[e - n : e].tolist() == full.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        at = end
    assert at == len(texts)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_are_known_by_their_bytes(n):
    coder, full = tokens.WordEncoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    for text in (" ".join(thue_morse(n)), " ".join(reversed(thue_morse(n)))):
        data = np.frombuffer(text.encode(), np.uint8)
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == full.encode(text, add_special_tokens=False).ids


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(tc, "identity_hash", lambda a, b: (b >> np.uint64(58)) + np.uint64(2))  # by length alone
    coder, full = tokens.WordEncoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    for text in ("aa bb cc aa some other words bb", "cc dd ee some others"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == full.encode(text, add_special_tokens=False).ids


def test_pieces_of_new_words_are_kept():
    """75,000 pieces, each in three words that differ, go to the library once."""
    coder, full, cut = tokens.WordEncoder(FILE), tokenizers.Tokenizer.from_file(FILE), []

    class Model:
        tokenize = staticmethod(lambda piece, known=coder.model.tokenize: cut.append(piece) or known(piece))

    coder.model = Model
    letters = "abcdefghijklmnopqrstuvwxyz"
    pieces = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(75_000)]
    for digit in "123":
        for i in range(0, len(pieces), 25_000):
            text = " ".join(p + digit for p in pieces[i : i + 25_000])
            ids, _ = coder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
            if digit == "3":
                assert ids.tolist() == full.encode(text, add_special_tokens=False).ids
    assert len(cut) == len(set(cut)) == 75_003


def test_words_that_change_in_lower_case_or_hold_special_tokens(monkeypatch):
    monkeypatch.setattr(tokens, "STEP_WORDS", 3)
    coder, full = tokens.WordEncoder(FILE), tokenizers.Tokenizer.from_file(FILE)
    text = "x <| a<|endoftext|>b < | İ ΑΣ Ⱥ \u0240x \u024f Ÿ K ǅ \xa0 \x85 a\xa0b \x1c\x1d ñO's 'LL'd 12½3 ÀÉ.. x"
    data = np.frombuffer(text.encode(), np.uint8)
    assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == full.encode(text, add_special_tokens=False).ids


def test_another_file_takes_whole_texts(tmp_path):
    """A tokenizer whose steps are not known may join text across white space."""
    other = tokenizers.Tokenizer(tokenizers.models.BPE({"a": 0, " ": 1, "a ": 2, "a a": 3}, [("a", " "), ("a ", "a")]))
    other.save(str(tmp_path / "t.json"))
    data = np.frombuffer(b"a aa", np.uint8)
    assert tokens.WordEncoder(str(tmp_path / "t.json")).encode(data, np.array([0, 3, 4]), 7)[0].tolist() == [3, 7, 0, 7]


def test_code_lengths():
    rng = np.random.default_rng(0)
    for counts in (rng.integers(0, 1000, 500), 2 ** np.arange(30), np.array([0, 7, 0]), np.zeros(4, int), np.ones(16, int), np.array([3, 1])):
        for bits in (10, 18):
            lengths = huffman.code_lengths(counts, bits).astype(int)
            used = counts > 0
            assert (lengths > 0).tolist() == used.tolist() and lengths.max(initial=0) <= bits
            if used.sum() > 1:
                assert sum(2.0 ** -lengths[used]) == 1
            codes = huffman.canonical_codes(lengths.astype(np.uint8))
            words = sorted(format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(used))
            assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert huffman.code_lengths(np.array([1, 1, 2, 4]), 18).tolist() == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 40_000])
def test_bits_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).pareto(1.0, n) * 9, 4000).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=4001))
    bits, marks = huffman.encode_bits(ids, lengths, huffman.canonical_codes(lengths))
    assert huffman.decode_bits(bits, marks, n, huffman.decode_table(lengths, 18), 18).tolist() == ids.tolist()


def test_store(spark, monkeypatch):
    texts = corpus()
    docs = documents(spark, texts, first=50).orderBy("n_chars")
    path = huffman.new_store_path(spark)
    huffman.write_store(docs, path, FILE)
    full, at = tokenizers.Tokenizer.from_file(FILE), 0
    for r in sorted(huffman.read_store(spark, path).collect()):
        ids = full.encode(texts[r.doc_id - 50] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_frequent_id_is_spread(spark):
    docs = spark.createDataFrame([(None, f"text {i % 7}") for i in range(400)], "doc_id long, text string")
    path = huffman.new_store_path(spark)
    huffman.write_store(docs.repartition(5), path, FILE)
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    found = sorted((r.start, r.n_tokens) for r in huffman.read_store(spark, path).collect())
    assert len(found) == 400 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))


def test_store_edges(spark):
    path = huffman.new_store_path(spark)
    huffman.write_store(empty(spark), path, FILE)
    assert huffman.read_store(spark, path).count() == 0
    path = huffman.new_store_path(spark)
    huffman.write_store(spark.createDataFrame([(None, None), (3, ""), (3, "")], "doc_id long, text string"), path, FILE)
    assert sorted((r.start, r.n_tokens) for r in huffman.read_store(spark, path).collect()) == [(0, 1), (1, 1), (2, 1)]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def apply(text, edits):
    for a, b, r in reversed(edits):
        text = text[:a] + r + text[b:]
    return text


def test_edits_count_like_a_full_encoding(reference):
    coder, rng = tokencounts.counter(RANKS, P.PATTERN), random.Random(5)
    text_of = lambda n: "".join(rng.choice("ab 'lsvre\n\t  .,!é1٣日 ") for _ in range(n))
    for _ in range(600):
        tree = tokencounts.TokenTree.build(text_of(rng.choice([0, 1, 3, 30, 700])), coder)
        for _ in range(2):
            before = tree.text
            points = sorted(rng.randrange(len(before) + 1) for _ in range(2 * rng.randrange(4)))
            edits = [(a, b, text_of(rng.choice([0, 1, 5, 300]))) for a, b in zip(points[::2], points[1::2])]
            tree.apply(edits, coder)
            assert tree.text == apply(before, edits)
            assert tree.tokens == len(reference.encode_ordinary(tree.text))
            tree = tokencounts._tree(*tokencounts._packed(tree.columns()))


def test_an_edit_touches_little(reference):
    coder = tokencounts.counter(RANKS, P.PATTERN)
    tree = tokencounts.TokenTree.build("some plain words " * 5000, coder)
    assert tree.edit(40_000, 40_004, "other", coder) < 8
    with pytest.raises(ValueError):
        tree.apply([(5, 6, ""), (1, 2, "")], coder)


def test_token_counts(spark, reference):
    texts = corpus() + ["mail a.b@c.org or call +1 (555) 010-2233\nsame\nsame\nsame"]
    trees = tokencounts.with_redactions(tokencounts.token_trees(documents(spark, texts), RANKS, P.PATTERN))
    for r in tokencounts.edited(trees, RANKS, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        now = apply(t, tokencounts.redactions(t))
        assert (r.n_before, r.n_tokens, r.text) == (len(reference.encode_ordinary(t)), len(reference.encode_ordinary(now)), now)
    assert now == "mail <email> or call <number>\nsame\n" or r.doc_id != len(texts) - 1
    assert tokencounts.token_trees(empty(spark), RANKS, P.PATTERN).count() == 0
    found = {r.doc_id: tuple(r)[1:] for r in tokencounts.edited(trees, RANKS, P.PATTERN).select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded").collect()}
    at_once = tokencounts.edited_counts(documents(spark, texts), RANKS, P.PATTERN, tokencounts.redactions).collect()
    assert {r.doc_id: tuple(r)[1:] for r in at_once} == found
    assert tokencounts.edited_counts(empty(spark), RANKS, P.PATTERN, tokencounts.redactions).count() == 0


def test_other_patterns_are_cut_from_the_start(reference):
    """A pattern may look ahead without limit."""
    assert P.PATTERN == tokencounts.KNOWN
    pattern = r"\s*[\r\n]+|\s+|\S+"
    coder, rng = tokencounts.Counter(RANKS, pattern), random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("a  \n") for _ in range(40))
        tree = tokencounts.TokenTree.build(text, coder)
        a = rng.randrange(41)
        edits = [(a, min(40, a + rng.randrange(3)), rng.choice(["", "\n", " b"]))]
        tree.apply(edits, coder)
        assert tree.tokens == tokencounts.TokenTree.build(apply(text, edits), coder).tokens
