"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

The vocabulary's normaliser and pre-tokenizer never join text across ASCII white
space, so a text's ids are those of its words in order, and each distinct word need
be encoded once while the cache holds it. A cached word is known by its identity
(``textcore.identities``), so a word never gets the ids of another.

The cut at white space is a property of the tokenizer file: files whose steps are the
ones known here have it; any other file is used by whole texts, without a cache.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np

from . import textcore as tc

#: Beyond these the caches shed what they have met only once.
MAX_CACHED_WORDS = 80_000
MAX_CACHED_PIECES = 200_000
#: Words cut at once.
STEP_WORDS = 30_000

#: Below this code point a file's pattern is run as explicit classes; no letter there
#: changes under NFC, and lower-casing is by character.
PLAIN = 0x250
#: First byte in UTF-8 of the last characters that are all below it.
LAST_LEAD = 0xC8
#: The one pattern known here; a fixed value of the file's format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class HashTable:
    """Open addressing from non-zero 64-bit hashes to places 0, 1, 2 ..., all in arrays."""

    def __init__(self, bits: int = 14):
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.mask, self.size = np.uint64((1 << bits) - 1), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray) -> None:
        """Put down distinct unknown hashes at the next places."""
        if 2 * (self.size + len(h)) > len(self.keys):
            old = np.zeros(self.size, np.uint64)
            used = self.keys != 0
            old[self.values[used]] = self.keys[used]
            self.__init__(int(4 * (self.size + len(h))).bit_length())
            self.add(old)
        todo, place, slot = h, self.size + np.arange(len(h)), (h & self.mask).astype(np.int64)
        self.size += len(h)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = todo[free]
            mine = self.keys[slot] == todo
            self.values[slot[mine]] = place[mine]
            todo, place, slot = todo[~mine], place[~mine], (slot[~mine] + 1) & int(self.mask)

    def hashes(self) -> np.ndarray:
        out, used = np.zeros(self.size, np.uint64), self.keys != 0
        out[self.values[used]] = self.keys[used]
        return out


def byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level models have for each byte: itself where it is
    printable in Latin-1, else the next free code point from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.pattern = self._plain_pattern(json.load(f))
        symbols = byte_symbols()
        self.symbols = str.maketrans({c: "".join(symbols[b] for b in c.encode()) for c in map(chr, range(PLAIN))})
        # Ids of pieces, as bytes: a quarter of what tuples of integers take. Pieces met since the
        # dictionary was last full are in the first one; what is in neither has to be cut again.
        self.kind = "H" if max(self.tokenizer.get_vocab().values(), default=0) < 0xFFFF else "I"
        self.line = array(self.kind, [(1 << 8 * array(self.kind).itemsize) - 1]).tobytes()  # no id: the end of a word
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.clear()

    @staticmethod
    def _plain_pattern(file: dict):
        """The pattern that cuts words into pieces, where the file's steps are the ones
        known here (lower case, a kept pattern, byte symbols); else None."""
        steps = (file.get("normalizer") or {}).get("normalizers", [])
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        if not known or not (cuts[0]["invert"] and cuts[0]["behavior"] == "Removed") or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        if cuts[0]["pattern"].get("Regex") != PIECES:
            return None
        plain = [chr(c) for c in range(PLAIN)]
        letters, numbers = ("".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind) for kind in "LN")
        spaces = "".join(re.escape(c) for c in plain if c.isspace() and not "\x1c" <= c <= "\x1f")
        return re.compile(f"\n|'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{letters}{numbers}{spaces}]+")

    @staticmethod
    def _lowered(words: tc.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): the words at these places in lower case, each with a line feed at its end."""
        start, n = words.starts[at], words.ends[at] - words.starts[at] + 1
        upto = np.cumsum(n)
        data = words.data[np.minimum(np.repeat(start - (upto - n), n) + np.arange(int(upto[-1])), len(words.data) - 1)]
        data[upto - 1] = 10
        low = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
        return low, np.flatnonzero(low == 10)

    def _ids_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of lower-cased lines in one array, number of ids of each)."""
        pieces, known, tokenize = self.pattern.findall(text), self.pieces, self.model.tokenize
        known["\n"] = self.line
        for piece in set(pieces).difference(known):
            ids = self.older.get(piece)
            if ids is None:
                symbols = piece if piece.isascii() and piece.isprintable() else piece.translate(self.symbols)
                ids = array(self.kind, [t.id for t in tokenize(symbols)]).tobytes()
            known[piece] = ids
        flat = np.frombuffer(b"".join(map(known.__getitem__, pieces)), self.kind)
        end = flat == np.frombuffer(self.line, self.kind)
        return flat[~end], np.diff(np.flatnonzero(end), prepend=-1) - 1

    def clear(self):
        self.places = HashTable()
        self.start, self.length, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.a, self.b = (np.zeros(1 << 12, np.uint64) for _ in range(2))
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _shed(self):
        """Keep the words met more than once, at most half of what fits."""
        n = self.places.size
        often = np.flatnonzero(self.met[:n] > 1)
        if len(often) > MAX_CACHED_WORDS // 2:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[: MAX_CACHED_WORDS // 2]])
        hashes, start, length, flat = self.places.hashes()[often], self.start[often], self.length[often], self.flat
        a, b = self.a[often], self.b[often]
        self.clear()
        ends = np.cumsum(length)
        ids = flat[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._put(hashes, a, b, ids, length)
        self.met[: len(often)] = 1

    def _put(self, hashes, a, b, ids: np.ndarray, n: np.ndarray) -> None:
        first, total = self.places.size, len(ids)
        self.places.add(hashes)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + total, np.int32)])
        if first + len(n) > len(self.start):
            grown = [np.concatenate([x, np.zeros(len(x) + len(n), x.dtype)]) for x in (self.start, self.length, self.met, self.a, self.b)]
            self.start, self.length, self.met, self.a, self.b = grown
        self.flat[self.used : self.used + total] = ids
        self.start[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.length[first : first + len(n)] = n
        self.a[first : first + len(n)], self.b[first : first + len(n)] = a, b
        self.used += total

    def _learn(self, words: tc.Words, at: np.ndarray, hashes, a, b) -> None:
        """Encode the words at these places, whose hashes are distinct and unknown."""
        raw = memoryview(words.data)
        for i in range(0, len(at), STEP_WORDS):
            if len(self.pieces) > MAX_CACHED_PIECES:
                self.older, self.pieces = self.pieces, {}
            part = at[i : i + STEP_WORDS]
            low, ends = self._lowered(words, part)
            size = np.diff(ends, prepend=-1)
            whole = np.maximum.reduceat(low, ends - size + 1) > LAST_LEAD
            whole[np.searchsorted(ends, np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|"))))] = True
            plain, rest = part[~whole], part[whole]
            if len(rest):
                found = [self.tokenizer.encode(bytes(raw[s:e]).decode(), add_special_tokens=False).ids for s, e in zip(words.starts[rest].tolist(), words.ends[rest].tolist())]
                n = np.fromiter(map(len, found), np.int64, len(found))
                self._put(hashes[rest], a[rest], b[rest], np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n)
                low = low[np.repeat(~whole, size)]
            if len(plain):
                self._put(hashes[plain], a[plain], b[plain], *self._ids_of(low.tobytes().decode()))

    def _places(self, words: tc.Words) -> np.ndarray:
        """The place of every word in the cache, put there where it was not."""
        a, b = tc.identities(words.data, words.starts, words.ends)
        h = tc.identity_hash(a, b) | np.uint64(1)
        place, todo = np.zeros(len(h), np.int64), np.arange(len(h))
        while len(todo):
            found = self.places.find(h[todo])
            there = found >= 0
            same = there & (self.a[found] == a[todo]) & (self.b[found] == b[todo])
            place[todo[same]] = found[same]
            new, taken = todo[~there], todo[there & ~same]
            if len(new):
                self._learn(words, new[np.unique(h[new], return_index=True)[1]], h, a, b)
            h[taken] = tc.mix(h[taken]) | np.uint64(1)  # another word's hash: try a next one
            todo = np.concatenate([new, taken])
        return place

    def _encode_whole(self, data: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        raw, cut = data.tobytes(), offsets.tolist()
        found = [self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids + end for s, e in zip(cut[:-1], cut[1:])]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk in one array, number of ids of each)."""
        if self.pattern is None:
            return self._encode_whole(data, offsets, [] if end_id is None else [end_id])
        if self.places.size > MAX_CACHED_WORDS:
            self._shed()
        words = tc.Words(data, offsets, tc.SPACE_WORD)
        place = self._places(words)
        if self.places.size:
            self.met[: self.places.size] += np.bincount(place, minlength=self.places.size)
        n = self.length[place]
        extra = 0 if end_id is None else 1
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        each = upto[words.bounds[1:]] - upto[words.bounds[:-1]] + extra
        total = int(upto[-1])
        # Where each id goes: its own number, and the end ids of the texts before.
        source = np.repeat(self.start[place] - upto[:-1], n)
        source += np.arange(total)
        out = np.full(total + extra * len(each), 0 if end_id is None else end_id, np.int32)
        keep = np.ones(len(out), bool)
        if extra:
            keep[np.cumsum(each) - 1] = False
        out[keep] = self.flat[source]
        return out, each


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
