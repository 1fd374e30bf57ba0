"""Byte-pair merges of many words at once, for the packing operator.

Words of about one length are the columns of a matrix of symbols. In each round every word that
still has a mergeable pair merges its pair of least rank, the leftmost if several have it, so a
word gets the tokens that merging it alone would give.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

#: Words of more bytes are left to the library. Places in a word take six bits of a key.
LONGEST = 48
#: Lengths at which the words are parted, and symbols of a matrix.
LENGTHS = (4, 6, 8, 10, 12, 16, 24, 32, LONGEST)
SYMBOLS = 200_000
_NONE = 1 << 24
_END = 0xFFFF


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves,
    the others are numbered from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairTable:
    """Rank by pair of symbols: hash tables of which each takes what collides in the one before."""

    def __init__(self, keys: np.ndarray):
        left, bits, self.levels = np.arange(len(keys)), 19, []
        while len(left):
            slots = self._slot(keys[left], bits)
            own, first = np.unique(slots, return_index=True)
            table = np.full(1 << bits, np.uint64(0xFFFFFFFF << 32 | _NONE), "u8")
            table[own] = keys[left][first].astype("u8") << np.uint64(32) | left[first].astype("u8")
            self.levels.append((bits, table))
            left, bits = np.delete(left, first), max(bits - 4, 6)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1 + 2 * bits)) >> np.uint32(32 - bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype("u4") << np.uint32(16) | right.astype("u4")
        found = np.full(len(keys), _NONE, "i4")
        for bits, table in self.levels:
            there = table[self._slot(keys, bits)]
            np.copyto(found, there.astype("u4").view("i4"), where=(there >> np.uint64(32)).astype("u4") == keys)
        return found


class WordMerger:
    """Token ids of words by the merges of a ``tokenizers`` BPE file with a mark at the end of words."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, mark = model["vocab"], model["end_of_word_suffix"]
        if max(vocabulary.values()) >= _END:
            raise ValueError("the vocabulary is too large for 16-bit symbols")
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        characters = byte_characters()
        self.inner = np.array([vocabulary[c] for c in characters], "i4")
        self.final = np.array([vocabulary[c + mark] for c in characters], "i4")
        self.pairs = PairTable(np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], "u4"))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], "i4")

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, large_strings of 1 to LONGEST bytes, and where each word's begin and end."""
        offsets = np.frombuffer(words.buffers()[1], "i8")[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", "u1")
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], LENGTHS, "right")
        counts, made, done = np.zeros(len(words), "i8"), [], []
        for length, lo, hi in zip(LENGTHS, [0, *cuts], cuts, strict=False):
            step = max(SYMBOLS // length, 1)
            for at in range(lo, hi, step):
                own = order[at : min(at + step, hi)]
                ids, size = self._merge(raw, offsets[own], sizes[own], length)
                counts[own] = size
                made.append(ids)
                done.append(own)
        # the ids lie by length of word; put them in the order of the words
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(ends[-1], "u4")
        for own, ids in zip(done, made, strict=True):
            n = counts[own]
            flat[np.repeat(ends[own] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, ends

    def _merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int):
        n, place = len(size), np.arange(length + 1, dtype="i4")[:, None]
        inside, last = place < size, place == size - 1
        byte = raw[np.where(inside, start + place, start)]
        symbols = np.where(last, self.final[byte], self.inner[byte])
        symbols[~inside] = _END  # row ``length`` stands before the first and after the last symbol
        after = np.where(last, length, place + 1).astype("i4")
        before = np.where(place == 0, length, place - 1).astype("i4") + np.zeros((1, n), "i4")
        key = np.full((length + 1, n), _NONE << 6, "i4")
        key[:-1] = (self.pairs.ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(length, n) << 6) | place[:-1]
        columns, counts, ids, whose = np.arange(n), np.zeros(n, "i8"), [], []
        while n:
            best = key[:-1].min(axis=0)
            own = np.flatnonzero(best < _NONE << 6)
            if 2 * len(own) < n:  # set the finished words aside
                finished = np.ones(n, bool)
                finished[own] = False
                there = symbols[:-1, finished].T
                alive = there != _END
                counts[columns[finished]] = alive.sum(axis=1)
                ids.append(there[alive])
                whose.append(columns[finished])
                symbols, after, before, key = (np.take(x, own, axis=1) for x in (symbols, after, before, key))
                columns, best, n, own = columns[own], best[own], len(own), np.arange(len(own))
                if not n:
                    break
            s, a, b, k = (x.reshape(-1) for x in (symbols, after, before, key))
            row = best[own] & 63
            at = row * n + own
            gone = a[at] * n + own
            s[at] = self.merged[best[own] >> 6]
            s[gone] = _END
            k[gone] = _NONE << 6
            right = a[gone]
            a[at] = right
            beyond = right * n + own
            b[beyond] = row
            left = b[at]
            ahead = left * n + own
            ranks = self.pairs.ranks(np.concatenate((s[at], s[ahead])), np.concatenate((s[beyond], s[at])))
            k[at] = ranks[: len(own)] << 6 | row
            k[ahead] = ranks[len(own) :] << 6 | left
        if not ids:
            return np.zeros(0, "u4"), counts
        whose, flat = np.concatenate(whose), np.concatenate(ids)
        ends, size = np.cumsum(counts), counts[whose]
        out = np.empty(len(flat), "u4")
        out[np.repeat(ends[whose] - size - np.cumsum(size) + size, size) + np.arange(len(flat))] = flat
        return out, counts
