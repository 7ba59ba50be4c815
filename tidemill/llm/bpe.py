"""Byte-pair encoding of many words at once on flat numpy arrays.

One engine serves three vocabularies: byte-level (tokenizers), byte-level with word ends
(tokenizers) and piece (sentencepiece). All words of a batch lie in one flat symbol array.
Each round looks up the rank of every adjacent pair, takes the segmented minimum per word,
merges all leftmost, non-overlapping occurrences of that pair at once, and compacts; words
without a pair leave the array.

Merging all occurrences of a word's best pair at once equals merging them one by one exactly
when no merge has a rank below that of a merge that makes one of its parts. `Merges` proves
this from the vocabulary when it is loaded; where it fails, only the first occurrence is
merged in a round.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np

NONE = np.iinfo(np.int64).max
#: Bits of a merged id below its rank.
MADE = 24
MASK = (1 << MADE) - 1
#: Words merged together: their arrays stay in a core's cache.
TOGETHER = 10_000


class Merges:
    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], size: int):
        """pairs: (left, right) -> (rank, merged id)."""
        self.size = size
        # an open table with linear probing, at most a quarter full: a pair's place, its key, and its rank above its merged id
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -2), np.full(1 << bits, NONE)
        keys = np.fromiter((a * size + b for a, b in pairs), np.int64, len(pairs))
        for k, at, (rank, made) in zip(keys.tolist(), self.place(keys).tolist(), pairs.values()):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.keys[at], self.values[at] = k, rank << MADE | made
        made_at: dict[int, int] = {}
        for r, m in pairs.values():
            made_at[m] = max(made_at.get(m, -1), r)
        self.at_once = all(r > made_at.get(a, -1) and r > made_at.get(b, -1) for (a, b), (r, _) in pairs.items())

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair in one number, or NONE."""
        key = left * self.size + right
        key[(left | right) < 0] = -1
        at = self.place(key)
        there = self.keys.take(at)
        same = there == key
        out = np.where(same, self.values.take(at), NONE)
        rest = np.flatnonzero(~same & (there >= 0))
        at, key = at[rest], key[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys.take(at)
            same = there == key
            out[rest[same]] = self.values[at[same]]
            on = ~same & (there >= 0)
            rest, at, key = rest[on], at[on], key[on]
        return out

    def encode(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start symbols of all words, flat (negative: a symbol that never merges), and their number
        per word -> final symbols, flat in the same order, and their number per word."""
        total = np.array(n, np.int64)
        name = np.flatnonzero(total)
        n, flat = total[name], []
        sym = sym.astype(np.int64)
        # pair i joins symbols i and i + 1; pairs are kept and only changed places looked up again
        first = np.concatenate([[0], np.cumsum(n)])
        pair = np.full(len(sym), NONE)
        if len(sym) > 1:
            pair[:-1] = self.find(sym[:-1], sym[1:])
        pair[first[1:] - 1] = NONE
        while len(name):
            best = np.minimum.reduceat(pair, first[:-1])
            done = best == NONE
            if done.any():
                ended = np.repeat(done, n)
                flat.append((name[done], n[done], sym[ended]))
                total[name[done]] = n[done]
                keep = ~ended
                sym, pair = sym[keep], pair[keep]
                name, n, best = name[~done], n[~done], best[~done]
                if not len(name):
                    break
                first = np.concatenate([[0], np.cumsum(n)])
            # of the least rank, whatever it makes
            hit = np.flatnonzero(pair <= np.repeat(best | MASK, n))
            word = np.searchsorted(first, hit, side="right") - 1
            if self.at_once:
                # in a run of neighbouring hits (one symbol repeated) every second one merges
                new_run = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(word) != 0)])
                start = hit[np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))]
                take = (hit - start) % 2 == 0
            else:
                take = np.concatenate([[True], np.diff(word) != 0])
            hit, word = hit[take], word[take]
            sym[hit] = pair[hit] & MASK
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after compaction: one symbol gone per earlier hit
            sym, pair = sym[keep], pair[keep]
            n = n - np.bincount(word, minlength=len(n))
            first = np.concatenate([[0], np.cumsum(n)])
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near < len(sym) - 1]
            pair[near] = self.find(sym[near], sym[near + 1])
            pair[first[1:] - 1] = NONE
        start = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(start[-1], np.int64)
        for names, counts, symbols in flat:
            inside = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
            out[np.repeat(start[names], counts) + inside] = symbols
        return out, total


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class ByteVocabulary:
    """A byte-level tokenizers file: start symbols of a pre-token's bytes, and its merges."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        chars = byte_chars()
        self.inner = np.array([self.vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[chars[b] + suffix] for b in range(256)], np.int64)
        self.merges = Merges(pairs, max(self.vocab.values()) + 1)
        self.chars = chars

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and their number per word."""
        if len(words) > TOGETHER:
            parts = [self.encode(words[at:at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(n)[n > 0] - 1
        sym[ends] = self.last[raw[ends]]
        return self.merges.encode(sym, n)


class WordCache(dict):
    """Word -> value with bounded memory: a full generation becomes the old one.

    `fill(words)` computes values for a list of words at once.
    """

    def __init__(self, fill, limit: int = 400_000):
        super().__init__()
        self.fill, self.limit, self.old = fill, limit, {}

    def learn(self, words) -> None:
        """Make every word of a batch present, computing the missing ones together."""
        new = set(words).difference(self)
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.old = dict(self)
            self.clear()
            new = set(words)
        again = self.old.keys() & new
        self.update(zip(again, map(self.old.__getitem__, again)))
        new = list(new - again)
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            self.update(zip(part, self.fill(part)))


class TokenCache(WordCache):
    """Pre-token -> its little-endian 32-bit ids. Words with the same pre-tokens, with other marks or
    in other cases, share their merges."""

    def __init__(self, vocabulary: ByteVocabulary, limit: int = 400_000):
        super().__init__(self.merged, limit)
        self.vocabulary = vocabulary

    def merged(self, tokens: list[bytes | str]) -> list[bytes]:
        ids, n = self.vocabulary.encode([t if isinstance(t, bytes) else t.encode() for t in tokens])
        ids, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def joined(self, tokens: list[bytes | str], counts: list[int]) -> list[bytes]:
        """The ids of so many tokens each, one word after another."""
        self.learn(tokens)
        get = iter(map(self.__getitem__, tokens))
        return [next(get) if k == 1 else b"".join(islice(get, k)) for k in counts]
