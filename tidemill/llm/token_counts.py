"""Token counts by the whole-token shortcut (op7).

Before a job starts, `proof` runs the merges on every vocabulary string once and keeps a bit for
each that ends as one token; tasks get the bits. A pre-token among those strings counts one, without
merging; only the rest is merged.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.bpe import ByteVocabulary, WordCache
from tidemill.llm.common import arrow_map, table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A cut before a single space between two characters that aren't white space never changes the
#: pre-tokens: the space starts the next one. Anything else keeps its neighbours.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNSURE = re.compile(r"\s\s|^\s|\s$")
_held: dict = {}


def strings(vocabulary: ByteVocabulary) -> list[bytes]:
    """The vocabulary's byte strings, in its order."""
    back = {c: b for b, c in vocabulary.chars.items()}
    return [bytes(back[c] for c in s) for s in vocabulary.vocab if all(c in back for c in s)]


@functools.lru_cache(maxsize=4)
def proof(path: str) -> bytes:
    """A bit for each byte string of the vocabulary: do its merges end in one symbol?"""
    vocabulary = ByteVocabulary(path)
    return np.packbits(vocabulary.encode(strings(vocabulary))[1] == 1).tobytes()


def whole_tokens(vocabulary: ByteVocabulary, bits: bytes) -> set[bytes]:
    """The strings that are proved to encode alone as one token."""
    every = strings(vocabulary)
    return {s for s, ok in zip(every, np.unpackbits(np.frombuffer(bits, np.uint8), count=len(every)).tolist()) if ok}


class Counter:
    def __init__(self, path: str, bits: bytes | None = None):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.vocabulary = ByteVocabulary(path)
        self.whole = whole_tokens(self.vocabulary, bits) if bits is not None else set()
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.first, self.later = WordCache(self.count), WordCache(lambda ws: self.count([" " + w for w in ws]))

    def count(self, pieces: list[str]) -> list[int]:
        out, rest, owner, whole = [0] * len(pieces), [], [], self.whole
        for i, piece in enumerate(pieces):
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                tokens = (piece,)
            elif self.special.search(piece):
                out[i] = len(self.library.encode(piece, add_special_tokens=False).ids)
                continue
            else:
                tokens = self.pattern.findall(piece)
            for token in tokens:
                data = token.encode()
                if data in whole:
                    out[i] += 1
                else:
                    rest.append(data)
                    owner.append(i)
        for i, n in zip(owner, self.vocabulary.encode(rest)[1].tolist()):
            out[i] += n
        return out

    def texts(self, texts: list[str]) -> list[int]:
        cut = [CUT.split(t) if UNSURE.search(t) else t.split(" ") for t in texts]
        self.first.learn({p[0] for p in cut})
        later = set()
        for p in cut:
            later.update(p[1:])
        self.later.learn(later)
        get = self.later.__getitem__
        return [self.first[p[0]] + sum(map(get, p[1:])) for p in cut]


def counter(path: str, bits: bytes | None = None) -> Counter:
    if (path, bits) not in _held:
        _held[path, bits] = Counter(path, bits)
    return _held[path, bits]


def slices(texts: list[str], size: int = 4_000_000):
    """Ranges of texts with about that many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_batches(batches, path: str, bits: bytes, limit: int):
    c = counter(path, bits)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = np.fromiter((x for a, b in slices(texts) for x in c.texts(texts[a:b])), np.int64, len(texts))
        size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    A null or empty text has 0 bytes and 0 tokens. Rows with the same doc_id each give a row; a
    null doc_id stays null. Other columns are ignored. No shuffle; memory is bounded by a batch
    and the word cache.
    """
    return arrow_map(documents.select("doc_id", "text"), "tidemill.llm.token_counts:count_batches", SCHEMA, path=vocabulary, bits=proof(vocabulary), limit=limit)


def query(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
