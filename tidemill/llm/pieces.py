"""Sentencepiece encoding and decoding by vectorised merge rounds (op10).

A text is cut before each space run that follows another character; no piece of the
vocabulary crosses such a cut (proved when the model is loaded), so words are encoded alone,
each distinct word once per cache generation, all together in `bpe.Merges.encode`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.bpe import Merges, WordCache
from tidemill.llm.common import arrow_map, table
from tidemill.llm.token_counts import slices

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
WORDS = re.compile(r" *[^ ]+| +")
_held: dict = {}


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        normal = {library.id_to_piece(i): i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
        self.bytes = np.full(256, -1, np.int64)
        for i in range(n):
            if library.is_byte(i):
                self.bytes[int(library.id_to_piece(i)[3:5], 16)] = i
        probe = "  a  b\n cﬁ　"
        if (self.bytes < 0).any() or library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("this model normalises text or has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece crosses a word's start")
        # single characters that occur only inside pieces get ids of their own and fall back to bytes
        self.ids = dict(normal)
        for p in normal:
            for c in p:
                self.ids.setdefault(c, len(self.ids) + n)
        order = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in normal.values()}))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[-library.get_score(i)], i)
        self.merges = Merges(pairs, max(self.ids.values()) + 1)
        self.start = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.start[ord(p)] = i
        self.n = n
        self.text = [str(i) for i in range(n)]
        self.piece = [b""] * n
        for p, i in normal.items():
            self.piece[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.piece[i] = bytes([b])
        self.char = {i: p for p, i in self.ids.items() if i >= n}
        self.cache = WordCache(self.fill)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, given with its leading spaces as U+2581."""
        sym, n = self.merges.encode(self.start[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)], np.fromiter(map(len, words), np.int64, len(words)))
        flat, at, out = sym.tolist(), 0, []
        known = self.n
        plain = bool(len(sym) == 0 or (sym.min() >= 0 and sym.max() < known))
        for k in n.tolist():
            ids = flat[at:at + k]
            at += k
            if not plain and any(i < 0 or i >= known for i in ids):
                ids = [j for i in ids for j in ([i] if 0 <= i < known else self.bytes[list((chr(-1 - i) if i < 0 else self.char[i]).encode())].tolist())]
            out.append(ids)
        return out

    def fill(self, words: list[str]) -> list[tuple[str, bytes]]:
        text, piece = self.text, self.piece
        return [(",".join([text[i] for i in ids]), self.decode_ids(ids)) for ids in self.encode_words([w.replace(" ", SPACE) for w in words])]

    def decode_ids(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, before the leading space of a whole text goes."""
        piece = self.piece
        return b"".join([piece[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text:
            return WORDS.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def texts(self, texts: list[str]):
        """(number of ids, decimal ids joined by commas, decoded text in UTF-8) of each text."""
        cut = [self.cut(t) for t in texts]
        every: set = set()
        for words in cut:
            every.update(words)
        self.cache.learn(every)
        get = self.cache.__getitem__
        for words in cut:
            got = list(map(get, words))
            ids = ",".join([g[0] for g in got])
            back = b"".join([g[1] for g in got])
            yield (ids.count(",") + 1 if ids else 0), ids, back[1:] if back[:1] == b" " else back


def model(path: str) -> PieceModel:
    if path not in _held:
        _held[path] = PieceModel(path)
    return _held[path]


def encode_batches(batches, path: str):
    m = model(path)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n, ids, back = [], [], []
        for a, b in slices(texts):
            for k, i, t in m.texts(texts[a:b]):
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                back.append(hashlib.sha256(t).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def id_batches(batches, path: str):
    m = model(path)
    for batch in batches:
        out = []
        for t in batch.column("text").to_pylist():
            out.append([i for ids in m.encode_words([w.replace(" ", SPACE) for w in m.cut(t or "")]) for i in ids])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


def decode_batches(batches, path: str):
    m = model(path)
    for batch in batches:
        out = []
        for ids in batch.column("ids").to_pylist():
            t = m.decode_ids(ids or [])
            out.append((t[1:] if t[:1] == b" " else t).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; a null or empty text has no ids."""
    return arrow_map(documents.select("doc_id", "text"), "tidemill.llm.pieces:id_batches", "doc_id long, ids array<int>", path=vocabulary)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of ids made by encode(); null ids give an empty text."""
    return arrow_map(encoded.select("doc_id", "ids"), "tidemill.llm.pieces:decode_batches", "doc_id long, text string", path=vocabulary)


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over each whole text.

    A null or empty text has no ids. Rows with the same doc_id each give a row; other columns are
    ignored. No shuffle; memory is bounded by a batch and the word cache.
    """
    return arrow_map(documents.select("doc_id", "text"), "tidemill.llm.pieces:encode_batches", SCHEMA, path=vocabulary)


def query(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
