"""Token ids on disk, in blocks of the context-mixing range coder (op4).

Documents are dealt by ranges of doc_id and sorted, so the files' order is that of doc_id. A
part's ids are cut into blocks of BLOCK ids, wherever documents end; each has the ids and lengths of
the documents in it. A damaged or lost block costs no other. Blocks lie in a table in the shared
folder, so that any store Spark writes to will do.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.bpe import TokenCache, WordCache
from tidemill.llm.common import arrow_map, table, written
from tidemill.llm.range_coder import LANES, pack_blocks, unpack_blocks
from tidemill.llm.token_counts import CUT, counter, slices

BLOCK = 4096
#: Distinct words, and pre-tokens, whose ids are kept, in each of two generations.
WORDS = 250_000
BLOCKS = "part int, block int, before long, documents long, n_ids long, data binary"
PIECES = "part int, document long, doc_id long, start long, n_ids long"
_held: dict = {}


class IdEncoder:
    """Ids of whole texts for a byte-level vocabulary, each distinct piece once per cache generation."""

    def __init__(self, path: str):
        self.counter = counter(path)
        self.tokens = TokenCache(self.counter.vocabulary, WORDS)
        self.first, self.later = WordCache(lambda ws: self.fill(ws, ""), WORDS), WordCache(lambda ws: self.fill(ws, " "), WORDS)

    def fill(self, words: list[str], before: str) -> list[bytes]:
        c, out, tokens, counts, at = self.counter, [b""] * len(words), [], [], []
        special = c.special.search("\n".join(words))
        for i, word in enumerate(words):
            # plain words, with or without a mark after them, need no pattern
            if word.isalpha():
                tokens.append(before + word)
                k = 1
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                tokens += (before + word[:-1], word[-1])
                k = 2
            elif special and c.special.search(word):
                out[i] = np.array(c.library.encode(before + word, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            else:
                found = c.pattern.findall(before + word)
                tokens += found
                k = len(found)
            counts.append(k)
            at.append(i)
        for i, ids in zip(at, self.tokens.joined(tokens, counts)):
            out[i] = ids
        return out

    def texts(self, texts: list[str]):
        cut = []
        for t in texts:
            words = t.split()
            # white space stands alone, and only between words
            sure = sum(map(len, words)) + len(words) - 1 == len(t)
            cut.append(t.split(" ") if sure else CUT.split(t))
        self.first.learn({p[0] for p in cut})
        later: set = set()
        for p in cut:
            later.update(p[1:])
        self.later.learn(later)
        get = self.later.__getitem__
        for p in cut:
            yield self.first[p[0]] + b"".join(map(get, p[1:]))


def encoder(path: str) -> IdEncoder:
    if path not in _held:
        _held[path] = IdEncoder(path)
    return _held[path]


def block_batches(batches, path: str, end_id: int):
    from pyspark import TaskContext

    e, part = encoder(path), TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    # the open block: doc ids, their ids, whether the first goes on; then finished blocks, with the documents begun before
    docs, ids, goes_on, held, begun, first = [], [], False, 0, 0, 0
    waiting, before, number = [], 0, 0

    def flush():
        nonlocal waiting, before, number
        data = pack_blocks([w[:3] for w in waiting])
        sizes = [sum(map(len, w[1])) for w in waiting]
        starts = before + np.cumsum([0, *sizes])
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int32()), pa.array(range(number, number + len(data)), pa.int32()), pa.array(starts[:-1], pa.int64()),
                                          pa.array([w[3] for w in waiting], pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], [c.split()[0] for c in BLOCKS.split(", ")])
        before, number, waiting = int(starts[-1]), number + len(data), []

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        names = batch.column("doc_id").to_pylist()
        for a, b in slices(texts):
            for doc, got in zip(names[a:b], e.texts(texts[a:b])):
                rest = np.frombuffer(got + end, "<u4")
                begun += 1
                while len(rest):
                    part_of, rest = rest[:BLOCK - held], rest[BLOCK - held:]
                    docs.append(doc)
                    ids.append(part_of)
                    held += len(part_of)
                    if held == BLOCK:
                        waiting.append((docs, ids, goes_on, first))
                        docs, ids, held, goes_on, first = [], [], 0, len(rest) > 0, begun - (len(rest) > 0)
                        if len(waiting) >= LANES:
                            yield from flush()
    if docs:
        waiting.append((docs, ids, goes_on, first))
    if waiting:
        yield from flush()


def full_batches(batches):
    """The same rows, as many at a time as are decoded in step."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= LANES:
            t = pa.Table.from_batches(held)
            yield t.slice(0, LANES).combine_chunks().to_batches()[0]
            held, n = t.slice(LANES).to_batches(), n - LANES
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read_batches(batches):
    """Pieces of documents, as they lie in blocks, with their ids."""
    for batch in full_batches(batches):
        start = (batch.column("before").to_numpy() + batch.column("base").to_numpy()).tolist()
        parts, begun, data = batch.column("part").to_pylist(), batch.column("documents").to_pylist(), batch.column("data")
        for a in range(0, batch.num_rows, LANES):
            rows = []
            for part, document, at, (docs, texts, _) in zip(parts[a:a + LANES], begun[a:a + LANES], start[a:a + LANES], unpack_blocks(data.slice(a, LANES).to_pylist())):
                for doc, ids in zip(docs, texts):
                    rows.append((part, document, doc, at, len(ids), ids))
                    at += len(ids)
                    document += 1
            columns = list(zip(*rows))
            kinds = [pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([i.view(np.int32) for i in columns[5]], pa.list_(pa.int32()))], [*(c.split()[0] for c in PIECES.split(", ")), "ids"])


def crc_batches(batches):
    for batch in read_batches(batches):
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy().astype("<i4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(crc, pa.int64())], [*batch.schema.names[:5], "crc"])


@functools.lru_cache(maxsize=2 * BLOCK)
def zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes do to each bit of a crc32, without its final inversions."""
    if n == 1:
        return tuple(zlib.crc32(b"\0", (1 << k) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(32))
    half = zeros(n // 2)
    out = tuple(through(half, x) for x in half)
    return tuple(through(zeros(1), x) for x in out) if n % 2 else out


def through(columns: tuple[int, ...], x: int) -> int:
    out, k = 0, 0
    while x:
        if x & 1:
            out ^= columns[k]
        x >>= 1
        k += 1
    return out


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """crc32 of byte strings one after another, from (bytes, crc32) of each."""
    out = pieces[0][1]
    for n, crc in pieces[1:]:
        out = through(zeros(n), out) ^ crc
    return out


def digest_batches(batches):
    for batch in batches:
        crc = [joined_crc([(4 * p["n_ids"], p["crc"]) for p in sorted(ps, key=lambda p: p["start"])]) for ps in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write(documents: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write coded blocks of every document's ids, in ascending doc_id order, to the shared folder."""
    place = ["doc_id", F.xxhash64("text")]  # rows that share an id may be many: the text deals them too
    dealt = documents.select("doc_id", "text").repartitionByRange(*place).sortWithinPartitions(*place)
    return written(arrow_map(dealt, "tidemill.llm.token_ids:block_batches", BLOCKS, path=vocabulary, end_id=end_id), "token-blocks")


def placed(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of ids in all parts before theirs: one row per part on the driver."""
    base, rows = 0, []
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):
        rows.append((r["part"], base))
        base += r["n"]
    return blocks.join(F.broadcast(blocks.sparkSession.createDataFrame(rows, "part int, base long")), "part").select("part", "before", "base", "documents", "data")


def read(blocks: DataFrame) -> DataFrame:
    """Pieces of documents, one for each block that holds some of its ids: part and document (which together
    name the document), doc_id, start (ids before the piece in all files), n_ids, ids (array<int>)."""
    return arrow_map(placed(blocks), "tidemill.llm.token_ids:read_batches", PIECES + ", ids array<int>")


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files.

    A null or empty text is the end id alone. A null doc_id comes before all others; rows with the
    same doc_id follow each other in no fixed order. A document of any length is cut over blocks. An empty
    table gives no rows. Other columns are ignored.
    """
    pieces = arrow_map(placed(write(documents, vocabulary)), "tidemill.llm.token_ids:crc_batches", PIECES + ", crc long")
    whole = pieces.groupBy("part", "document").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_ids").alias("n_tokens"), F.collect_list(F.struct("start", "n_ids", "crc")).alias("pieces"))
    return arrow_map(whole.select("doc_id", "start", "n_tokens", "pieces"), "tidemill.llm.token_ids:digest_batches", "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
