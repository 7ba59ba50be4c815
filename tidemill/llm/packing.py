"""Packing by cutting-stock column generation (op2).

Documents become token ids plus an end id and are cut into full sequences and one remainder
each. The remainders are a cutting-stock problem over a bounded histogram: size classes of
GRAIN tokens. A linear program over patterns (how many of each class share a sequence) is
solved by column generation: a knapsack dynamic programme prices new columns from the duals.
Patterns are rounded down and assigned to documents by their rank within their class; what
rounding leaves over, a number bounded by the patterns' sizes, is packed by first fit
decreasing on the histogram. Only the histogram and the pattern table, both of bounded size,
are on the driver.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe import ByteVocabulary, TokenCache, WordCache
from tidemill.llm.common import arrow_map, table, written

CAPACITY = 2048
GRAIN = 4
PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"
_held: dict = {}


class WordEncoder:
    """Ids of whole texts for a lower-casing, white-space-dropping byte-level vocabulary.

    Tokens never span white space, so each distinct word is encoded once per cache generation.
    Words of plain Latin letters and ASCII go through the flat merge engine, others through
    the tokenizers library, whose Unicode tables then hold.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = ByteVocabulary(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.plain = regex.compile(r"[!-~¡-ɏ]+")
        # fixed value: the pre-token pattern of this vocabulary
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.tokens = TokenCache(self.vocabulary)
        self.cache = WordCache(self.fill)

    def fill(self, words: list[bytes]) -> list[bytes]:
        every = b" ".join(words)
        special = [s for s in self.special if s in every]
        out: list = [b""] * len(words)
        tokens, counts, at = [], [], []
        for i, (raw, small) in enumerate(zip(words, every.lower().split(b" "))):
            # plain words, with or without a mark after them, need no pattern
            if small.isalpha():
                tokens.append(small)
                k = 1
            elif small[:-1].isalpha() and small[-1] in b".,;:!?":
                tokens += (small[:-1], small[-1:])
                k = 2
            else:
                word = raw.decode("utf-8", "replace")
                if not self.plain.fullmatch(word) or special and any(s in raw for s in special):
                    out[i] = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
                    continue
                word = "".join([c.lower() for c in word]) if "Σ" in word else word.lower()
                if word.isalpha():
                    tokens.append(word.encode())
                    k = 1
                elif word[-1] in ".,;:!?" and word[:-1].isalpha():
                    tokens += (word[:-1].encode(), word[-1].encode())
                    k = 2
                else:
                    found = self.pattern.findall(word)
                    tokens += [t.encode() for t in found]
                    k = len(found)
            counts.append(k)
            at.append(i)
        for i, ids in zip(at, self.tokens.joined(tokens, counts)):
            out[i] = ids
        return out

    def texts(self, texts: list[str]):
        """Little-endian 32-bit ids of each text."""
        split = [t.encode().split() for t in texts]
        every: set = set()
        for words in split:
            every.update(words)
        self.cache.learn(every)
        get = self.cache.__getitem__
        for words in split:
            yield b"".join(map(get, words))


def encoder(path: str) -> WordEncoder:
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def piece_batches(batches, path: str, capacity: int, end_id: int):
    from tidemill.llm.token_counts import slices

    e = encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        docs = batch.column("doc_id").to_pylist()
        rows = []
        for a, b in slices(texts):
            for doc, ids in zip(docs[a:b], e.texts(texts[a:b])):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), total))
        cols = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, pa.int64()) for c in cols]
        arrays.insert(1, pa.array(np.arange(len(rows)), pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])


def price(sizes: np.ndarray, dual: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity, and the item taken there (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        value = best[c - sizes[:k]] + dual[:k]
        j = int(np.argmax(value))
        best[c] = best[c - 1]
        if value[j] > best[c] + 1e-12:
            best[c], pick[c] = value[j], j
    return best, pick


def first_fit(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First fit decreasing on a histogram: (pattern over sizes, uses)."""
    left, out = np.array(demand, np.int64), []
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        while room:
            fits = np.flatnonzero(left[:room] > pattern[:room])
            if not len(fits):
                break
            i = int(fits[-1])
            k = min(int(left[i] - pattern[i]), room // (i + 1))
            pattern[i] += k
            room -= (i + 1) * k
        used = np.flatnonzero(pattern)
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


def solve(demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 500, columns: int = 30, smooth: float = 0.9) -> list[tuple[np.ndarray, float]]:
    """Fractional cutting stock. demand[i]: items of size i + 1 -> [(pattern over sizes, uses)].

    Revised simplex with an explicit basis inverse, begun with the patterns of first fit decreasing. One run of the knapsack prices many columns: the
    best pattern around each size. Prices are taken between the present duals and those of the best
    bound so far, which damps their swings. Stops once Farley's bound proves the relative gap small.
    """
    sizes = np.flatnonzero(demand) + 1
    d = demand[sizes - 1].astype(float)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ d

    def enter(column: np.ndarray) -> bool:
        """Take a column into the basis if the present duals favour it."""
        if inverse.sum(axis=0) @ column <= 1 + 1e-7:
            return False
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            return False
        step = ratio[out]
        x[:] = x - step * direction
        x[out] = step
        pivot = inverse[out] / direction[out]
        inverse[:] -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
        return True

    start = [pattern[sizes - 1].astype(float) for pattern, _ in first_fit(demand, capacity)]
    for _ in range(20):
        if not any([enter(column) for column in start]):
            break
    centre, bound, missed = np.zeros(m), 0.0, False
    for _ in range(rounds):
        now = inverse.sum(axis=0)
        dual = now if missed or not bound else np.maximum(smooth * centre + (1 - smooth) * now, 0)
        best, pick = price(sizes, dual, capacity)
        if dual @ d / best[capacity] > bound:
            bound, centre = dual @ d / best[capacity], dual / best[capacity]
        if x.sum() <= bound * (1 + gap):
            break
        around, moved = best[capacity - sizes] + dual, False
        for j in np.argsort(-around)[:columns]:
            column, c = np.zeros(m), capacity - sizes[j]
            column[j] = 1
            while c > 0:
                if pick[c] < 0:
                    c -= 1
                else:
                    column[pick[c]] += 1
                    c -= sizes[pick[c]]
            moved |= enter(column)
        if not moved and dual is now:
            break
        missed = not moved
    out = []
    for j in range(m):
        pattern = np.zeros(len(demand), np.int64)
        pattern[sizes - 1] = basis[:, j]
        out.append((pattern, float(x[j])))
    return out


def assign(counts: dict[int, int], capacity: int, grain: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first rank, end rank, first sequence, items per sequence, slot) for every class."""
    classes = capacity // grain
    left = np.zeros(classes, np.int64)
    for c, n in counts.items():
        left[c - 1] += n
    used, rows, sequence = np.zeros(classes, np.int64), [], 0

    def give(pattern, times):
        nonlocal sequence
        slot = 0
        for i in np.flatnonzero(pattern):
            k = int(pattern[i])
            rows.append((int(i) + 1, int(used[i]), int(used[i]) + k * times, sequence, k, slot))
            used[i] += k * times
            left[i] -= k * times
            slot += k
        sequence += times

    full = np.zeros(classes, np.int64)
    full[-1] = 1
    if left[-1]:
        give(full, int(left[-1]))
    if left.any():
        for pattern, x in sorted(solve(left, classes), key=lambda p: -p[1]):
            times = int(x + 1e-7)
            if times:
                inside = [left[i] // pattern[i] for i in np.flatnonzero(pattern)]
                times = min(times, int(min(inside)))
            if times:
                give(pattern, times)
    for pattern, times in first_fit(left.copy(), classes):  # what rounding left
        give(pattern, times)
    return rows


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with the same doc_id (or a null one) are
    packed as separate documents. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    pieces = written(arrow_map(documents.select("doc_id", "text"), "tidemill.llm.packing:piece_batches", PIECES, path=vocabulary, capacity=capacity, end_id=end_id)
                     .withColumn("class", F.ceil(F.col("length") / F.lit(grain)).cast("int")), "pieces")
    # at most capacity / grain rows: bounded whatever the corpus
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    rows = assign(counts, capacity, grain)
    # a class with very many members is ranked in parts of about 100,000 pieces
    parts = 1 + max(counts.values(), default=0) // 100_000
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    before = (pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
              .select("class", "part", F.coalesce("before", F.lit(0)).alias("before")))
    inside = Window.partitionBy("class", "part").orderBy("doc_id", "start", "copy")
    ranked = pieces.join(before, ["class", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    plan = spark.createDataFrame(rows, "class int, r0 long, r1 long, first_sequence long, k long, slot long")
    same = ranked["class"] == plan["class"]
    placed = (ranked.join(F.broadcast(plan), same & (ranked["rank"] >= plan["r0"]) & (ranked["rank"] < plan["r1"]))
              .withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("r0")) / F.col("k")))
              .withColumn("slot", F.col("slot") + F.pmod(F.col("rank") - F.col("r0"), F.col("k"))))
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).alias("offset"))


def query(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
