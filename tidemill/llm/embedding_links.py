"""Embedding near-duplicates by spherical-cap filters (op5).

A filter is a direction from a product code: the vector is rotated by a seeded rotation and cut
into blocks, each block has its own random code, and a direction joins one code word per block.
Independent codes keep a vector that lies badly for one of them from being missed.
List decoding finds, from sorted inner products per block, every direction whose inner product
with the vector exceeds the threshold. Vectors that share a filter (and a label) meet and are
verified by exact cosine; a pair that shares several filters is counted at the smallest one.
The code grows with the number of vectors, so that there are filters for all of them. The threshold
is tried on pairs at the least cosine for each dimension and code, so that recall doesn't fall as
the code grows; what a cap then holds follows from it.
Equal vectors are one class, and never make pairs among themselves.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_map, connected_components, maybe_small, table, written
from tidemill.llm.simhash import groups, merge_labels

COSINE = 0.93
#: Filters of a code for each CAP vectors.
PASSED, CAP = 14, 64
#: Pairs on which the threshold is tried, and how many of them must share a filter.
TRIALS, RECALL = 600, 0.997
BLOCK, TILE = 4096, 512
#: Names of filters; beyond so many, filters share names, which only adds candidates.
NAMES = 2**31 - 1


def plan(rows: int) -> tuple[int, int]:
    """(blocks, code words per block) for so many vectors."""
    filters = PASSED * max(1 / 0.00135, max(rows, 1) / CAP)
    blocks = 2 if filters <= 1e6 else 3 if filters <= 1e9 else 4
    return blocks, math.ceil(filters ** (1 / blocks))


def codes(blocks: int) -> int:
    """Independent codes: more blocks are less often alike, and vectors lie badly for a code more often."""
    return 3 if blocks == 2 else 8


@functools.lru_cache(maxsize=32)
def code(dim: int, blocks: int, words: int, seed: int):
    rng = np.random.default_rng([seed, dim, blocks, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    books = []
    for a, b in zip(cuts, cuts[1:]):
        book = rng.standard_normal((words, b - a))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(blocks))
    return rotation, cuts, books


@functools.lru_cache(maxsize=64)
def threshold(dim: int, blocks: int, words: int) -> float:
    """The part of its reach a vector's filters must exceed for RECALL of the pairs at COSINE to share one, by trial."""
    rng = np.random.default_rng([dim, blocks, words])
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, TRIALS, dim)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = COSINE * x + math.sqrt(1 - COSINE * COSINE) * y / np.linalg.norm(y, axis=1, keepdims=True)
    best, level = np.full(TRIALS, -1.0), 1.0
    while level > 0.04:
        level -= 0.04
        # pairs that already share a filter above a higher level are done
        at = np.flatnonzero(best < 0)
        for seed in range(codes(blocks)):
            for k, (a, s), (b, t) in zip(at, decode_one(x[at], blocks, words, level, seed), decode_one(y[at], blocks, words, level, seed)):
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                if len(i):
                    best[k] = max(best[k], np.minimum(s[i], t[j]).max())
        if (best >= level).mean() >= RECALL:
            break
    return math.floor(1000 * np.sort(best)[int((1 - RECALL) * TRIALS)]) / 1000


def decode(unit: np.ndarray, blocks: int, words: int, level: float | None = None) -> list[np.ndarray]:
    """All filters whose direction exceeds the threshold, ascending, for each row of unit."""
    dim = unit.shape[1]
    if dim < 4 * blocks:  # too few dimensions for a code: all meet in one filter
        return [np.zeros(1, np.int32)] * len(unit)
    level = threshold(dim, blocks, words) if level is None else level
    found = [decode_one(unit, blocks, words, level, seed) for seed in range(codes(blocks))]
    return [np.unique(np.concatenate([f + k * words**blocks for k, (f, _) in enumerate(of)]) % NAMES).astype(np.int32) for of in zip(*found)]


def decode_one(unit: np.ndarray, blocks: int, words: int, level: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(filters, inner products as parts of the reach) of each row. The reach is the inner product with a direction
    that has the best word in every block: unequal blocks lower it, and with it what is asked of the vector."""
    dim = unit.shape[1]
    rotation, cuts, books = code(dim, blocks, words, seed)
    turned = unit @ rotation
    scores = [turned[:, a:b] @ book.T for (a, b), book in zip(zip(cuts, cuts[1:]), books)]
    reach = sum(np.linalg.norm(turned[:, a:b], axis=1) for a, b in zip(cuts, cuts[1:])) / math.sqrt(blocks)
    out = []
    for row in range(len(unit)):
        name, total, need = np.zeros(1, np.int64), np.zeros(1), level * reach[row]
        best_rest = np.cumsum([s[row].max() for s in scores][::-1])[::-1]
        for k, s in enumerate(scores):
            order = np.argsort(-s[row])
            ranked = s[row][order]
            # prefixes that can't reach the threshold with the best of the blocks to come are left
            rest = best_rest[k + 1] if k + 1 < blocks else 0.0
            count = np.searchsorted(-ranked, -(need - rest - total), side="right")
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            total = np.repeat(total, count) + ranked[inside]
            name = np.repeat(name, count) * words + order[inside]
        out.append((name, total / reach[row]))
    return out


def filter_batches(batches, blocks: int, words: int, levels: dict, whole: bool):
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = batch.column("embedding").offsets.to_numpy()
        flat = batch.column("embedding").values.to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.diff(offsets)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = flat[offsets[at][:, None] + np.arange(dim)]
            names = decode(x / np.linalg.norm(x, axis=1, keepdims=True), blocks, words, levels.get(int(dim)))
            n = np.fromiter(map(len, names), np.int64, len(names))
            rows = np.repeat(at, n)
            every = np.concatenate(names)
            if not whole:
                part = batch.column("label").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(rows), dim), pa.int64()), pa.array(every)], ["label", "dim", "filter"])
                continue
            owner = np.repeat(np.arange(len(at)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            for a in range(0, len(rows), 4096):
                part = batch.take(pa.array(rows[a:a + 4096]))
                # the filters below this one tell whether a pair has met before
                lists = pa.array([names[i][:k] for i, k in zip(owner[a:a + 4096], place[a:a + 4096])], pa.list_(pa.int32()))
                ids = every[a:a + 4096]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.full(len(part), dim), pa.int64()), pa.array(ids), part.column("first"), part.column("copies"), part.column("embedding"), lists], ["label", "dim", "filter", "first", "copies", "embedding", "filters"])


def new_pairs(hit: np.ndarray, left: list, right: list) -> np.ndarray:
    """Of the hits (i, j) of a tile, those that share no filter below this one; left and right have those filters."""
    i, j = np.nonzero(hit)
    if not len(i):
        return hit
    rows, cols = np.unique(i), np.unique(j)
    sets = [*(left[k] for k in rows), *(right[k] for k in cols)]
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    if not len(every):
        return hit
    has = np.zeros((len(sets), len(every)), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    has = has[:, has.sum(axis=0) > 1]
    shared = has[:len(rows)] @ has[len(rows):].T > 0
    out = hit.copy()
    out[np.ix_(rows, cols)] &= ~shared
    return out


def verify_batches(batches, cosine: float):
    for g in groups(batches, ["label", "dim", "filter", "part"]):
        own = np.asarray(g.column("own").to_numpy(zero_copy_only=False))
        dim = g.column("dim")[0].as_py()
        x = g.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        order = np.argsort(~own, kind="stable")  # own members first, then visitors
        x, n_own = x[order], int(own.sum())
        copies, first = g.column("copies").to_numpy()[order], g.column("first").to_numpy()[order]
        filters = [np.asarray(f) for f in g.column("filters").take(pa.array(order)).to_pylist()]
        add, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for a in range(0, n_own, TILE):
            b = min(a + TILE, n_own)
            for c in range(a, len(x), TILE):
                d = min(c + TILE, len(x))
                hit = x[a:b] @ x[c:d].T >= cosine
                if c < b:
                    hit &= np.arange(c, d)[None, :] > np.arange(a, b)[:, None]
                if not hit.any():
                    continue
                i, j = np.nonzero(hit)
                label = merge_labels(label, a + i, c + j)
                hit = new_pairs(hit, filters[a:b], filters[c:d])
                add[a:b] += hit @ copies[c:d]
                add[c:d] += hit.T @ copies[a:b]
        out = np.flatnonzero((add > 0) | (label != np.arange(len(x))))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(first[out]), pa.array(first[label[out]]), pa.array(add[out])], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Only rows with equal, non-null labels link. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, nor does a row with a null vec_id; such a
    row is its own component. Rows with equal vectors link with each other; rows with the same
    vec_id count as different rows. Vectors of different lengths don't link. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select("vec_id", "embedding", "label").withColumn("good", good).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    key = ["label", "h1", "h2"]
    classes = written(rows.filter("good").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "classes")
    blocks, words = plan(classes.count())
    # tried once here for a few dimensions; a worker that meets another one tries it itself
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().limit(8).collect()]
    levels = {d: threshold(d, blocks, words) for d in dims if d >= 4 * blocks}
    kind = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    shard = ["label", "dim", "filter"]
    narrow = arrow_map(classes.select("label", "embedding"), "tidemill.llm.embedding_links:filter_batches", f"label {kind['label']}, dim long, filter int", blocks=blocks, words=words, levels=levels, whole=False)
    crowded = written(narrow.groupBy(*shard).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).drop("n"), "crowded")
    n_crowded = crowded.count()
    passed = arrow_map(classes.select("label", "first", "copies", "embedding"), "tidemill.llm.embedding_links:filter_batches",
                       f"label {kind['label']}, dim long, filter int, first long, copies long, embedding {kind['embedding']}, filters array<int>", blocks=blocks, words=words, levels=levels, whole=True)
    if n_crowded:
        passed = passed.join(maybe_small(crowded, 100_000), shard, "left")
    else:
        passed = passed.withColumn("parts", F.lit(1))
    met = passed.withColumn("home", F.pmod(F.xxhash64("first"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = (met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("home")))).withColumn("own", F.col("part") == F.col("home"))
             .select(*shard, "part", "own", "first", "copies", "embedding", "filters").repartition(*shard, "part").sortWithinPartitions(*shard, "part"))
    found = written(arrow_map(dealt, "tidemill.llm.embedding_links:verify_batches", "a long, b long, links long", cosine=cosine), "links")
    parts = connected_components(found.select("a", "b"))
    totals = found.groupBy("a").agg(F.sum("links").alias("links"))
    home = (classes.select(*key, "first", "copies").join(totals, F.col("first") == F.col("a"), "left").join(parts, F.col("first") == F.col("node"), "left")
            .select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")))
    linked = rows.filter("good").select("vec_id", *key).join(home, key).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
