"""SimHash near-duplicates by BK-trees (op9).

Distinct fingerprints are cut into one block more than bits may differ, so any two within the radius
have a block alike. A shard holds those with the same low bits of one block, as many bits as
leave about TREE members to a shard, and each shard has its BK-tree: children are keyed by their
Hamming distance to the parent, and a search follows only edges within the radius of its own
distance. Trees aren't broadcast: all of them together grow with the corpus, so fingerprints travel to
the trees of their shards instead. A shard with more than SHARD members is split into several
trees, and every member also searches the trees before its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_map, connected_components, maybe_small, table, written

RADIUS = 2
#: Members of a shard to aim at, and at most.
TREE, SHARD = 1_000, 20_000


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 100_000):
        part = shingles[at:at + 100_000]
        h = np.fromiter((digest(s, 42) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprint_batches(batches, words: int):
    for batch in batches:
        fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


class BKTree:
    """A tree over distinct fingerprints, built and searched a level at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.child = np.full((n, 65), -1, np.int32)
        rest = np.arange(1, n)
        parent = np.zeros(n - 1, np.int64)
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[parent])
            edge = parent * 65 + d
            _, first, group = np.unique(edge, return_index=True, return_inverse=True)
            chosen = rest[first]
            self.child[parent[first], d[first]] = chosen
            down = np.ones(len(rest), bool)
            down[first] = False
            parent, rest = chosen[group][down], rest[down]

    def search(self, queries: np.ndarray, radius: int, batch: int = 2048):
        """(query index, member index) arrays of all members within the radius."""
        steps = np.arange(-radius, radius + 1)
        for at in range(0, len(queries), batch):
            q = np.arange(at, min(at + batch, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                at_d = d[:, None] + steps
                nxt = np.where((at_d > 0) & (at_d <= 64), self.child[node[:, None], np.clip(at_d, 0, 64)], -1)
                go = nxt >= 0
                q, node = np.repeat(q, go.sum(axis=1)), nxt[go].astype(np.int64)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of each pair; a class is named by its smallest index."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not (label == label[label]).all():
            label = label[label]


def shard_links(fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each class of linked members: (member, its class's first)."""
    build = np.flatnonzero(own)
    if not len(build) or len(fp) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tree, label = BKTree(fp[build]), np.arange(len(fp))
    for q, m in tree.search(fp, radius):
        label = merge_labels(label, q, build[m])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return moved, label[moved]


def groups(batches, keys: list[str]):
    """Consecutive rows with equal keys of a sorted partition, as one batch each; single rows are left out."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        t = batch if rest is None else rest if batch is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if t is None:
            return
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])
        last = len(cuts) - 1 if batch is None else len(cuts) - 2
        big = np.flatnonzero(np.diff(cuts[:last + 1]) > 1)
        for i in big:
            yield t.slice(cuts[i], cuts[i + 1] - cuts[i])
        rest = t.slice(cuts[last], t.num_rows - cuts[last]) if batch is not None else None


def link_batches(batches, radius: int):
    a, b = [], []
    for g in groups(batches, ["block", "value", "tree"]):
        ids = g.column("first_doc").to_numpy()
        x, y = shard_links(g.column("fp").to_numpy().view(np.uint64), g.column("own").to_numpy(zero_copy_only=False), radius)
        if len(x):
            a.append(ids[x])
            b.append(ids[y])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    return arrow_map(documents.select("doc_id", "text"), "tidemill.llm.simhash:fingerprint_batches", "doc_id long, fp long", words=words)


def links(first: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius. first: a written table of distinct fp, first_doc."""
    blocks = radius + 1
    width = 64 // blocks
    bits = min(width, max(1, (first.count() // TREE).bit_length()))
    keys = F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for k in range(blocks)))
    keyed = first.select("fp", "first_doc", F.explode(keys).alias("key")).select("fp", "first_doc", "key.*")
    crowded = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > shard).withColumn("trees", F.ceil(F.col("n") / F.lit(shard)).cast("int")).drop("n")
    # at most blocks * 2 ** width rows, and rows / shard of them
    met = keyed.join(maybe_small(written(crowded, "crowded")), ["block", "value"], "left").withColumn("home", F.pmod(F.xxhash64("fp"), F.coalesce("trees", F.lit(1))).cast("int"))
    spread = met.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("home")))).withColumn("own", F.col("tree") == F.col("home"))
    dealt = spread.select("block", "value", "tree", "own", "fp", "first_doc").repartition("block", "value", "tree").sortWithinPartitions("block", "value", "tree")
    return arrow_map(dealt, "tidemill.llm.simhash:link_batches", "a long, b long", radius=radius)


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints within the radius link; component_id is the smallest doc_id reachable. A null or
    wordless text has fingerprint zero and links like any other. Rows with a null doc_id link
    nothing and get their class's component only through equal fingerprints. Exact copies are one
    fingerprint and never make pairs.
    """
    docs = written(fingerprints(documents, words), "fingerprints")
    first = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    parts = connected_components(links(first.filter("first_doc is not null"), radius))
    home = first.join(parts, first["first_doc"] == parts["node"], "left").select("fp", F.coalesce("component", "first_doc").alias("component_id"))
    return docs.join(home, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
