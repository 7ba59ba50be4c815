"""Near copies among whole texts: Jaccard 0.8 of the sets of their 5-word shingles, exactly.

Texts with equal sets are one class from the start, and only its first goes on. Simhashes of the
5-word shingles meet in the BK-trees of simhash.py; texts whose fingerprints link form a class,
and each is verified against the first texts of its class. A radius that reaches Jaccard 0.8 (some
10 bits of 64, more for short texts) leaves a tree nothing to prune and still loses pairs, so
the pairs beyond the trees' radius come from the prefix index of lines.py, with shingles as the tokens:
two texts that match share a token of their prefixes. Texts that the trees have joined aren't verified
against each other again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import rolling, simhash
from tidemill.llm.common import arrow_map, connected_components, drop_written, maybe_small, written
from tidemill.llm.lines import LISTS, MET, Sets, Shingles, asked_lists, cut_slices, matches, met_lines, rarity, texts_of, whole_tokens
from tidemill.llm.simhash import merge_labels

SHINGLE = 5
#: Texts of a class of the trees that its others are verified against, one after the other; the index has the rest.
LEADERS = 32


def set_batches(batches, shingle: int):
    """Simhash and two hashes of each text's set; zeros for a text without a word."""
    for batch in batches:
        texts = texts_of(batch)
        out = np.zeros((2, len(texts)), np.uint64)
        for a, b in cut_slices(texts):
            s = Shingles(texts[a:b], shingle)
            order = np.lexsort((s.hash, s.line))
            h, line = s.hash[order], s.line[order]
            new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))[:len(h)]
            for k in range(2):
                np.add.at(out[k], a + line[new], rolling.mix(h[new] + np.uint64(k)))
        fp = np.array([simhash.fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *(pa.array(x.view(np.int64)) for x in (*out, fp))], ["doc_id", "copy", "h1", "h2", "fp"])


def leader_batches(batches, leaders: int):
    """Of sorted lists by class: the texts that match one of its first texts, and which."""
    for t in whole_tokens(batches):
        token, sets = t.column("token").to_numpy(), Sets(t.column("tokens"))
        cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        rest = np.arange(len(token))
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for _ in range(leaders):
            if not len(rest):
                break
            # the first row left of each class leads
            new = np.append(True, group[rest[1:]] != group[rest[:-1]])
            lead = rest[new][np.cumsum(new) - 1]
            rest, lead = rest[~new], lead[~new]
            ok = sets.match(rest, lead)
            if ok.any():
                doc, copy = t.column("doc_id").to_numpy(), t.column("copy").to_numpy()
                i, j = rest[ok], lead[ok]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], copy[i], doc[j], copy[j])], ["a1", "a2", "b1", "b2"])
            rest = rest[~ok]


def link_batches(batches):
    """Links that join the texts that match among those that met at a token."""
    for t, i, j in matches(batches):
        label = merge_labels(np.arange(t.num_rows), i, j)
        moved = np.flatnonzero(label != np.arange(len(label)))
        doc, copy = t.column("doc_id").to_numpy(), t.column("copy").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[moved], copy[moved], doc[label[moved]], copy[label[moved]])], ["a1", "a2", "b1", "b2"])


def tree_links(texts: DataFrame, marks: DataFrame, rank: bytes, shingle: int = SHINGLE, leaders: int = LEADERS) -> DataFrame:
    """Written rows (a1, a2, b1, b2): texts a that match the text b whose simhash links with theirs in the BK-trees.

    texts: doc_id, copy, text; marks: their written doc_id, copy, fp. Each a appears once, and no b is an a. A text that
    matches none of the first `leaders` texts left of its class, as a class of fingerprints need not match, is no a.
    """
    distinct = written(marks.select("fp", F.col("fp").alias("first_doc")).distinct(), "distinct")
    parts = written(connected_components(simhash.links(distinct)), "classes")
    classes = marks.join(parts, marks["fp"] == parts["node"], "left").select("doc_id", "copy", F.coalesce("component", "fp").alias("token"))
    many = written(classes.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "met-classes")
    one = F.array(F.struct(F.lit(0).alias("line"), "token", F.col("token").alias("shard")))
    asked = written(classes.join(maybe_small(many), "token", "left_semi").select("doc_id", "copy", one.alias("asked")), "asked")
    lists = arrow_map(texts.join(maybe_small(asked, 200_000), ["doc_id", "copy"]).select("doc_id", "copy", "text", "asked"), "tidemill.llm.lines:list_batches", LISTS, rank=rank, shingle=shingle)
    dealt = lists.repartition("token").sortWithinPartitions("token", "doc_id", "copy")
    found = written(arrow_map(dealt, "tidemill.llm.near_texts:leader_batches", "a1 long, a2 long, b1 long, b2 long", leaders=leaders), "tree-links")
    drop_written(distinct, parts, many, asked)
    return found


def unsettled(met: DataFrame, joined: DataFrame) -> DataFrame:
    """What is still to be verified: tokens at which all texts are in one group of the trees aren't."""
    group = joined.select(F.col("a1").alias("doc_id"), F.col("a2").alias("copy"), node("b1", "b2").alias("leader"))
    grouped = met.filter("verify").join(maybe_small(group), ["doc_id", "copy"], "left").withColumn("home", F.coalesce("leader", node("doc_id", "copy")))
    known = written(grouped.groupBy("shard").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter("low = high").select("shard"), "settled")
    rest = written(grouped.join(maybe_small(known), "shard", "left_anti").select(*(c.split()[0] for c in MET.split(", "))), "met")
    drop_written(known)
    return rest


def links(texts: DataFrame, marks: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect all texts that match. texts: doc_id, copy, text with distinct sets; marks: their
    written doc_id, copy, fp."""
    rank = rarity(texts, shingle)
    joined = tree_links(texts, marks, rank, shingle)
    met = met_lines(texts, rank, shingle)
    rest = unsettled(met, joined)
    drop_written(met)
    found = written(arrow_map(asked_lists(texts, rest, rank, shingle), "tidemill.llm.near_texts:link_batches", "a1 long, a2 long, b1 long, b2 long"), "links")
    drop_written(rest)
    return joined.union(found).select(node("a1", "a2").alias("a"), node("b1", "b2").alias("b"))


def node(doc_id, copy):
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(copy).alias("copy"))


def later_copies(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, copy) of the numbered rows that aren't the first of their group of near copies.

    Groups are everything reachable by pairs of Jaccard 0.8 or more; the first has the smallest
    (doc_id, copy). Texts without a word are copies of each other. Rows with a null doc_id are in no
    group. An empty table has no copies.
    """
    docs = documents.filter("doc_id is not null").select("doc_id", "copy", "text")
    sets = written(arrow_map(docs, "tidemill.llm.near_texts:set_batches", "doc_id long, copy long, h1 long, h2 long, fp long", shingle=shingle), "sets")
    first = sets.groupBy("h1", "h2").agg(F.min(node("doc_id", "copy")).alias("b"))
    same = written(sets.join(first, ["h1", "h2"]).select(node("doc_id", "copy").alias("a"), "b").filter("a <> b"), "same")
    others = written(same.select("a.doc_id", "a.copy"), "others")
    marks = written(sets.join(maybe_small(others), ["doc_id", "copy"], "left_anti").select("doc_id", "copy", "fp"), "marks")
    found = links(docs.join(maybe_small(others), ["doc_id", "copy"], "left_anti"), marks, shingle)
    drop_written(sets, others, marks)
    return connected_components(same.union(found)).filter("node <> component").select("node.doc_id", "node.copy").distinct()
