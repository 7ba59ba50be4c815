"""Exact substring dedup by externally sorted suffixes (op1).

A byte goes if a string of LENGTH bytes that covers it also starts earlier. All suffixes of a
large corpus can't be sorted within a small multiple of its size (a tuple is larger than the
byte it stands for), so the text is dealt to shards by content: the anchor of a window of LENGTH
bytes is the least hash among its GRAM-byte strings. Equal windows have equal anchors wherever
they stand, so all that could repeat each other meet in one shard. Consecutive windows with one
anchor make a segment; segments travel as tuples through Spark's external sort. Of segments with
equal bytes (by length and 64-bit hashes of anchor and bytes) only the earliest is looked at. The
bytes of those that share an anchor with a different segment, or that may repeat within, go to
`induced.falling`: suffixes are sorted by external induction, and the common prefixes it carries
tell which windows are equal. Of those the earliest stays.

An anchor with very many different segments is dealt anew, by a hash of each window.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import rolling
from tidemill.llm.common import arrow_map, drop_written, maybe_small, numbered, spare_name, table, written
from tidemill.llm.induced import falling

LENGTH, GRAM = 100, 32
#: Bytes worked on at once; a longer text is cut into parts that overlap by a window.
SLICE_BYTES = 1_000_000
#: Bytes of a shard that is sorted at once, if no anchor has more; queue tuples in memory; names in memory.
SHARD_BYTES, QUEUE, NAMES = 1_000_000, 100_000, 2_000_000
#: Bytes of an anchor's different segments beyond which its windows are dealt anew.
HOT_BYTES = 2_000_000
INDEX = "anchor long, segment long, doc_id long, copy long, start long, windows int, state int"
MET = "look boolean, hot boolean, anchor long, doc_id long, copy long, first long, end long"
BYTES = "anchor long, doc_id long, copy long, first long, end long, bytes binary"
FIRST, SELF, GONE = 0, 1, 2
MAX = np.uint64(2**64 - 1)


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours; len(a) - width + 1 values."""
    out, have = a, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(raw: np.ndarray, ends: np.ndarray):
    """Segments of texts laid end to end: first window, windows, anchor, segment hash, may repeat within itself."""
    n = len(raw)
    if n < LENGTH:
        return None
    pre = rolling.prefix(raw)
    at = np.arange(n - GRAM + 1)
    gram = rolling.substrings(pre, at, at + GRAM)
    least = sliding_least(gram, LENGTH - GRAM + 1)
    valid = np.ones(len(least), bool)
    for_end = ends[ends < n]
    # windows that would cross the end of a text
    cross = np.zeros(n + 1, np.int64)
    np.add.at(cross, np.maximum(for_end - LENGTH + 1, 0), 1)
    np.add.at(cross, for_end, -1)
    valid &= np.cumsum(cross)[:len(least)] == 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return None
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | first[1:]
    last = np.flatnonzero(stop)
    anchor = least[start]
    # more than one place of the anchor's string within a segment?
    # a string is some window's least one if it equals the greatest of the least of the windows around it
    width = LENGTH - GRAM + 1
    around = ~sliding_least(np.concatenate([np.full(width - 1, MAX), ~least, np.full(width - 1, MAX)]), width)
    place = np.flatnonzero(around == gram)
    value = gram[place]
    lo, hi = np.searchsorted(place, start), np.searchsorted(place, last + LENGTH - GRAM, side="right")
    count = np.zeros(len(start), np.int64)
    for k in range(8):
        inside = lo + k < hi
        count[inside] += value[lo[inside] + k] == anchor[inside]
    twice = (count > 1) | (hi - lo > 8)
    return start, last - start + 1, anchor, rolling.substrings(pre, start, last + LENGTH), twice


def columns_of(batch, *names) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def rows_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else c.astype(kinds[t].to_pandas_dtype()), kinds[t]) for c, t in zip(columns, types)], list(names))


def index_batches(batches):
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        some, size = [], 0
        for doc, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text"))):
            data = (text or "").encode("utf-8", "replace")
            for at in range(0, max(len(data) - LENGTH + 1, 1), SLICE_BYTES):
                part = data[at:at + SLICE_BYTES + LENGTH - 1]
                some.append((doc, copy, at, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    yield from index_slice(*zip(*some))
                    some, size = [], 0
        if some:
            yield from index_slice(*zip(*some))


def index_slice(docs, copies, base, texts):
    """Segments of parts of texts that begin at `base` in their documents."""
    docs, copies, base = (np.array(x, np.int64) for x in (docs, copies, base))
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length)
    found = segments(np.frombuffer(b"".join(texts), np.uint8), ends)
    if found is None:
        return
    start, windows, anchor, segment, twice = found
    of = np.searchsorted(ends, start, side="right")
    doc, copy, inside = docs[of], copies[of], start - (ends - length)[of] + base[of]
    # of equal segments in this slice only the earliest goes on (map-side combine)
    order = np.lexsort((inside, copy, doc, segment, anchor))
    a, b = order[1:], order[:-1]
    gone = np.zeros(len(order), bool)
    gone[a] = (anchor[a] == anchor[b]) & (segment[a] == segment[b])
    keep = np.flatnonzero(~gone)
    first, end, of_doc, of_copy = spans(doc[gone], copy[gone], inside[gone], inside[gone] + windows[gone] - 1 + LENGTH)
    columns = [anchor[keep].view(np.int64), segment[keep].view(np.int64), doc[keep], copy[keep], inside[keep], windows[keep], np.where(twice, SELF, FIRST)[keep]]
    # removed runs pass through, dealt by a hash of their place
    extra = [rolling.mix((of_doc * 31 + first).astype(np.uint64)).view(np.int64), np.zeros(len(first), np.int64), of_doc, of_copy, first, end - first, np.full(len(first), GONE)]
    columns = [np.concatenate(c) for c in zip(columns, extra)]
    for k in range(0, len(columns[0]), 100_000):
        yield rows_of(INDEX, *(c[k:k + 100_000] for c in columns))


def spans(doc: np.ndarray, copy: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of overlapping or touching spans of each document: first, end, document, copy."""
    if not len(doc):
        return first, end, doc, copy
    order = np.lexsort((first, copy, doc))
    doc, copy, first, end = doc[order], copy[order], first[order], end[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]))
    number = np.cumsum(other)
    width = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * width)
    new = other.copy()
    new[1:] |= first[1:] + number[1:] * width > reach[:-1]
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(doc)) - 1
    return first[begin], reach[stop] - number[stop] * width, doc[begin], copy[begin]


class Meeting:
    """Rows in order of anchor, segment and place: of equal segments all but the first go; the first ones of an
    anchor that has several, or that may repeat within, are looked at. No more than HOT_BYTES of an anchor are held."""

    def __init__(self):
        self.anchor, self.segment, self.hot = None, None, False
        self.held: list = []  # (doc_id, copy, first, end, state) of the open anchor

    def close(self):
        """What is known of the open anchor once it has no more segments."""
        held, self.held = self.held, []
        if not self.hot and len(held) == 1 and held[0][4] != SELF:
            return []
        return [(True, self.hot, self.anchor, *h[:4]) for h in held]

    def batch(self, anchor, segment, doc, copy, start, windows, state) -> pa.RecordBatch | None:
        end = np.where(state == GONE, start + windows, start + windows - 1 + LENGTH)
        known = state == GONE
        real = np.flatnonzero(~known)
        a, s = anchor[real], segment[real]
        same = np.append(False, (a[1:] == a[:-1]) & (s[1:] == s[:-1]))[:len(real)]
        if len(real):
            same[0] = a[0] == self.anchor and s[0] == self.segment
        gone = np.concatenate([np.flatnonzero(known), real[same]])
        rest = real[~same]
        out = []
        if len(rest):
            head = anchor[rest]
            cuts = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])), len(rest))
            size = np.diff(cuts)
            inner = np.zeros(len(size), bool)
            inner[1:-1] = True  # the first may go on from the batch before, the last may go on in the next
            inner &= np.add.reduceat(end[rest] - start[rest], cuts[:-1]) <= HOT_BYTES
            look = rest[np.repeat(inner & (size > 1), size) | (np.repeat(inner, size) & (state[rest] == SELF))]
            for k in np.flatnonzero(~inner).tolist():
                rows = rest[cuts[k]:cuts[k + 1]]
                if head[cuts[k]] != self.anchor:
                    out += self.close()
                    self.anchor, self.hot = int(head[cuts[k]]), False
                for i in rows.tolist():
                    self.held.append((int(doc[i]), int(copy[i]), int(start[i]), int(end[i]), int(state[i])))
                self.hot |= len(self.held) > 1 and sum(h[3] - h[2] for h in self.held) > HOT_BYTES
                if self.hot:
                    out += self.close()
            self.segment = int(segment[rest[-1]])
        else:
            look = rest
        at = np.concatenate([gone, look])
        flag = np.arange(len(at)) >= len(gone)
        columns = [flag, np.zeros(len(at), bool), anchor[at], doc[at], copy[at], start[at], end[at]]
        return rows_of(MET, *(np.concatenate([c, np.array(x, c.dtype)]) for c, x in zip(columns, zip(*out)))) if out else rows_of(MET, *columns)


def meet_batches(batches):
    m = Meeting()
    for batch in batches:
        if batch.num_rows:
            yield m.batch(*columns_of(batch, "anchor", "segment", "doc_id", "copy", "start", "windows", "state"))
    last = m.close()
    if last:
        yield rows_of(MET, *(np.array(x) for x in zip(*last)))


def byte_batches(batches):
    """The bytes of the segments asked for. Of an anchor with too many segments each window comes by
    itself, with its hash as the anchor; of equal ones in this batch the earliest."""
    for batch in batches:
        hot = []
        for text, doc, copy, asked in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "copy", "asked"))):
            data = (text or "").encode("utf-8", "replace")
            hot += [(doc, copy, x["first"], data[x["first"]:x["end"]]) for x in asked if x["hot"]]
            plain = [x for x in asked if not x["hot"]]
            for k in range(0, len(plain), 5000):
                part = plain[k:k + 5000]
                first, end = [x["first"] for x in part], [x["end"] for x in part]
                yield rows_of(BYTES, [x["anchor"] for x in part], [doc] * len(part), [copy] * len(part), first, end, [data[a:b] for a, b in zip(first, end)])
            if sum(len(h[3]) for h in hot) > SLICE_BYTES:
                yield from single_windows(hot)
                hot = []
        if hot:
            yield from single_windows(hot)


def single_windows(hot: list):
    doc, copy, first, data = zip(*hot)
    length = np.array([len(d) for d in data])
    raw, base = np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length
    n = length - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    at = base[of] + inside
    key = rolling.substrings(rolling.prefix(raw), at, at + LENGTH)
    doc, copy, place = (np.array(x, np.int64)[of] for x in (doc, copy, first))
    place = place + inside
    order = np.lexsort((place, copy, doc, key))
    key, at, doc, copy, place = key[order], at[order], doc[order], copy[order], place[order]
    first = np.append(True, key[1:] != key[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    later = np.flatnonzero(~first)
    width = np.arange(LENGTH)
    for k in range(0, len(later), 10_000):  # equal hashes, but is it equal bytes?
        part = later[k:k + 10_000]
        first[part] = (raw[at[part][:, None] + width] != raw[at[lead[part]][:, None] + width]).any(axis=1)
    a, b, d, c = spans(doc[~first], copy[~first], place[~first], place[~first] + LENGTH)
    if len(a):
        yield rows_of(BYTES, rolling.mix((d * 31 + a).astype(np.uint64)).view(np.int64), d, c, a, b, [b""] * len(a))
    kept = np.flatnonzero(first)
    for k in range(0, len(kept), 20_000):
        part = kept[k:k + 20_000]
        yield rows_of(BYTES, key[part].view(np.int64), doc[part], copy[part], place[part], place[part] + LENGTH, [raw[i:i + LENGTH].tobytes() for i in at[part].tolist()])


def sort_shard(data: list[bytes], doc: np.ndarray, copy: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of windows that also start earlier among these segments."""
    length = np.array([len(d) for d in data])
    # a separator of value 0 after each segment
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int(length.sum()) + len(data), np.uint16)
    text[np.arange(int(length.sum())) + np.repeat(np.arange(len(data)), length)] = np.frombuffer(b"".join(data), np.uint8)
    text += 1
    text[begin + length] = 0
    full = np.repeat(np.tile([True, False], len(data)), np.stack([length - LENGTH + 1, np.full(len(data), LENGTH)], axis=1).ravel())
    groups, places, group, least = [], [], 0, LENGTH
    for suffix, prefix in falling(text, 257, QUEUE, LENGTH, NAMES):
        at = np.flatnonzero(full[suffix])
        if not len(at):
            least = min(least, int(prefix.min()))
            continue
        shared = np.minimum.reduceat(prefix[:at[-1] + 1], np.append(0, at[:-1] + 1))
        shared[0] = min(shared[0], least)
        least = int(prefix[at[-1] + 1:].min(initial=LENGTH))
        number = group + np.cumsum(shared < LENGTH)
        group = int(number[-1])
        groups.append(number.astype(np.int32))
        places.append(suffix[at])
    group, at = np.concatenate(groups), np.concatenate(places)
    # windows that equal no other are done
    alone = np.bincount(group) == 1
    group, at = group[~alone[group]], at[~alone[group]]
    segment = np.searchsorted(begin, at, side="right") - 1
    doc, copy, at = doc[segment], copy[segment], first[segment] + at - begin[segment]
    rank = np.lexsort((at, copy, doc, group))
    later = rank[1:][group[rank[1:]] == group[rank[:-1]]]
    return spans(doc[later], copy[later], at[later], at[later] + LENGTH)


def may_repeat(data: list[bytes]) -> np.ndarray:
    """Segments with a window whose hash occurs twice among them: only those can hold a repeat."""
    length = np.array([len(d) for d in data])
    begin, n = np.cumsum(length) - length, length - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    at = begin[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
    key = rolling.substrings(rolling.prefix(np.frombuffer(b"".join(data), np.uint8)), at, at + LENGTH)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = np.zeros(len(data), bool)
    if len(twice):
        where = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        out[of[twice[where] == key]] = True
    return out


def whole_anchors(batches, rows: int):
    """Tables of at least so many rows that never split the rows of an anchor; an anchor has at most HOT_BYTES,
    or windows with one hash."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        anchor = t.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def sort_batches(batches):
    pool, size = [], 0

    def flush():
        nonlocal pool, size
        data, doc, copy, first = zip(*pool)
        pool, size = [], 0
        a, b, d, c = sort_shard(list(data), *(np.array(x, np.int64) for x in (doc, copy, first)))
        if len(a):
            yield rows_of("doc_id long, copy long, first long, end long", d, c, a, b)

    for t in whole_anchors(batches, 5_000):
        data = t.column("bytes").to_pylist()
        anchor, doc, copy, first, end = columns_of(t.combine_chunks(), "anchor", "doc_id", "copy", "first", "end")
        known = np.array([not d for d in data])
        if known.any():
            yield rows_of("doc_id long, copy long, first long, end long", doc[known], copy[known], first[known], end[known])
        live = np.flatnonzero(~known)
        if not len(live):
            continue
        live = live[may_repeat([data[i] for i in live])]
        for i, j in zip(live.tolist(), [*live[1:].tolist(), None]):
            pool.append((data[i], doc[i], copy[i], first[i]))
            size += len(data[i])
            if size >= SHARD_BYTES and (j is None or anchor[j] != anchor[i]):
                yield from flush()
    if pool:
        yield from flush()


def repeated(documents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, copy, spans): byte spans of a row of numbered documents that are covered by strings of LENGTH
    bytes that start earlier; and the written tables it reads."""
    docs = documents.select("doc_id", "copy", "text")
    index = arrow_map(docs, "tidemill.llm.substrings:index_batches", INDEX)
    met = written(arrow_map(index.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id", "copy", "start"), "tidemill.llm.substrings:meet_batches", MET), "met")
    key = ["doc_id", "copy"]
    look = met.filter("look")
    asked = look.groupBy(*key).agg(F.collect_list(F.struct("anchor", "hot", "first", "end")).alias("asked"))
    # only documents with something to sort travel, where their ids are few enough to send around
    ids = look.select(*key).distinct()
    some = docs.join(F.broadcast(ids), key, "left_semi") if ids.limit(200_001).count() <= 200_000 else docs
    data = arrow_map(some.join(asked, key).select(*key, "text", "asked"), "tidemill.llm.substrings:byte_batches", BYTES)
    sorted_ = arrow_map(data.repartition("anchor").sortWithinPartitions("anchor"), "tidemill.llm.substrings:sort_batches", "doc_id long, copy long, first long, end long")
    found = met.filter("not look").select(*key, "first", "end").union(sorted_).groupBy(*key).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return found, [met]


def cut(data: bytes, found, characters: bool = False) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs). characters: only whole UTF-8 characters go."""
    if not found:
        return data, 0, 0
    first, end = np.array([x["first"] for x in found]), np.array([x["end"] for x in found])
    one = np.zeros(len(first), np.int64)
    first, end, *_ = spans(one, one, first, end)
    if characters:
        inner = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)
        for _ in range(3):
            first, end = first + inner[first], end - inner[end]
    edges = np.concatenate([[0], np.stack([first, end], axis=1).ravel(), [len(data)]]).tolist()
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]), int((end - first).sum()), len(first)


def digest_batches(batches):
    for batch in batches:
        data = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        rows = [cut(d, s) for d, s in zip(data, batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                                          pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def text_batches(batches, found: str):
    for batch in batches:
        names = [n for n in batch.schema.names if n != found]
        texts = [None if t is None else cut(t.encode("utf-8", "replace"), s, True)[0].decode("utf-8", "replace") for t, s in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def summary(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty. A text shorter than LENGTH bytes loses nothing, nor does a row with a
    null doc_id. Rows that repeat a doc_id are different documents, in an order of their own that
    holds for the run: of equal ones one stays whole. An empty table gives no rows. Other columns
    are ignored.
    """
    docs = numbered(documents.select("doc_id", "text"))
    found, _ = repeated(docs)
    return arrow_map(docs.join(found, ["doc_id", "copy"], "left").select("doc_id", "text", "spans"), "tidemill.llm.substrings:digest_batches", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows with all their columns, their text without repeated strings.

    A character of several bytes goes only whole. A null text stays null; rows with a null doc_id
    stay as they are; rows that repeat a doc_id are different documents, as in `summary`.
    """
    own = ["doc_id", "text"]
    copy, name = spare_name("copy", documents.columns), spare_name("spans", documents.columns)
    docs = numbered(documents, copy)
    found, _ = repeated(docs.select(*own, F.col(copy).alias("copy")))
    found = found.withColumnsRenamed({"copy": copy, "spans": name})
    return arrow_map(docs.join(found, ["doc_id", copy], "left").select(*documents.columns, name), "tidemill.llm.substrings:text_batches", documents.schema, found=name)


def query(spark, sf_dir):
    return summary(table(spark, sf_dir, "documents"))
