"""Line dedup by an exact set-similarity join (op6).

A line is the set of its words. Tokens are ordered by rarity in the corpus (a fixed-size table
of counts by hash bucket, over all documents), and each line is indexed under its prefix: the
tokens of which two lines with the required Jaccard similarity must share one. Lines that meet
pass a length, a positional and a bitmap filter; what is left is verified on the token sets. Short lines
that share a token which the corpus has very often meet at pairs of tokens instead: two lines that
match share two tokens of prefixes that are one longer, if they have two at all. A line goes if any earlier line (smaller doc_id, or same document, earlier line) matches it,
whether or not that line stays. Lines with equal sets need no verification; only the earliest of
them goes on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import rolling
from tidemill.llm.common import arrow_map, numbered, spare_name, table, written

#: Jaccard 0.8 as a fraction, and the fewest words of a line that is compared: any line with a word.
OVER, UNDER = 4, 5
MIN_WORDS = 1
#: The rarity table: log-scaled corpus counts by hash bucket, one byte each, whatever the corpus. Words
#: repeat more than shingles do, so fewer buckets tell them apart.
WORD_BITS, SHINGLE_BITS = 18, 22
#: Rarity (2 * log2 of the count) from which the lines of at most SHORT tokens meet at pairs of tokens. Longer ones
#: have too many pairs; those that may match a short one meet at both.
OFTEN, SHORT = 28, 10
SLICE_BYTES, SLICE_LINES = 2_000_000, 60_000
INDEX = "bucket int, n long, data binary"
MET = "verify boolean, doc_id long, copy long, line int, token long, shard long"
LISTS = "token long, doc_id long, copy long, line int, tokens binary"
#: Columns of a packed run of index rows.
PACKED = (("token", "<i8"), ("doc", "<i8"), ("copy", "<i8"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4"), ("bits", "<u8"), ("sets", "<u4"))
#: Lines of more tokens than this carry a second bitmap, of WIDE words.
LONG, WIDE = 64, 4
#: Index rows packed together, and buckets of tokens for each shuffle partition.
RUN_ROWS, BUCKETS = 300_000, 4
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True


def needed(a, b):
    """Least common tokens of sets of sizes a and b: ceil(t / (1 + t) * (a + b))."""
    return -(-(OVER * (a + b)) // (OVER + UNDER))


def prefix_size(n):
    return n - -(-(OVER * n) // UNDER) + 1


class Words:
    """Words of many texts at once: hash and line of each; lines are numbered over all texts."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        white = SPACE[raw]
        padded = np.concatenate([[True], white, [True]])
        start = np.flatnonzero(padded[:-1] & ~padded[1:])
        end = np.flatnonzero(~padded[:-1] & padded[1:])
        newline = np.flatnonzero(raw == 10)
        self.hash = rolling.substrings(rolling.prefix(raw), start, end)
        self.line = np.searchsorted(newline, start)
        # line -> (text, number within the text)
        line_start = np.concatenate([[0], newline + 1])
        self.text = np.searchsorted(ends, line_start, side="right")
        first = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(len(line_start)) - first[np.minimum(self.text, len(texts) - 1)]
        self.words = np.bincount(self.line, minlength=len(line_start))


class Shingles:
    """The same of whole texts as sets of runs of so many words, ASCII letters in lower case: each text
    counts as one line. A text of fewer words is one run."""

    def __init__(self, texts: list[bytes], size: int):
        w = Words([t.lower() for t in texts])
        owner, n = w.text[w.line], len(texts)
        self.words = np.bincount(owner, minlength=n)
        at = np.arange(len(owner)) - (np.cumsum(self.words) - self.words)[owner]
        start = np.flatnonzero((at == 0) | (at + size <= self.words[owner]))
        self.line, self.hash = owner[start], np.zeros(len(start), np.uint64)
        for k in range(size):
            inside = np.flatnonzero(at[start] + k < self.words[self.line])
            self.hash[inside] = rolling.mix(self.hash[inside] * np.uint64(3) + rolling.mix(w.hash[start[inside] + k]))
        self.text, self.number = np.arange(n), np.zeros(n, np.int64)


def units(texts: list[bytes], shingle: int):
    return Shingles(texts, shingle) if shingle else Words(texts)


def cut_slices(texts: list[bytes]):
    start = size = lines = 0
    for i, t in enumerate(texts):
        n = t.count(b"\n") + 1
        if i > start and (size + len(t) > SLICE_BYTES or lines + n > SLICE_LINES):
            yield start, i
            start, size, lines = i, 0, 0
        size += len(t)
        lines += n
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def count_batches(batches, shingle: int = 0):
    bits = SHINGLE_BITS if shingle else WORD_BITS
    total, seen = np.zeros(1 << bits, np.int64), False
    for batch in batches:
        texts = texts_of(batch)
        for a, b in cut_slices(texts):
            h = units(texts[a:b], shingle).hash
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            seen = True
    if seen:
        at = np.flatnonzero(total)
        for k in range(0, len(at), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k:k + 200_000].astype(np.int32)), pa.array(total[at[k:k + 200_000]])], ["bucket", "n"])


def rarity(documents: DataFrame, shingle: int = 0) -> bytes:
    """One byte per bucket: 2 * log2 of the corpus count of its words (or shingles), at most 63."""
    counts = arrow_map(documents.select("text"), "tidemill.llm.lines:count_batches", "bucket int, n long", shingle=shingle).groupBy("bucket").agg(F.sum("n").alias("n"))
    scaled = counts.select("bucket", F.least(F.floor(F.log2("n") * 2), F.lit(63)).cast("byte").alias("r")).filter("r > 0")
    out = np.zeros(1 << (SHINGLE_BITS if shingle else WORD_BITS), np.uint8)
    got = scaled.toArrow()  # at most one row per bucket: bounded whatever the corpus
    out[got.column("bucket").to_numpy()] = got.column("r").to_numpy()
    return out.tobytes()


def token_sets(w: Words, rank: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (48 bits: rarity, then hash) of the chosen lines, ascending and distinct, flat; line and size."""
    name = np.cumsum(chosen) - 1
    at = chosen[w.line]
    h = w.hash[at]
    shift = np.uint64(65 - len(rank).bit_length())
    token = (rank[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(42)) | (h & np.uint64((1 << 42) - 1))
    key = np.sort((name[w.line[at]].astype(np.uint64) << np.uint64(48)) | token)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    line = (key >> np.uint64(48)).astype(np.int64)
    return (key & np.uint64((1 << 48) - 1)).astype(np.int64), line, np.bincount(line, minlength=int(chosen.sum()))


def signature(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmap and set hash of each line."""
    m = rolling.mix(tokens.astype(np.uint64))
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (m & np.uint64(63)), first)
    return bits, np.add.reduceat(rolling.mix(m ^ np.uint64(rolling.BASE)), first)


def wide_signature(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity bitmap of WIDE words for each long line; zero for the others."""
    out = np.zeros((len(first), WIDE), np.uint64)
    long = np.flatnonzero(size > LONG)
    if len(long):
        m = rolling.mix(rolling.mix(tokens[np.repeat(size > LONG, size)].astype(np.uint64)) + np.uint64(1))
        word, bit = (m >> np.uint64(6)) & np.uint64(WIDE - 1), np.uint64(1) << (m & np.uint64(63))
        start = np.cumsum(size[long]) - size[long]
        for k in range(WIDE):
            out[long, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), start)
    return out


def pack_rows(columns: dict[str, np.ndarray], zip_) -> bytes:
    """Columns in byte planes (tokens as differences, documents from the least), compressed."""
    out = []
    for name, kind in PACKED:
        c = columns[name].astype(kind)
        if name == "token":
            c = np.diff(c, prepend=c.dtype.type(0))
        elif name == "doc":
            out.append(c.min().tobytes())
            c = c - c.min()
        out.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    out.append(columns["wide"][columns["size"] > LONG].tobytes())
    return zip_.compress(b"".join(out))


def unpack_rows(data: bytes, n: int, zip_) -> list[np.ndarray]:
    data, at, out = zip_.decompress(data), 0, []
    for name, kind in PACKED:
        width, low = np.dtype(kind).itemsize, 0
        if name == "doc":
            low = np.frombuffer(data, "<i8", 1, at)[0]
            at += 8
        c = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel()
        at += n * width
        out.append(np.cumsum(c) if name == "token" else c + low if name == "doc" else c)
    long = np.flatnonzero(out[4] > LONG)
    wide = np.zeros((n, WIDE), np.uint64)
    wide[long] = np.frombuffer(data, np.uint64, len(long) * WIDE, at).reshape(-1, WIDE)
    return [*out, wide]


def index_batches(batches, rank: bytes, buckets: int, shingle: int = 0):
    """Index rows of this partition, packed by bucket of their token: few rows for the shuffle to handle."""
    import zstandard

    zip_, held, count = zstandard.ZstdCompressor(level=1), [], 0

    def packed():
        columns = {name: np.concatenate([h[k] for h in held]) for k, name in enumerate([*(n for n, _ in PACKED), "wide"])}
        bucket = (rolling.mix(columns["token"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((columns["token"], bucket))
        bucket = bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        columns = {k: c[order] for k, c in columns.items()}
        rows = [(int(bucket[a]), int(b - a), pack_rows({k: c[a:b] for k, c in columns.items()}, zip_)) for a, b in zip(cuts, cuts[1:])]
        bucket, n, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["bucket", "n", "data"])

    for columns in index_rows(batches, rank, shingle):
        held.append(columns)
        count += len(columns[0])
        if count >= RUN_ROWS:
            yield packed()
            held, count = [], 0
    if count:
        yield packed()


def index_rows(batches, rank: bytes, shingle: int = 0):
    rank = np.frombuffer(rank, np.uint8)
    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        docs, copies, texts = batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy(), texts_of(batch)
        for a, b in cut_slices(texts):
            w = units(texts[a:b], shingle)
            chosen = w.words >= MIN_WORDS
            if not chosen.any():
                continue
            # very many lines in one text: number them in parts that fit the packed key
            for part in np.array_split(np.flatnonzero(chosen), 1 + int(chosen.sum()) // 65_000):
                some = np.zeros(len(chosen), bool)
                some[part] = True
                tokens, line, size = token_sets(w, rank, some)
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                bits, sets = signature(tokens, first)
                wide = wide_signature(tokens, first, size)
                doc, copy, number = docs[a:b][w.text[part]], copies[a:b][w.text[part]], w.number[part]
                # equal sets within this slice: only the earliest goes on (map-side combine)
                order = np.lexsort((number, copy, doc, sets))
                later = np.zeros(len(order), bool)
                later[order[1:]] = sets[order[1:]] == sets[order[:-1]]
                pos = np.arange(len(tokens)) - first[line]
                at = np.flatnonzero((pos < prefix_size(size)[line]) & (~later[line] | (pos == 0)))
                # a later equal line gets one row, size 0: it is known to go
                n = size[line[at]]
                often = (tokens[at] >> 42 >= OFTEN) & (n > 1) & (UNDER * SHORT >= OVER * n) & ~later[line[at]]
                alone = ~often | (n > SHORT)
                # pairs of a frequent token with those after it in the prefix that is one longer
                many = at[often]
                after = np.minimum(prefix_size(size)[line[many]] + 1, size[line[many]]) - pos[many] - 1
                one = np.repeat(many, after)
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after)
                pair = (rolling.mix(rolling.mix(tokens[one].astype(np.uint64)) + tokens[two].astype(np.uint64)) >> np.uint64(16)).astype(np.int64) | (1 << 48)
                token, at = np.concatenate([tokens[at[alone]], pair]), np.concatenate([at[alone], one])
                of = line[at]
                sizes = np.where(later[of], 0, size[of])
                yield token, doc[of], copy[of], number[of], sizes, pos[at], bits[of], sets[of] >> np.uint64(32), wide[of]


def bucket_rows(batches):
    """The columns of each bucket of a sorted partition."""
    import zstandard

    zip_, now, held = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        for bucket, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "data"))):
            if bucket != now and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            now = bucket
            held.append(unpack_rows(data, n, zip_))
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def meet_batches(batches):
    for token, doc, copy, line, size, pos, bits, sets, wide in bucket_rows(batches):
        gone = size == 0
        order = np.lexsort((sets, token))
        order = order[~gone[order]]
        a, b = order[1:], order[:-1]
        new = np.append(True, (token[a] != token[b]) | (sets[a] != sets[b]) | (size[a] != size[b]) | (bits[a] != bits[b]))[:len(order)]
        # of lines with equal sets the earliest goes on
        many = np.flatnonzero(~new | ~np.append(new[1:], True)[:len(order)])
        group = np.cumsum(new)
        order[many] = order[many][np.lexsort((line[order[many]], copy[order[many]], doc[order[many]], group[many]))]
        twin = order[~new]
        gone[twin[pos[twin] == 0]] = True
        rest = order[new]
        rest = rest[np.lexsort((size[rest], token[rest]))]
        k, s, p, w, wide = token[rest], size[rest].astype(np.int64), pos[rest], bits[rest], wide[rest]
        hit = np.zeros(len(rest), bool)
        i, d = np.arange(len(rest) - 1), 1
        while len(i):
            i = i[i + d < len(rest)]
            j = i + d
            ok = (k[i] == k[j]) & (UNDER * s[i] >= OVER * s[j])
            i, j = i[ok], j[ok]
            need = needed(s[i], s[j])
            near = (np.minimum(s[i] - p[i], s[j] - p[j]) >= need) & (np.bitwise_count(w[i] ^ w[j]) <= s[i] + s[j] - 2 * need)
            both = np.flatnonzero(near & (s[i] > LONG) & (s[j] > LONG))
            apart = np.bitwise_count(wide[i[both]] ^ wide[j[both]]).sum(axis=1, dtype=np.int64)
            near[both[apart > s[i[both]] + s[j[both]] - 2 * need[both]]] = False
            hit[i[near]] = True
            hit[j[near]] = True
            d += 1
        at = np.concatenate([np.flatnonzero(gone), rest[hit]])
        # which lines are to be verified at this token: tokens with the same lines need only one of them
        met, name = np.unique(token[rest[hit]], return_inverse=True)
        among = np.zeros(len(met), np.uint64)
        np.add.at(among, name, rolling.mix(rolling.mix(doc[rest[hit]].astype(np.uint64)) + rolling.mix(copy[rest[hit]].astype(np.uint64)) + line[rest[hit]].astype(np.uint64)))
        shard = np.concatenate([np.zeros(int(gone.sum()), np.int64), among[name].view(np.int64)])
        kind = np.concatenate([np.zeros(int(gone.sum()), bool), np.ones(int(hit.sum()), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(doc[at]), pa.array(copy[at]), pa.array(line[at]), pa.array(token[at]), pa.array(shard)], ["verify", "doc_id", "copy", "line", "token", "shard"])


def list_batches(batches, rank: bytes, shingle: int = 0):
    """The token sets of the lines asked for, six bytes a token."""
    rank = np.frombuffer(rank, np.uint8)
    names = [c.split()[0] for c in LISTS.split(", ")]
    for batch in batches:
        for text, doc, copy, asked in zip(texts_of(batch), *(batch.column(c).to_pylist() for c in ("doc_id", "copy", "asked"))):
            w, least = units([text], shingle), {}
            for x in asked:
                key = x["line"], x["shard"]
                least[key] = min(x["token"], least.get(key, x["token"]))
            lines = np.unique([x["line"] for x in asked])
            sets = {}
            for part in np.array_split(lines, 1 + len(lines) // 65_000):
                some = np.zeros(len(w.words), bool)
                some[part] = True
                tokens, line, size = token_sets(w, rank, some)
                data, end = tokens.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), np.cumsum(size) * 6
                sets |= {k: data[e - 6 * n:e] for k, n, e in zip(part.tolist(), size.tolist(), end.tolist())}
            rows = sorted({(t, k) for (k, _), t in least.items()})
            # few sets to a batch where they are long
            step = max(1, min(2000, 4_000_000 // max(map(len, sets.values()))))
            for a in range(0, len(rows), step):
                token, line = zip(*rows[a:a + step])
                yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array([doc] * len(token), pa.int64()), pa.array([copy] * len(token), pa.int64()), pa.array(line, pa.int32()), pa.array([sets[k] for k in line], pa.binary())], names)


class Sets:
    """Token sets of rows of lists: flat, with their offsets."""

    def __init__(self, column):
        raw = column.to_pylist()
        self.size = np.array([len(x) // 6 for x in raw], np.int64)
        wide = np.zeros((int(self.size.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
        self.flat = wide.view("<i8").ravel()
        self.start = np.append(0, np.cumsum(self.size))

    def match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows have the similarity asked for: common tokens are counted by sorting both sets together."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        out = np.zeros(len(i), bool)
        left = np.flatnonzero(UNDER * small >= OVER * large)
        while len(left):
            n = self.size[i[left]] + self.size[j[left]]
            some = max(1, min(1 << 15, int(np.searchsorted(np.cumsum(n), 1_000_000))))
            part, left, n = left[:some], left[some:], n[:some]
            rows, size = np.stack([i[part], j[part]], axis=1).ravel(), np.stack([self.size[i[part]], self.size[j[part]]], axis=1).ravel()
            at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            key = np.sort((np.repeat(np.arange(len(part), dtype=np.uint64), n) << np.uint64(48)) | self.flat[at].astype(np.uint64))
            common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(part))
            out[part] = common >= needed(self.size[i[part]], self.size[j[part]])
        return out

    def alike(self, first: int, last: int, tile: int = 1024):
        """(a, c, matrix) for tiles of rows a.. and c.., c <= a, among [first, last): which of them match."""
        names, place = np.unique(self.flat[self.start[first]:self.start[last]], return_inverse=True)
        size, start = self.size[first:last], self.start[first:last + 1] - self.start[first]
        owner = np.repeat(np.arange(len(size)), size)

        def incidence(a, b):
            m = np.zeros((b - a, len(names)), np.float32)
            m[owner[start[a]:start[b]] - a, place[start[a]:start[b]]] = 1
            return m

        step = max(8, min(tile, 8_000_000 // max(1, len(names))))
        for a in range(0, len(size), step):
            b = min(a + step, len(size))
            own = incidence(a, b)
            for c in range(0, b, step):
                e = min(c + step, b)
                yield a, c, own @ incidence(c, e).T >= needed(size[a:b, None], size[None, c:e])


def matches(batches, few: int = 24):
    """(rows, i, j) for tables of whole tokens of sorted lists: pairs of rows that match, i after j. Rows of a
    token come in order of doc_id, copy and line."""
    for t in whole_tokens(batches):
        token = t.column("token").to_numpy()
        sets = Sets(t.column("tokens"))
        cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        n = np.diff(cuts)
        group = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(n[group] <= few)
        i, j = [], []
        for d in range(1, few):
            at = at[at + d < cuts[group[at] + 1]]
            if not len(at):
                break
            i.append(at + d)
            j.append(at)
        if i:
            i, j = np.concatenate(i), np.concatenate(j)
            ok = sets.match(i, j)
            if ok.any():
                yield t, i[ok], j[ok]
        for k in np.flatnonzero(n > few).tolist():
            for a, c, ok in sets.alike(int(cuts[k]), int(cuts[k + 1])):
                i, j = np.nonzero(ok)
                i, j = i + cuts[k] + a, j + cuts[k] + c
                later = i > j
                if later.any():
                    yield t, i[later], j[later]


def whole_tokens(batches, rows: int = 5_000):
    """Tables of at least so many rows, or of 8 MB, that never split the rows of a token."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n < rows and size < 8_000_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        token = t.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
        size = sum(b.nbytes for b in held)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def verify_batches(batches):
    for t, i, _ in matches(batches):
        i = pa.array(np.unique(i))
        yield pa.Table.from_arrays([t.column(c).take(i) for c in ("doc_id", "copy", "line")], ["doc_id", "copy", "line"]).combine_chunks().to_batches()[0]


def drop_lines(text: str | None, gone) -> tuple[str, int, int]:
    """(what is left, lines, lines removed)."""
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    gone = set(gone)
    left = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def digest_batches(batches):
    for batch in batches:
        rows = [drop_lines(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                                          pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])


def text_batches(batches, gone: str):
    for batch in batches:
        names = [n for n in batch.schema.names if n != gone]
        texts = [None if t is None else drop_lines(t, g)[0] for t, g in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def met_lines(docs: DataFrame, rank: bytes, shingle: int = 0) -> DataFrame:
    """Written rows of MET: what is known to go, and what is to be verified at which token."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = arrow_map(docs, "tidemill.llm.lines:index_batches", INDEX, rank=rank, buckets=buckets, shingle=shingle)
    return written(arrow_map(index.repartition("bucket").sortWithinPartitions("bucket"), "tidemill.llm.lines:meet_batches", MET), "met")


def asked_lists(docs: DataFrame, met: DataFrame, rank: bytes, shingle: int = 0) -> DataFrame:
    """Rows of LISTS, by token, of all that is to be verified."""
    key = ["doc_id", "copy"]
    asked = met.filter("verify").groupBy(*key).agg(F.collect_list(F.struct("line", "token", "shard")).alias("asked"))
    # only documents with something to verify travel, where their ids are few enough to send around
    ids = met.filter("verify").select(*key).distinct()
    some = docs.join(F.broadcast(ids), key, "left_semi") if ids.limit(200_001).count() <= 200_000 else docs
    lists = arrow_map(some.join(asked, key).select(*key, "text", "asked"), "tidemill.llm.lines:list_batches", LISTS, rank=rank, shingle=shingle)
    return lists.repartition("token").sortWithinPartitions("token", "doc_id", "copy", "line")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, gone): the numbers of the lines of a numbered row that match an earlier one."""
    docs = documents.select("doc_id", "copy", "text")
    rank = rarity(docs)
    met = met_lines(docs, rank)
    verified = written(arrow_map(asked_lists(docs, met, rank), "tidemill.llm.lines:verify_batches", "doc_id long, copy long, line int"), "verified")
    gone = met.filter("not verify").select("doc_id", "copy", "line").union(verified)
    return gone.groupBy("doc_id", "copy").agg(F.collect_set("line").alias("gone"))


def summary(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (lowercase hex of the remaining lines joined by newlines).

    Lines are cut at newlines; a null or empty text has one empty line. Lines without a word
    are never removed, nor are lines of a row with a null doc_id. Rows that repeat a doc_id are
    different documents, in an order of their own that holds for the run: of equal lines in them one stays.
    An empty table gives no rows. Other columns are ignored.
    """
    docs = numbered(documents.select("doc_id", "text"))
    gone = repeated_lines(docs)
    return arrow_map(docs.join(gone, ["doc_id", "copy"], "left").select("doc_id", "text", "gone"), "tidemill.llm.lines:digest_batches", "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows with all their columns, their text without repeated lines.

    A null text stays null; rows with a null doc_id stay as they are; rows that repeat a doc_id are
    different documents, as in `summary`.
    """
    copy, gone = spare_name("copy", documents.columns), spare_name("gone", documents.columns)
    docs = numbered(documents, copy)
    found = repeated_lines(docs.select("doc_id", "text", F.col(copy).alias("copy"))).withColumnsRenamed({"copy": copy, "gone": gone})
    return arrow_map(docs.join(found, ["doc_id", copy], "left").select(*documents.columns, gone), "tidemill.llm.lines:text_batches", documents.schema, gone=gone)


def query(spark, sf_dir):
    return summary(table(spark, sf_dir, "documents"))
