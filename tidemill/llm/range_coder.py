"""Adaptive context-mixing range coder over token ids, many blocks in step.

Every block starts from empty statistics, so blocks are independent; numpy works on many of them
at once, one id of each per step. A block lists its distinct ids, and an id is coded as its place in that
list, in digits: two of 32 for up to 1,024 distinct ids, three of 16 for up to 4,096. For each digit
three orders predict: order 0 has counts of the digit after those before it in the id, orders 1 and 2 have
counts after the last id and the last two ids as well, in hashed slots. The three distributions are mixed:
an order's weight is the square of the probability that it gave of late to what came, learned for each
place of the digit and each degree of confidence. Counts are kept as sums up to each digit, so only the two ends of
a digit are mixed; decoding looks for it by halves. The mix drives the range coder. All arithmetic is
on integers, so any machine decodes what another wrote.

A block's bytes: magic, number of documents, ids and payload bytes, crc32 of the rest; then the number of
distinct ids, the bytes of their list, documents' ids, flags and lengths, the list, and the payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMB4"
HEAD, LIST = struct.Struct("<4sIQQI"), struct.Struct("<II")
TOP, BOTTOM, HIGH = np.uint64(1 << 56), np.uint64(1 << 48), np.uint64(56)
#: Rows of counts for each digit: of order 0 at most, and of orders 1 and 2 each; and blocks coded in step. A block
#: takes 140 KB with two digits of 32.
FIRST, ROWS = 1 + 16 + 256 + 4096, 1024
LANES = 1024
#: (base, digits) for lists of up to base ** digits ids; longer ones take more digits of 16.
SHAPES = ((32, 2), (16, 3))
#: What a digit adds to its count, and the sum beyond which a row is halved.
STEP, FULL = 24, 700
#: Degrees of confidence by the sum of counts, and how fast weights follow (as a power of two).
DEGREES, PACE = 8, 5
DEGREE = np.minimum(np.frexp(np.arange(FULL + STEP + 1) / STEP + 0.5)[1], DEGREES - 1).clip(0).astype(np.int64)
#: Digits coded between two settlings of the range: each takes at most 14 of its 48 bits.
UNSETTLED = 3
NULL, GOES_ON = 1, 2


class Models:
    """Statistics of all lanes; the three orders lie in one table, whose rows hold the counts summed up to each
    digit. `step` codes one id per lane: `narrow` gets each digit's range, `seek` looks digits up."""

    def __init__(self, lanes: int, shape: tuple[int, int]):
        self.base, digits = shape
        self.steps = [self.base ** k for k in range(digits)][::-1]
        self.nodes = np.cumsum([0, *self.steps[:0:-1]]).tolist()
        self.first = min(FIRST, self.nodes[-1] + self.steps[0])
        rows = self.first + 2 * ROWS
        self.upto = np.zeros((lanes * rows, self.base), np.uint16)
        self.row = self.upto.view(f"V{2 * self.base}").ravel()
        self.weight = np.full(digits * 3 * lanes * DEGREES, 1 << 14, np.int32)
        self.home = np.arange(lanes) * rows + np.array([[0], [self.first], [self.first + ROWS]])
        self.place = np.arange(digits * 3 * lanes).reshape(digits, 3, lanes) * DEGREES
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.added = np.triu(np.full((self.base, self.base), STEP, np.uint16))

    def step(self, n: int, ids: np.ndarray | None, coder: Range, settle, value: np.ndarray | None = None) -> np.ndarray:
        """ids: what to encode, or None to decode from the lanes' value."""
        one, two, home, base = self.one[:n], self.two[:n], self.home[:, :n], self.base
        mark = np.stack([one * 2654435761 + 40503, one * 2246822519 + two * 3266489917 + 374761393])
        so_far, rows, at = np.zeros(n, np.int64), np.empty((3, n), np.int64), np.arange(0, 3 * n * base, base).reshape(3, n)
        for digit, (before, unit) in enumerate(zip(self.nodes, self.steps)):
            node = so_far + before
            rows[0] = node if before < self.first else node % self.first
            rows[1:] = ((mark + node * 668265263) >> 9) & (ROWS - 1)
            rows += home
            row = rows.ravel()
            seen = self.upto.take(row, axis=0)
            flat, sums = seen.ravel(), seen[:, -1].astype(np.int32)
            place = self.place[digit, :, :n].ravel() + DEGREE.take(sums)
            weight, some = self.weight.take(place), np.maximum(sums, 1)
            share = ((((weight * weight) >> 16) << 6) // some).reshape(3, n)

            def mixed(counts):
                part = counts * share
                return (part[0] + part[1] + part[2]) >> 6

            span = coder.span[:n] // (mixed(sums.reshape(3, n)) + base).astype(np.uint64)
            if ids is not None:
                symbol = ids // unit % base
            else:
                where, symbol, half = ((value[:n] - coder.low[:n]) // span).astype(np.int64), np.zeros(n, np.int64), base >> 1
                while half:
                    middle = symbol + (half - 1)
                    symbol += half * (mixed(flat.take(at + middle)) + middle < where)
                    half >>= 1
            high = flat.take(at + symbol).astype(np.int32)
            low = flat.take(at + np.maximum(symbol - 1, 0)) * (symbol > 0).astype(np.int32)
            start = mixed(low) + symbol
            coder.narrow(n, start, mixed(high) + symbol + 1 - start, span)
            if digit % UNSETTLED == UNSETTLED - 1 or unit == 1:
                settle()
            self.weight[place] = weight + (((((high - low).ravel()) << 14) // some - weight) >> PACE) + 1
            counted = seen.reshape(3, n, base)
            counted += self.added.take(symbol, axis=0)
            full = np.flatnonzero(sums > FULL - STEP)
            if len(full):
                seen[full] >>= 1
            self.row[row] = seen.view(self.row.dtype).ravel()
            so_far = so_far * base + symbol
        self.two[:n], self.one[:n] = one.copy(), so_far
        return so_far


class Range:
    """The ranges of all lanes."""

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, n: int, start, freq, unit) -> None:
        self.low[:n] += start.astype(np.uint64) * unit
        self.span[:n] = freq.astype(np.uint64) * unit

    def normalise(self, n: int, shift) -> None:
        """Send out settled bytes: shift(at, bytes) for lanes. The span is at least 2**48 then."""
        at = np.arange(n)
        while len(at):
            a, r = self.low[at], self.span[at]
            end = a + r
            apart = np.where(end >= a, a ^ end, np.uint64(0xFFFFFFFFFFFFFFFF))
            settled = np.maximum(64 - np.frexp(apart.astype(np.float64))[1], 0) >> 3  # rounding up to a power of two only settles less
            small = (settled == 0) & (r < BOTTOM)
            self.span[at[small]] = (~a[small] + np.uint64(1)) & (BOTTOM - np.uint64(1))
            settled[small] = 1
            go = np.flatnonzero(settled)
            at, settled = at[go], settled[go]
            if len(at):
                shift(at, settled)
                bits = (8 * settled).astype(np.uint64)
                self.low[at] <<= bits
                self.span[at] <<= bits
                at = at[self.span[at] < BOTTOM]


def encode_lanes(streams: list[np.ndarray], shape: tuple[int, int]) -> list[bytes]:
    """Code each stream of places by itself, each place in digits of a shape."""
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    length = np.array([len(streams[i]) for i in order])
    data = np.zeros((int(length.max(initial=0)), len(order)), np.int64)
    for row, i in enumerate(order):
        data[:length[row], row] = streams[i]
    lanes = len(order)
    coder, n = Range(lanes), lanes
    out, size = np.zeros((lanes, 2 * len(data) + 64), np.uint8), np.zeros(lanes, np.int64)

    def put(at: np.ndarray, settled: np.ndarray) -> None:
        nonlocal out
        if size[at].max() + 16 >= out.shape[1]:
            out = np.hstack([out, np.zeros_like(out)])
        for k in range(int(settled.max())):  # bytes past the settled ones are written over later
            out[at, size[at] + k] = (coder.low[at] >> (HIGH - np.uint64(8 * k))).astype(np.uint8)
        size[at] += settled

    models = Models(lanes, shape)
    for t in range(len(data)):
        n = int(np.searchsorted(-length, -t, side="left"))
        models.step(n, data[t, :n], coder, lambda: coder.normalise(n, put))
    if lanes:
        put(np.arange(lanes), np.full(lanes, 8))
    result: list = [b""] * lanes
    for row, i in enumerate(order):
        result[i] = out[row, :size[row]].tobytes()
    return result


def decode_lanes(payloads: list[bytes], lengths: list[int], shape: tuple[int, int]) -> list[np.ndarray]:
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    length = np.array([lengths[i] for i in order])
    lanes, steps = len(order), int(length.max(initial=0))
    width = max((len(p) for p in payloads), default=0) + 16
    data = np.zeros((lanes, width), np.uint8)
    for row, i in enumerate(order):
        data[row, :len(payloads[i])] = np.frombuffer(payloads[i], np.uint8)
    coder, n = Range(lanes), lanes
    value = data[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    place = np.full(lanes, 8)
    out = np.zeros((steps, lanes), np.int64)

    def pull(at: np.ndarray, settled: np.ndarray) -> None:
        for k in range(int(settled.max())):
            some = at[settled > k]
            value[some] = (value[some] << np.uint64(8)) | data[some, np.minimum(place[some] + k, width - 1)]
        place[at] += settled

    models = Models(lanes, shape)
    for t in range(steps):
        n = int(np.searchsorted(-length, -t, side="left"))
        out[t, :n] = models.step(n, None, coder, lambda: coder.normalise(n, pull), value)
    result: list = [None] * lanes
    for row, i in enumerate(order):
        result[i] = out[:length[row], row].copy()
    return result


def by_lanes(function, shapes: list[tuple[int, int]], *lists) -> list:
    """Apply to lanes of one shape; results in the order given."""
    out: list = [None] * len(shapes)
    for shape in sorted(set(shapes)):
        at = [i for i, x in enumerate(shapes) if x == shape]
        for a in range(0, len(at), LANES):
            some = at[a:a + LANES]
            for i, got in zip(some, function(*([x[i] for i in some] for x in lists), shape)):
                out[i] = got
    return out


def shape_of(distinct: int) -> tuple[int, int]:
    """Digits that a place among so many distinct ids takes."""
    return next((s for s in SHAPES if distinct <= s[0] ** s[1]), (16, -(-(distinct - 1).bit_length() // 4)))


def pack_list(names: np.ndarray) -> bytes:
    """Ascending ids, as differences in byte planes."""
    return zlib.compress(np.diff(names, prepend=names.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 9)


def unpack_list(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, n).T.copy().view("<u4").ravel(), dtype=np.uint32)


def pack_blocks(blocks: list[tuple[list, list[np.ndarray], bool]]) -> list[bytes]:
    """Each block: (doc ids, or None; ids of each document in it, as little-endian 32-bit; does its first
    document go on from the block before?) -> its bytes."""
    names, streams = [], []
    for _, texts, _ in blocks:
        ids = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        name, place = np.unique(ids, return_inverse=True)
        names.append(name.astype("<u4"))
        streams.append(place)
    out = []
    for (docs, texts, goes_on), name, stream, payload in zip(blocks, names, streams, by_lanes(encode_lanes, [shape_of(len(x)) for x in names], streams)):
        flags = bytearray(NULL * (d is None) for d in docs)
        if docs and goes_on:
            flags[0] |= GOES_ON
        index = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + bytes(flags) + np.array([len(t) for t in texts], "<u8").tobytes()
        listed = pack_list(name)
        body = LIST.pack(len(name), len(listed)) + index + listed + payload
        out.append(HEAD.pack(MAGIC, len(docs), len(stream), len(payload), zlib.crc32(body)) + body)
    return out


def unpack_blocks(blocks: list[bytes]) -> list[tuple[list, list[np.ndarray], bool]]:
    """Inverse of pack_blocks; a block that doesn't match its checksum is an error."""
    heads, names, payloads, lengths = [], [], [], []
    for data in blocks:
        magic, docs, symbols, size, crc = HEAD.unpack_from(data)
        body = data[HEAD.size:]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("a block of token ids is damaged")
        distinct, listed = LIST.unpack_from(body)
        at = LIST.size + 8 * docs
        flags = body[at:at + docs]
        ids = [None if z & NULL else int(d) for d, z in zip(np.frombuffer(body, "<i8", docs, LIST.size), flags)]
        heads.append((ids, np.frombuffer(body, "<u8", docs, at + docs), bool(docs and flags[0] & GOES_ON)))
        end = at + 9 * docs
        names.append(unpack_list(body[end:end + listed], distinct))
        payloads.append(body[len(body) - size:])
        lengths.append(symbols)
    out = []
    for (docs, sizes, goes_on), name, places in zip(heads, names, by_lanes(decode_lanes, [shape_of(len(x)) for x in names], payloads, lengths)):
        ids = name[places].astype("<u4")
        out.append((docs, np.split(ids, np.cumsum(sizes)[:-1].astype(int)) if docs else [], goes_on))
    return out
