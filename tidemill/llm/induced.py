"""External induced suffix sorting that carries common prefixes.

The text is split into L- and S-type suffixes. The leftmost S-type suffixes (LMS) are sorted
first: an induction sorts their substrings, equal ones get equal names, and the string of names is
sorted by the same procedure, whatever its alphabet. From the sorted LMS suffixes a pass over
rising symbols induces all L-type suffixes and a pass over falling symbols all S-type ones.

Both passes are driven by a priority queue of tuples (suffix, length of the prefix it shares with the
tuple before it), by bucket of their symbol. A tuple taken from the head sends its predecessor to the
queue; the prefix that this one shares with the last predecessor sent to the same symbol is one more
than the least of all prefixes taken in between. Beyond `memory` tuples the queue's runs go to a
file and are read back when their bucket's turn comes. The text, a flag per symbol and about three
numbers per LMS suffix stay in memory; the order itself is only streamed. Prefixes are counted up to
`most` symbols. A string of so few names that it may be held in memory ends the recursion: it is
sorted by doubling.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 500_000
#: Tuples handled at once, and buckets of a queue (as a power of two).
CHUNK, BUCKET_BITS = 1 << 16, 8
MANY = np.iinfo(np.int32).max


class TupleQueue:
    """(suffix, prefix) tuples by bucket, first in, first out; buckets are taken in order by the caller."""

    def __init__(self, buckets: int, memory: int):
        self.runs: list[list] = [[] for _ in range(buckets)]
        self.log: list = []
        self.memory, self.held, self.file = memory, 0, None

    def push(self, bucket: np.ndarray, tuples: np.ndarray) -> None:
        if len(tuples):
            self.log.append((bucket, tuples))
            self.held += len(tuples)
            if self.held > self.memory:
                self.spill()

    def deal(self) -> None:
        if not self.log:
            return
        bucket, tuples = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*self.log))
        self.log = []
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        tuples, bucket = tuples[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            self.runs[bucket[a]].append(tuples[a:b])

    def spill(self) -> None:
        self.deal()
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs:
            for i, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    runs[i] = (self.file.tell(), len(run))
                    np.ascontiguousarray(run).tofile(self.file)
        self.held = 0

    def take(self, bucket: int) -> np.ndarray:
        self.deal()
        runs, self.runs[bucket] = self.runs[bucket], []
        out = []
        for run in runs:
            if isinstance(run, tuple):
                self.file.seek(run[0])
                run = np.fromfile(self.file, np.int32, 2 * run[1]).reshape(-1, 2)
            else:
                self.held -= len(run)
            out.append(run)
        return np.concatenate(out) if out else np.empty((0, 2), np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Least:
    """Least value of any range of an array, from a table of powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows, width = [values], 1
        while 2 * width <= longest:
            low = self.rows[-1]
            self.rows.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of [first, last], both inside."""
        power = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int32)
        for k in np.flatnonzero(np.bincount(power)).tolist():
            at = np.flatnonzero(power == k)
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type: smaller than its successor. The last one is L-type."""
    out = np.zeros(len(text), bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    if len(change):
        out[:change[-1] + 1] = np.repeat(text[change] < text[change + 1], np.diff(change, prepend=-1))
    return out


def same_before(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many symbols directly before each place equal its own."""
    out, k = np.zeros(len(at), np.int32), 1
    live = np.flatnonzero(at > 0)
    live = live[text[at[live] - 1] == text[at[live]]]
    while len(live) > 8:
        out[live] = k
        k += 1
        live = live[at[live] >= k]
        live = live[text[at[live] - k] == text[at[live]]]
    for i in live.tolist():
        end = int(at[i]) - k + 1
        while end > 0:
            begin = max(0, end - 4096)
            other = np.flatnonzero(text[begin:end] != text[at[i]])
            if len(other):
                end = begin + int(other[-1]) + 1
                break
            end = begin
        out[i] = at[i] - end
    return out


def run_length(text: np.ndarray, at: int) -> int:
    end = at
    while end < len(text):
        other = np.flatnonzero(text[end:end + 4096] != text[at])
        if len(other):
            return end + int(other[0]) - at
        end += 4096
    return len(text) - at


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Prefixes that pairs of suffixes share, from as many symbols as are known to agree."""
    out, at, n = np.minimum(known, most).astype(np.int32), np.flatnonzero(known < most), len(text)
    while len(at) > 8:
        at = at[out[at] < most]
        x, y = a[at] + out[at], b[at] + out[at]
        inside = np.maximum(x, y) < n
        at, x, y = at[inside], x[inside], y[inside]
        at = at[text[x] == text[y]]
        out[at] += 1
    for i in at.tolist():
        while out[i] < most:
            x, y = int(a[i]) + int(out[i]), int(b[i]) + int(out[i])
            size = min(4096, n - max(x, y), most - int(out[i]))
            other = np.flatnonzero(text[x:x + size] != text[y:y + size])
            out[i] += int(other[0]) if len(other) else size
            if len(other) or x + size == n or y + size == n:
                break
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string in memory, by ranks of prefixes of doubling length."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank, step = np.empty(n, np.int64), 1
    new = np.append(True, names[order][1:] != names[order][:-1])
    while True:
        # a rank is the place of the group's first member; groups of one are settled
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        again = np.lexsort((after, head[open_]))
        order[open_], after, group = at[again], after[again], head[open_][again]
        new[open_[1:]] |= (after[1:] != after[:-1]) & (group[1:] == group[:-1])
        step *= 2


class Pass:
    """One induction pass, over rising symbols (L-type) or falling ones (S-type).

    `given(bucket)` has the suffixes that come after the induced ones of their symbol, in the pass's
    order. A bucket's symbols are handled in groups: as many at once as send nothing to each other.
    """

    def __init__(self, text, s_type, symbols: int, up: bool, memory: int, most: int, given):
        self.most = most
        self.text, self.s_type, self.up, self.given, self.top = text, s_type, up, given, symbols - 1
        self.shift = max(0, self.top.bit_length() - BUCKET_BITS)
        self.buckets = (self.top >> self.shift) + 1
        self.queue = TupleQueue(self.buckets, memory)
        self.last = np.full(symbols, -1, np.int64)  # when a tuple was last sent to a symbol
        self.clock, self.times, self.least = 0, np.empty(0, np.int64), np.empty(0, np.int32)
        self.bucket, self.back = -1, []

    def symbol(self, at: np.ndarray) -> np.ndarray:
        s = self.text[at].astype(np.int32)
        return s if self.up else self.top - s

    def start(self, suffix: int) -> None:
        """The end of the text is smaller than any symbol and sends the last suffix."""
        d = self.symbol(np.array([suffix]))
        self.last[d], self.clock = 0, 1
        self.queue.push(d >> self.shift, np.array([[suffix, 0]], np.int32))

    def __iter__(self):
        """(suffixes, prefixes shared with the suffix before in this order, which were given)."""
        for k in range(self.buckets):
            self.bucket = k
            mine, theirs = self.queue.take(k), self.given(k)
            if len(mine) or len(theirs):
                yield from self.one_bucket(mine, theirs)
        self.queue.close()

    def one_bucket(self, mine, theirs):
        sym = self.symbol(mine[:, 0])
        other = self.symbol(theirs[:, 0])
        fresh = True
        while len(mine) or len(theirs):
            if fresh:
                if self.shift:
                    order = np.argsort(sym, kind="stable")
                    mine, sym = mine[order], sym[order]
                chain = same_before(self.text, mine[:, 0])
            n_mine, n_theirs = len(mine), len(theirs)
            if self.shift:
                n_mine, n_theirs = self.group(mine, sym, chain, theirs, other)
            yield from self.settle(mine[:n_mine], sym[:n_mine], chain[:n_mine], theirs[:n_theirs], other[:n_theirs])
            mine, sym, chain, theirs, other = mine[n_mine:], sym[n_mine:], chain[n_mine:], theirs[n_theirs:], other[n_theirs:]
            fresh = bool(self.back)
            if fresh:
                new = np.concatenate([t for _, t in self.back])
                sym = np.concatenate([sym, *(d for d, _ in self.back)])
                mine, self.back = np.concatenate([mine, new]), []

    def sends(self, at: np.ndarray) -> np.ndarray:
        """Symbol of the predecessor of each place, MANY where it isn't of this pass or has the same symbol."""
        before = np.maximum(at - 1, 0)
        ok = (at > 0) & (self.s_type[before] != self.up) & (self.text[before] != self.text[at])
        return np.where(ok, self.symbol(before), MANY)

    def group(self, mine, sym, chain, theirs, other) -> tuple[int, int]:
        """How many of both come before the first symbol that one of them sends to."""
        every = np.concatenate([sym, other])
        to = np.concatenate([self.sends(mine[:, 0] - chain), self.sends(theirs[:, 0])])
        order = np.argsort(every, kind="stable")
        every = every[order]
        low = np.minimum.accumulate(to[order])
        ends = np.append(np.flatnonzero(every[1:] != every[:-1]), len(every) - 1)
        limit = np.append(every[ends[:-1] + 1], MANY)
        good = np.flatnonzero(low[ends] >= limit)
        # the last bucket's end counts as a limit too: what is sent beyond it goes to the queue
        beyond = low[-1] > ((self.bucket + 1) << self.shift) - 1
        upto = MANY if beyond else int(limit[good[-1]]) if len(good) else int(limit[0])
        return int(np.searchsorted(sym, upto)), int(np.searchsorted(other, upto))

    def settle(self, mine, sym, chain, theirs, other):
        """Order of the tuples of a group of symbols, which nothing more is sent to."""
        suffix, prefix = mine[:, 0], mine[:, 1].copy()
        if len(sym):
            prefix[np.append(True, sym[1:] != sym[:-1])] = 0
        if len(chain) and chain.max():
            # a run of one symbol sends to itself: its members come by their distance from the run's end
            of = np.repeat(np.arange(len(chain)), chain + 1)
            level = np.arange(len(of)) - (np.cumsum(chain + 1) - chain - 1)[of]
            order = np.lexsort((level, sym[of])) if self.shift else np.argsort(level, kind="stable")
            of, level = of[order], level[order]
            again = np.append(False, (level[1:] == level[:-1]) & (sym[of[1:]] == sym[of[:-1]]))
            shared = level.astype(np.int32)
            deep = np.flatnonzero(again & (level > 0))
            if len(deep):
                a, b = of[deep - 1] + 1, of[deep]
                shared[deep] += Least(prefix, int((b - a).max()) + 1)(a, b)
            flat = level == 0
            shared[flat] = prefix[of[flat]]
            suffix, prefix, sym = suffix[of] - level.astype(np.int32), np.minimum(shared, self.most), sym[of]
        is_given = np.zeros(len(suffix) + len(theirs), bool)
        if len(theirs):
            begins = np.append(True, other[1:] != other[:-1])
            second = theirs[:, 1].copy()
            at = np.searchsorted(sym, other[begins], side="right") - 1
            for i, j in zip(np.flatnonzero(begins).tolist(), at.tolist()):
                # an L- and an S-type suffix of one symbol share its run
                second[i] = min(run_length(self.text, int(suffix[j])), run_length(self.text, int(theirs[i, 0])), self.most) if j >= 0 and sym[j] == other[i] else 0
            place = np.searchsorted(sym, other, side="right") + np.arange(len(other))
            is_given[place] = True
            both = np.empty((2, len(is_given)), np.int32)
            both[0, ~is_given], both[1, ~is_given] = suffix, prefix
            both[0, is_given], both[1, is_given] = theirs[:, 0], second
            suffix, prefix = both
        for a in range(0, len(suffix), CHUNK):
            s, p = suffix[a:a + CHUNK], prefix[a:a + CHUNK]
            self.send(s, p)
            yield s, p, is_given[a:a + CHUNK]

    def send(self, suffix: np.ndarray, prefix: np.ndarray) -> None:
        to = self.sends(suffix)
        at = np.flatnonzero(to != MANY)
        if len(at):
            order = np.argsort(to[at], kind="stable")
            at = at[order]
            d = to[at]
            first = np.append(True, d[1:] != d[:-1])
            shared = np.empty(len(at), np.int32)
            later = np.flatnonzero(~first)
            if len(later):
                a, b = at[later - 1] + 1, at[later]
                shared[later] = Least(prefix, int((b - a).max()) + 1)(a, b) + 1
            head = np.flatnonzero(first)
            since = self.last[d[head]]
            known = np.flatnonzero(since >= 0)
            shared[head] = 0
            if len(known):
                j = at[head[known]]
                low = np.minimum.accumulate(prefix)[j]
                if len(self.times):
                    k = np.searchsorted(self.times, since[known], side="right")
                    low = np.minimum(low, np.append(self.least, MANY)[k])
                shared[head[known]] = low + 1
            tail = np.append(head[1:], len(at)) - 1
            self.last[d[tail]] = self.clock + at[tail]
            tuples = np.stack([suffix[at] - 1, np.minimum(shared, self.most)], axis=1).astype(np.int32)
            here = d >> self.shift
            if self.shift and (here[0] == self.bucket):
                n = int(np.searchsorted(here, self.bucket, side="right"))
                self.back.append((d[:n], tuples[:n]))
                here, tuples = here[n:], tuples[n:]
            self.queue.push(here, tuples)
        # least prefix since any moment: times at which it is smaller than at all later ones
        low = np.minimum.accumulate(prefix[::-1])[::-1]
        record = np.append(np.flatnonzero(prefix[:-1] < low[1:]), len(prefix) - 1)
        keep = int(np.searchsorted(self.least, low[0]))
        self.times = np.concatenate([self.times[:keep], self.clock + record])
        self.least = np.concatenate([self.least[:keep], prefix[record]])
        self.clock += len(suffix)


def induce(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: int, memory: int, most: int):
    """(suffixes, prefixes) in falling order, from LMS suffixes (suffix, prefix) in rising order of their symbols."""
    shift = max(0, (symbols - 1).bit_length() - BUCKET_BITS)
    place = np.searchsorted(text[seeds[:, 0]] >> shift, np.arange(((symbols - 1) >> shift) + 2))
    up = Pass(text, s_type, symbols, True, memory, most, lambda k: seeds[place[k]:place[k + 1]])
    up.start(len(text) - 1)
    lefts = TupleQueue(up.buckets, memory)
    for suffix, prefix, is_given in up:
        own = ~is_given
        lefts.push((text[suffix[own]] >> shift).astype(np.int32), np.stack([suffix[own], prefix[own]], axis=1))

    def fallen(k: int) -> np.ndarray:
        # symbols are counted from the top, so buckets may cut them elsewhere than on the way up
        low, high = max(0, symbols - ((k + 1) << down.shift)), symbols - 1 - (k << down.shift)
        rows = [held.pop(b) if b in held else lefts.take(b) for b in range(high >> shift, (low >> shift) - 1, -1)]
        rows = np.concatenate(rows[::-1])
        s = text[rows[:, 0]]
        cut = int(np.searchsorted(s, low))
        if cut:
            held[low >> shift] = rows[:cut]
        rows = rows[cut:][::-1].copy()
        if len(rows):
            # an L-type suffix's prefix is that with the next smaller one: with the next larger in this order
            rows[1:, 1] = rows[:-1, 1]
            rows[0, 1] = 0
        return rows

    held: dict = {}
    down = Pass(text, s_type, symbols, False, memory, most, fallen)
    for suffix, prefix, _ in down:
        yield suffix, prefix
    lefts.close()


def falling(text: np.ndarray, symbols: int = 256, memory: int = MEMORY, most: int = MANY - 1, names: int = 0):
    """All suffixes as (starts, prefixes shared with the one before in this order), in falling lexicographic
    order, in pieces; a suffix that ends first is smaller. A string of at most `names` names is sorted in memory."""
    n = len(text)
    if not n:
        return
    s_type = types(text)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    seeds = np.stack([lms, np.zeros_like(lms)], axis=1)
    if len(lms) > 1:
        rough = seeds[np.argsort(text[lms], kind="stable")]
        rough[:, 1] = 1
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found, shared, least = [], [], MANY
        for suffix, prefix in induce(text, s_type, rough, symbols, memory, MANY - 1):
            at = np.flatnonzero(is_lms[suffix])
            if not len(at):
                least = min(least, int(prefix.min()))
                continue
            low = np.minimum.reduceat(prefix[:at[-1] + 1], np.append(0, at[:-1] + 1))
            low[0] = min(low[0], least)
            found.append(suffix[at])
            shared.append(low)
            rest = prefix[at[-1] + 1:]
            least = int(rest.min()) if len(rest) else MANY
        ranked, shared = rising(np.concatenate(found), np.concatenate(shared))
        del found
        # LMS substrings of one length that share all of it are equal; the last one equals no other
        length = np.empty(len(lms), np.int32)
        length[:-1], length[-1] = np.diff(lms) + 1, 0
        number = np.zeros(n, np.int32)
        number[lms] = np.arange(len(lms), dtype=np.int32)
        size = length[number[ranked]]
        same = (size[1:] == size[:-1]) & (shared[1:] >= size[1:]) & (size[1:] > 0)
        name = np.append(0, np.cumsum(~same)).astype(np.int32)
        if name[-1] + 1 < len(lms):
            reduced = np.empty(len(lms), np.int32)
            reduced[number[ranked]] = name
            order, names_shared = suffix_order(reduced, int(name[-1]) + 1, memory, -(-most // 2), names) if len(reduced) > names else in_memory(reduced, -(-most // 2))
            ranked = lms[order]
            shared = np.append(0, lms[order[1:] + names_shared[1:]] - lms[order[1:]]).astype(np.int32)
        del number, is_lms
        seeds = np.stack([ranked, np.append(0, extend(text, ranked[:-1], ranked[1:], shared[1:], most))], axis=1).astype(np.int32)
    yield from induce(text, s_type, seeds, symbols, memory, most)


def rising(suffix: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order from its other end."""
    return suffix[::-1], np.append(0, prefix[1:][::-1]).astype(np.int32)[:len(suffix)]


def in_memory(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = doubled(names)
    return order, np.append(0, extend(names, order[:-1], order[1:], np.zeros(len(order) - 1, np.int32), most)).astype(np.int32)


def suffix_order(text: np.ndarray, symbols: int = 256, memory: int = MEMORY, most: int = MANY - 1, names: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All suffix starts in lexicographic order, and the prefix each shares with the one before."""
    parts = list(falling(text, symbols, memory, most, names))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return rising(*(np.concatenate(x) for x in zip(*parts)))
