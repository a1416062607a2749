"""External induced sorting of suffixes with their common-prefix values.

A suffix is of type S if it is smaller than the next one, else L; an S suffix after an L one is a seed. The substrings
between seeds are sorted and named, and the string of names is sorted by recursion, down to one that memory holds. The
order of the seeds then induces that of all L suffixes (rising) and of all S suffixes (falling). What is induced goes
through a monotone priority queue of tuples (symbol, suffix, symbols to its left, common prefix with the tuple before),
first in first out within a symbol. Tuples carry the symbols to their left, so induction reads the string in order of
place only, save where a run is longer than a tuple has room for.

Memory follows Disk.limit and not the string: columns beyond it are mapped files, and queues, logs, scattered columns
and the sort of the substrings keep so many tuples and write the rest to files in blocks. Only comparisons at the
borders of buckets, and of neighbouring seeds, read the mapped string at arbitrary places. The files are unnamed ones
of this task and go with it, like those that Spark's own sort spills to the same folders; a lost task starts anew.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that a column, queue, log or sort keeps in memory; a string of twice as many names is no longer recursed on.
IN_MEMORY = 1 << 19
#: Slots of a queue, and symbols of a string up to which common prefixes are carried.
WAYS = 1024
_NEVER = 255


def spill_folder() -> str | None:
    """The folder that Spark gives this worker for spilling, if it gives one."""
    found = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return found if found and os.path.isdir(found) else None


class Disk:
    """The files of one sort. limit: tuples kept in memory by each of its parts; written: tuples that went to files."""

    def __init__(self, limit: int = IN_MEMORY, folder: str | None = None):
        self.limit, self.folder, self.files, self.written = limit, folder or spill_folder(), [], 0
        self.block = max(1, min(limit, 1 << 16))

    def file(self):
        f = tempfile.TemporaryFile(dir=self.folder)
        self.files.append(f)
        return f

    def column(self, n: int, dtype) -> np.ndarray:
        if n <= self.limit:
            return np.zeros(n, dtype)
        return np.memmap(self.file(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        for f in self.files:
            f.close()


class Log:
    """Tuples in order of arrival, in memory up to the limit and then in a file; read by pieces, forward or backward."""

    def __init__(self, disk: Disk, *dtypes):
        self.disk, self.dtypes, self.parts, self.held, self.n, self.size, self.f = disk, [np.dtype(d) for d in dtypes], [], [], 0, 0, None

    def append(self, *columns) -> None:
        if len(columns[0]):
            self.held.append([np.asarray(c, d) for c, d in zip(columns, self.dtypes)])
            self.n += len(columns[0])
            self.size += len(columns[0])
            if self.n > self.disk.limit:
                self.spill()

    def spill(self) -> None:
        if self.held:
            self.f = self.f or self.disk.file()
            columns = [np.concatenate(c) for c in zip(*self.held)]
            for a in range(0, len(columns[0]), self.disk.block):
                self.f.seek(0, 2)
                self.parts.append((self.f.tell(), len(columns[0][a : a + self.disk.block])))
                for c in columns:
                    self.f.write(c[a : a + self.disk.block].tobytes())
            self.disk.written += len(columns[0])
            self.held, self.n = [], 0

    def read(self, part) -> list[np.ndarray]:
        at, n = part
        self.f.seek(at)
        return [np.frombuffer(self.f.read(n * d.itemsize), d) for d in self.dtypes]

    def _in_memory(self) -> list[list[np.ndarray]]:
        whole = [np.concatenate(c) for c in zip(*self.held)] if self.held else []
        step = self.disk.block
        return [[c[a : a + step] for c in whole] for a in range(0, len(whole[0]), step)] if whole else []

    def forward(self) -> Iterator[list[np.ndarray]]:
        for part in self.parts:
            yield self.read(part)
        yield from self._in_memory()

    def backward(self) -> Iterator[list[np.ndarray]]:
        yield from reversed(self._in_memory())
        for part in reversed(self.parts):
            yield self.read(part)

    def whole(self) -> list[np.ndarray]:
        parts = list(self.forward())
        return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, d) for d in self.dtypes]


class Scatter:
    """A column filled in any order: values are dealt by place to logs, and each log is put in order by itself."""

    def __init__(self, disk: Disk, n: int, dtype):
        self.disk, self.out = disk, disk.column(n, dtype)
        self.direct = n <= disk.limit
        if not self.direct:
            self.width = max(1, disk.limit // 2, -(-n // WAYS))
            self.logs = [Log(Disk_share(disk, -(-n // self.width)), np.int64, dtype) for _ in range(-(-n // self.width))]

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        if self.direct:
            self.out[at] = values
            return
        log = at // self.width
        order = np.argsort(log, kind="stable")
        cuts = np.flatnonzero(np.diff(log[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                self.logs[log[part[0]]].append(at[part], values[part])

    def done(self) -> np.ndarray:
        if not self.direct:
            for k, log in enumerate(self.logs):
                at, values = log.whole()
                part = np.zeros(len(at), self.out.dtype)
                part[at - k * self.width] = values
                self.out[k * self.width : k * self.width + len(part)] = part
        return self.out


def Disk_share(disk: Disk, ways: int) -> Disk:
    """A disk whose parts share the limit of one; files are still closed by the whole."""
    share = Disk(max(1, disk.limit // ways), disk.folder)
    share.block, share.files = max(1, min(disk.block, share.limit)), disk.files
    return share


class Queue:
    """Monotone priority queue of tuples by symbol, first in first out within one.

    Slots are ranges of symbols; opening one deals its tuples to a queue of finer slots, down to single symbols.
    """

    def __init__(self, disk: Disk, bits: int, dtypes):
        # shifts are multiples of ten, so that the finest queues have as many symbols as slots
        self.disk, self.shift, self.dtypes = disk, max(0, -(-(bits - 10) // 10) * 10), list(map(np.dtype, dtypes))
        self.held: dict[int, list] = {}
        self.spilt: dict[int, list] = {}
        self.n, self.f, self.open, self.child = 0, None, None, None

    def push(self, symbols: np.ndarray, columns: list[np.ndarray]) -> None:
        """Tuples sorted by symbol; those of one symbol stand in order of arrival."""
        if not len(symbols):
            return
        slot = (symbols >> self.shift) % WAYS
        cuts = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = int(slot[a])
            if self.shift and k == self.open:
                self.child.push(symbols[a:b], [c[a:b] for c in columns])
            else:
                self.held.setdefault(k, []).append([symbols[a:b], *[c[a:b] for c in columns]])
                self.n += b - a
        if self.n > self.disk.limit:
            self.spill()

    def spill(self) -> None:
        self.f = self.f or self.disk.file()
        self.f.seek(0, 2)
        for k, blocks in self.held.items():
            if blocks:
                columns = [np.concatenate(c) for c in zip(*blocks)]
                for a in range(0, len(columns[0]), self.disk.block):
                    part = [np.ascontiguousarray(c[a : a + self.disk.block], d) for c, d in zip(columns, self.dtypes)]
                    self.spilt.setdefault(k, []).append((self.f.tell(), len(part[0])))
                    for c in part:
                        self.f.write(c.tobytes())
        self.held = {}
        self.disk.written += self.n
        self.n = 0

    def take(self, k: int) -> Iterator[list[np.ndarray]]:
        """Blocks of a slot; what is pushed to it meanwhile follows."""
        while self.spilt.get(k) or self.held.get(k):
            if self.spilt.get(k):
                at, n = self.spilt[k].pop(0)
                self.f.seek(at)
                symbols, p, *rest = (np.frombuffer(self.f.read(n * d.itemsize), d) for d in self.dtypes)
                yield [symbols.astype(np.int64), p.astype(np.int64), *rest]
            else:
                blocks = self.held.pop(k)
                columns = [np.concatenate(c) for c in zip(*blocks)] if len(blocks) > 1 else blocks[0]
                self.n -= len(columns[0])
                for a in range(0, len(columns[0]), self.disk.block):
                    yield [c[a : a + self.disk.block] for c in columns]

    def of(self, symbol: int) -> Iterator[list[np.ndarray]]:
        k = (symbol >> self.shift) % WAYS
        if not self.shift:
            yield from self.take(k)
            return
        if k != self.open:
            self.child, self.open = Queue(self.disk, self.shift, self.dtypes), None
            for symbols, *columns in self.take(k):
                order = np.argsort(symbols, kind="stable")
                self.child.push(symbols[order], [c[order] for c in columns])
            self.open = k
        yield from self.child.of(symbol)


class Left:
    """The symbols before a place, packed into one number with their count in the lowest four bits."""

    def __init__(self, text: np.ndarray, bits: int):
        self.text, self.bits, self.room, self.mask = text, bits, min(15, 60 // bits), np.uint64((1 << bits) - 1)

    def at(self, p: np.ndarray) -> np.ndarray:
        out = np.minimum(p, self.room).astype(np.uint64)
        for j in range(self.room):
            q = p - 1 - j
            symbol = self.text[np.maximum(q, 0)].astype(np.uint64)
            symbol[q < 0] = 0
            out |= symbol << np.uint64(4 + self.bits * j)
        return out

    def filled(self, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero(((left & np.uint64(15)) == 0) & (p > 0))
        if len(empty):
            left = left.copy()
            left[empty] = self.at(p[empty])
        return left

    def first(self, left: np.ndarray) -> np.ndarray:
        return ((left >> np.uint64(4)) & self.mask).astype(np.int64)

    def rest(self, left: np.ndarray) -> np.ndarray:
        return ((left >> np.uint64(4 + self.bits)) << np.uint64(4)) | ((left & np.uint64(15)) - np.uint64(1))


def sort_suffixes(text: np.ndarray, disk: Disk, cap: int = 0, span: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffixes in falling order, each with the length of the prefix that it shares with the one before it in
    that order, up to cap (0: not wanted; at most 254).

    The last symbol must be 0 and the only 0. With span, suffixes that agree in so many symbols may stand in any order.
    """
    n = len(text)
    if n > 1:
        yield from _Sort(text, disk, cap, span).blocks()
    yield np.array([n - 1]), np.zeros(1, np.uint8)


class _Sort:
    def __init__(self, text, disk, cap, span):
        self.text, self.disk, self.cap, self.span = text, disk, cap, span
        top = max(int(text[a : a + disk.block].max()) for a in range(0, len(text), disk.block))
        self.bits = (top + 1).bit_length()
        if cap and top >= WAYS or cap > 254:
            raise ValueError("common prefixes are carried for few symbols and short caps")
        self.top, self.left = top, Left(text, self.bits)
        self.pad = np.uint64((1 << self.bits) - 1)
        self.width = 64 // self.bits
        #: symbol, suffix, symbols to the left, common prefix
        self.tuple = np.min_scalar_type(top), np.min_scalar_type(len(text)), np.uint64, np.uint8

    def blocks(self):
        self.seeds = self.find_seeds()
        rank, known = self.ranked()
        self.place(rank)
        yield from self.fall(self.rise(known))

    # seeds, from the right

    def find_seeds(self) -> np.ndarray:
        text, n, step = self.text, len(self.text), self.disk.block
        log = Log(self.disk, np.int64)
        after, after_small = -1, True  # the symbol and type at the block's end
        for a in range((n - 1) // step * step, -1, -step):
            t = text[a : a + step].astype(np.int64)
            rise = np.append(np.sign(t[1:] - t[:-1]), np.sign(after - t[-1]) if a + step < n else 1)
            at = np.where(rise != 0, np.arange(len(t)), len(t))
            at = np.minimum.accumulate(at[::-1])[::-1]
            small = np.append(rise, 1 if after_small else -1)[at] > 0
            if a + step < n and after_small and not small[-1]:
                log.append(np.array([a + step]))
            log.append(np.flatnonzero(small[1:] & ~small[:-1])[::-1] + 1 + a)
            after, after_small = t[0], bool(small[0])
        out, at = self.disk.column(log.size, np.int64), log.size
        for (p,) in log.forward():
            out[at - len(p) : at] = p[::-1]
            at -= len(p)
        return out

    # names and ranks of the seeds

    def words(self, k: np.ndarray, depth: int) -> np.ndarray:
        """The next symbols of the substrings that begin at the seeds of numbers k, packed; past its end, where the
        next seed is its last symbol, a substring goes on with the largest symbol: of two, one a prefix of the other,
        the shorter is the larger."""
        begin = self.seeds[k] + depth * self.width
        end = self.seeds[np.minimum(k + 1, len(self.seeds) - 1)]
        out = np.zeros(len(k), np.uint64)
        for j in range(self.width):
            p = begin + j
            symbol = self.text[np.minimum(p, len(self.text) - 1)].astype(np.uint64)
            symbol[p > end] = self.pad
            out = (out << np.uint64(self.bits)) | symbol
        return out

    def longest(self, k: np.ndarray) -> int:
        return int((self.seeds[np.minimum(k + 1, len(self.seeds) - 1)] - self.seeds[k]).max()) + 1

    def named(self, k: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Seed numbers in order of their substrings, and where a substring differs from the one before; in memory."""
        order = np.argsort(word)
        k, word = k[order], word[order]
        new = np.append(True, word[1:] != word[:-1])
        while True:
            depth += 1
            group = np.cumsum(new) - 1
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(several):
                break
            several = several[np.maximum.reduceat(self.seeds[np.minimum(k[several] + 1, len(self.seeds) - 1)] - self.seeds[k[several]] + 1, np.flatnonzero(np.append(True, np.diff(group[several]) > 0)))[np.cumsum(np.append(0, np.diff(group[several]) > 0))] > depth * self.width]
            if not len(several):
                break
            word = self.words(k[several], depth)
            g = group[several]
            order = np.lexsort((word, g))
            k[several], word, g = k[several][order], word[order], g
            new[several[1:]] |= (word[1:] != word[:-1]) & (g[1:] == g[:-1])
        return k, new

    def name_all(self, source: Iterator, size: int, depth: int, emit) -> None:
        """Sorts (word, seed number) tuples through files: samples deal them to ranges of words, and to single words
        that recur, until a range fits memory."""
        if size <= self.disk.limit:
            parts = list(source)
            emit(*self.named(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts]), depth))
            return
        kept = Log(self.disk, np.uint64, np.int64)
        sample = []
        for word, k in source:
            sample.append(word[:: max(1, size // 4096)][:4096])
            kept.append(word, k)
        marks = np.unique(np.concatenate(sample))
        marks = marks[:: max(1, len(marks) // 100)]
        logs = [Log(Disk_share(self.disk, 2 * len(marks) + 1), np.uint64, np.int64) for _ in range(2 * len(marks) + 1)]
        for word, k in kept.forward():
            slot = 2 * np.searchsorted(marks, word, "left")
            slot[(slot < 2 * len(marks)) & (marks[np.minimum(slot // 2, len(marks) - 1)] == word)] += 1
            order = np.argsort(slot, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
                logs[slot[part[0]]].append(word[part], k[part])
        for slot, log in enumerate(logs):
            if not log.size:
                continue
            if slot % 2 == 0:
                self.name_all(log.forward(), log.size, depth, emit)
            elif log.size <= self.disk.limit:
                self.name_all(log.forward(), log.size, depth, emit)
            elif max(self.longest(k) for _, k in log.forward()) > (depth + 1) * self.width:
                self.name_all(((self.words(k, depth + 1), k) for _, k in log.forward()), log.size, depth + 1, emit)
            else:
                for j, (_, k) in enumerate(log.forward()):
                    emit(k, np.append(j == 0, np.zeros(len(k) - 1, bool)))

    def ranked(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The rank of each seed suffix among them, and for each rank how many symbols it is known to share with the
        one before."""
        m, disk = len(self.seeds), self.disk
        names, count = Scatter(disk, m, np.int64), 0

        def emit(k, new):
            nonlocal count
            if len(k):
                # a part begins with a new name unless it goes on with a single word
                name = count - 1 + np.cumsum(new)
                names.put(k, name)
                count = int(name[-1]) + 1

        numbers = (np.arange(a, min(m, a + disk.block)) for a in range(0, m, disk.block))
        self.name_all(((self.words(k, 0), k) for k in numbers), m, 0, emit)
        name = names.done()
        if count == m:
            return name, None
        if m <= 2 * disk.limit:
            return self.doubled(np.asarray(name))
        rank, done = Scatter(disk, m, np.int64), 0
        for k, _ in sort_suffixes(name, disk):
            rank.put(k, m - 1 - done - np.arange(len(k)))
            done += len(k)
        return rank.done(), None

    def doubled(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes of a string of names that fits memory: names of 1, 2, 4, ... names in a row."""
        m, starts = len(name), self.seeds
        order = np.argsort(name)
        new = np.append(True, np.diff(name[order]) > 0)
        agreed, h = np.zeros(m, np.int64), 1
        head = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        rank = np.empty(m, np.int64)
        rank[order] = head
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        while len(open_):
            k = order[open_]
            if self.span:
                far = starts[k + h] - starts[k] >= self.span
                open_, k = open_[~far], k[~far]
                if not len(open_):
                    break
            g = rank[k]
            key = rank[k + h]
            by = np.argsort(g * m + key)
            k, key, g2 = k[by], key[by], g[by]
            order[open_] = k
            split = np.append(False, (key[1:] != key[:-1]) & (g2[1:] == g2[:-1]))
            new[open_[split]], agreed[open_[split]] = True, h
            head = np.maximum.accumulate(np.where(new[open_], open_, -1))
            rank[k] = head
            nxt = np.append(open_[1:], m)
            ends = np.where(open_ + 1 < m, new[np.minimum(open_ + 1, m - 1)], True)
            open_ = open_[~(new[open_] & (ends | (nxt != open_ + 1) & ends))]
            h *= 2
        known = starts[np.minimum(order + agreed, m - 1)] - starts[order]
        if self.span:
            known = np.where(new, known, self.span)
        out = np.empty(m, np.int64)
        out[order] = np.arange(m)
        return out, known

    def place(self, rank: np.ndarray) -> None:
        """Seeds and the symbols to their left in order of rank, and how many seeds begin with each symbol."""
        m, step = len(self.seeds), self.disk.block
        where, left = Scatter(self.disk, m, np.int64), Scatter(self.disk, m, np.uint64)
        for a in range(0, m, step):
            p = np.asarray(self.seeds[a : a + step])
            where.put(np.asarray(rank[a : a + step]), p)
            left.put(np.asarray(rank[a : a + step]), self.left.at(p))
        self.seed_at, self.seed_left = where.done(), left.done()

    # induction

    def common(self, a: int, b: int) -> int:
        if not self.cap:
            return 0
        x, y = self.text[a : a + self.cap], self.text[b : b + self.cap]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def seed_shared(self, a: int, b: int, known) -> np.ndarray:
        """Common prefixes of the seeds of ranks a to b, each with the one before."""
        out = np.zeros(b - a, np.int64)
        if not self.cap:
            return out.astype(np.uint8)
        first = 1 if a == 0 else 0
        x, y = np.asarray(self.seed_at[a + first - 1 : b - 1]), np.asarray(self.seed_at[a + first : b])
        if known is not None:
            out[first:] = known[a + first : b]
        at = out[first:]
        alive = np.flatnonzero(at < self.cap)
        last, offsets = len(self.text) - 1, np.arange(16)
        while len(alive):
            p, q = (x[alive] + at[alive])[:, None] + offsets, (y[alive] + at[alive])[:, None] + offsets
            same = self.text[np.minimum(p, last)] == self.text[np.minimum(q, last)]
            n = np.where(same.all(1), 16, same.argmin(1))
            at[alive] += n
            alive = alive[(n == 16) & (at[alive] < self.cap)]
        return np.minimum(out, self.cap).astype(np.uint8)

    def start(self) -> None:
        self.queue = Queue(self.disk, self.bits, self.tuple)
        self.since = np.zeros(self.top + 1 if self.cap else 0, np.uint8)
        self.seen = np.zeros(self.top + 1 if self.cap else 0, bool)

    def induce(self, c: int, p: np.ndarray, left: np.ndarray, shared: np.ndarray, falling: bool, equal: bool) -> None:
        """Queues the suffixes one symbol longer than those of a block that are of the type of the pass."""
        left = self.left.filled(p, left)
        before = self.left.first(left)
        wanted = (before <= c if equal else before < c) if falling else before >= c
        i = np.flatnonzero(wanted & (p > 0))
        d = before[i]
        order = np.argsort(d.astype(np.uint16) if self.top < 1 << 16 else d, kind="stable")
        i, d = i[order], d[order]
        self.queue.push(d, [p[i] - 1, self.left.rest(left[i]), self.carried(shared, i, d)])

    def carried(self, shared: np.ndarray, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """What an induced suffix shares with the one queued before it under its symbol: one more than the least value
        since that one's successor."""
        if not self.cap:
            return np.zeros(len(i), np.uint8)
        tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], _NEVER).astype(np.uint8)
        if not len(i):
            np.minimum(self.since, tail[0], out=self.since)
            return np.zeros(0, np.uint8)
        first = np.append(True, d[1:] != d[:-1])
        last = np.append(first[1:], True)
        low = np.where(first, 0, np.append(0, i[:-1] + 1))
        least = range_minima(shared, low, i)
        least = np.where(first, np.minimum(least, self.since[d]), least)
        out = np.where(first & ~self.seen[d], 0, np.minimum(least, self.cap - 1) + 1).astype(np.uint8)
        np.minimum(self.since, tail[0], out=self.since)
        self.since[d[last]] = tail[i[last] + 1]
        self.seen[d] = True
        return out

    def rise(self, known) -> Log:
        """All L suffixes, in order: (symbol, suffix, left, shared)."""
        self.start()
        out = Log(self.disk, *self.tuple)
        at, m, step = 0, len(self.seeds), self.disk.block
        ahead: list = []  # the seeds' next block: symbols, places, left, shared

        def load():
            nonlocal at
            if not (ahead and len(ahead[0])) and at < m:
                b = min(m, at + step)
                p = np.asarray(self.seed_at[at:b])
                ahead[:] = [self.text[p].astype(np.int64), p, np.asarray(self.seed_left[at:b]), self.seed_shared(at, b, known)]
                at = b
            return bool(ahead and len(ahead[0]))

        for c in range(self.top + 1):
            tail = None
            for _, p, left, shared in self.queue.of(c):
                out.append(np.full(len(p), c), p, left, shared)
                self.induce(c, p, left, shared, False, True)
                tail = int(p[-1])
            begun = False
            while load() and ahead[0][0] == c:
                n = int(np.searchsorted(ahead[0], c, "right"))
                _, p, left, shared = (x[:n] for x in ahead)
                ahead[:] = [x[n:] for x in ahead]
                if not begun:
                    shared = shared.copy()
                    shared[0] = 0 if tail is None else self.common(tail, int(p[0]))
                    begun = True
                self.induce(c, p, left, shared, False, True)
        return out

    def fall(self, larger: Log) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes but the last one, falling."""
        self.start()
        source, ahead = larger.backward(), []

        def load():
            if not (ahead and len(ahead[0])):
                ahead[:] = [x[::-1].astype(np.int64) if k < 2 else x[::-1] for k, x in enumerate(next(source, []))]
            return bool(ahead and len(ahead[0]))

        for c in range(self.top, 0, -1):
            tail = None
            for _, p, left, shared in self.queue.of(c):
                yield p, shared
                self.induce(c, p, left, shared, True, True)
                tail = int(p[-1])
            following = None  # what the L suffix last met shares with the next smaller one
            while load() and ahead[0][0] == c:
                same = ahead[0] == c
                n = len(same) if same.all() else int(same.argmin())
                _, p, left, rising = (x[:n] for x in ahead)
                ahead[:] = [x[n:] for x in ahead]
                if following is None:
                    following = 0 if tail is None else self.common(tail, int(p[0]))
                shared = np.append(following, rising[:-1]).astype(np.uint8)
                following = int(rising[-1])
                yield p, shared
                self.induce(c, p, left, shared, True, False)


def range_minima(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high]."""
    gap = high - low + 1
    level = np.frexp(gap.astype(np.float64))[1] - 1
    n, levels = len(v), int(level.max()) + 1
    table = np.full((levels, n), _NEVER, np.uint8)
    table[0] = v
    for k in range(1, levels):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, : n - half], table[k - 1, half:], out=table[k, : n - half])
    flat = table.ravel()
    row = level.astype(np.int64) * n
    return np.minimum(flat[row + low], flat[row + high + 1 - (1 << level.astype(np.int64))])
