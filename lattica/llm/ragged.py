"""Rows of numbers of different lengths in flat arrays, and a memory of what chunks of text become."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Characters of text that are worked on at once in a task; a longer text comes alone.
AT_ONCE = 4 << 20
#: Chunks that a task remembers, and their characters; when full, it starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 32 << 20


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Ragged:
    """Grows by rows; take() gives many rows at once, as their numbers and their lengths."""

    def __init__(self, kind: str):
        self.values, self.used = np.zeros(1 << 12, kind), 0
        self.starts, self.lengths, self.n = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        k, m = len(lengths), len(values)
        while self.used + m > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + k > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.values[self.used : self.used + m] = values
        self.starts[self.n : self.n + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + k] = lengths
        self.used, self.n = self.used + m, self.n + k

    def only(self, rows: np.ndarray) -> Ragged:
        out = Ragged(self.values.dtype.str)
        out.extend(*self.take(rows))
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        return self.values[runs(self.starts[rows], lengths)], lengths


class Remembered:
    """The row of each chunk in some Ragged tables, which learn(chunks) extends by a row for each and keep(rows) cuts down to
    these rows. When it is full, chunks stay that were asked for again since they came, half of what fits at most, those
    that have stayed longest first."""

    def __init__(self, learn: Callable[[list[str]], None], keep: Callable[[np.ndarray], None], most: int = REMEMBERED, chars: int = REMEMBERED_CHARS):
        self.learn, self.keep, self.most, self.chars = learn, keep, most, chars
        self.rows: dict[str, int] = {}
        self.again = np.zeros(1 << 10, bool)
        self.held = 0

    def of(self, chunks: list[str]) -> np.ndarray:
        """Rows of distinct chunks. What they become is computed for the new ones alone."""
        known = self.rows
        new = [c for c in chunks if c not in known]
        size = sum(map(len, new))
        if known and (len(known) + len(new) > self.most or self.held + size > self.chars):
            self.cut()
            known = self.rows
            new = [c for c in chunks if c not in known]
            size = sum(map(len, new))
        before = len(known)
        if new:
            self.learn(new)
            known.update(zip(new, range(before, before + len(new))))
            self.held += size
            while len(known) > len(self.again):
                self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        rows = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        self.again[rows[rows < before]] = True
        return rows

    def cut(self) -> None:
        stays = np.flatnonzero(self.again[: len(self.rows)])
        stays = stays[: self.most // 2]
        chunks = list(self.rows)
        self.rows = {chunks[k]: n for n, k in enumerate(stays.tolist())}
        self.held = sum(map(len, self.rows))
        if 2 * self.held > self.chars:
            self.rows, self.held, stays = {}, 0, stays[:0]
        self.again[:] = False
        self.keep(stays)


def parts(sizes: Iterable[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so much together; a larger row is a range of its own."""
    begin = total = end = 0
    for size in sizes:
        if total and total + size > most:
            yield begin, end
            begin, total = end, 0
        total, end = total + size, end + 1
    if begin < end:
        yield begin, end
