"""A run-compressed index of byte strings: Burrows-Wheeler runs, samples at the runs' ends, streamed match lengths."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The dense rank of each value."""
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[:1] = False
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


def suffix_ranks(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rank of every suffix of every segment, by prefix doubling.

    A segment's end sorts before all bytes, an earlier segment's end before a later one's; so no two suffixes are
    equal.
    """
    n, ends = len(data), np.cumsum(lengths)
    segment = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    rest = np.repeat(ends, lengths) - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys, reach, places = np.zeros(n, np.uint64), 7, np.arange(n)
    for k in range(reach):
        keys = (keys << _U(8)) | np.where(rest > k, padded[k : k + n], _U(0))
    ranks = _ranks((keys << _U(8)) | np.minimum(rest, reach).astype(np.uint64))
    while n and int(ranks.max()) < n - 1:
        ahead = np.where(rest > reach, ranks[np.minimum(places + reach, n - 1)] + _U(len(lengths)), segment)
        ranks, reach = _ranks((ranks << _U(32)) | ahead), 2 * reach
    return ranks.astype(np.int64)


class RunIndex:
    """The run-compressed transform of some segments, and what is sampled where its runs begin.

    Of the sorted suffixes and the byte before each (a segment's own beginning counts as a byte of its own) only
    this is kept, all of it as long as the number of runs:

    * ``run_starts``, ``run_bytes``: the transform by runs; :meth:`lf` steps on them;
    * ``at``: the text position of the suffix at each run's beginning, in text order;
    * ``source``: the position sampled at the end of the run before, its neighbour in sorted order;
    * ``agree``: how many bytes the two have in common, compared once.

    Between two samples the neighbour moves along with the text and one byte of agreement goes at each step, since
    suffixes of one run share the byte before them.  So the samples stream the matching statistics of every
    position, and the neighbour's after a position is known as that position's before.
    """

    def __init__(self, segments: list[bytes]):
        lengths = np.array([len(s) for s in segments], np.int64)
        data = np.frombuffer(b"".join(segments), np.uint8)
        n = len(data)
        self.begins, self.ends, self.size = np.cumsum(lengths) - lengths, np.cumsum(lengths), n
        ranks = suffix_ranks(data, lengths)
        order = np.empty(n, np.int64)
        order[ranks] = np.arange(n)
        before = data[np.maximum(order - 1, 0)].astype(np.int64)
        full = np.flatnonzero(lengths)
        before[ranks[self.begins[full]]] = -1 - full
        self.run_starts = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if n else np.zeros(0, np.int64)
        self.run_bytes = before[self.run_starts]
        # by byte: the first rank of what begins with it, behind the segments that end with it
        self.firsts = np.append(0, np.cumsum(np.bincount(data, minlength=256)))[:256] + np.bincount(data[self.ends[full] - 1], minlength=256)
        heads = self.run_starts[self.run_starts > 0]
        at, source = order[heads], order[heads - 1]
        lowest = order[:1]  # nothing sorts before it
        by_text = np.argsort(np.append(at, lowest))
        self.at = np.append(at, lowest)[by_text]
        self.source = np.append(source, np.full(len(lowest), -1))[by_text]
        self.agree = self._compare(data, self.at, self.source)

    def lf(self, ranks: np.ndarray) -> np.ndarray:
        """The rank of the suffix that begins one byte earlier; -1 - segment at a segment's beginning."""
        run = np.searchsorted(self.run_starts, ranks, "right") - 1
        sizes = np.diff(np.append(self.run_starts, self.size))
        by_byte = np.lexsort((self.run_starts, self.run_bytes))
        sorted_bytes, upto = self.run_bytes[by_byte], np.cumsum(sizes[by_byte])
        low = np.searchsorted(sorted_bytes, self.run_bytes[run])
        place = np.empty(len(by_byte), np.int64)
        place[by_byte] = upto - sizes[by_byte]
        base = np.where(low > 0, upto[low - 1], 0)
        step = place[run] - base + ranks - self.run_starts[run]
        c = self.run_bytes[run]
        return np.where(c < 0, c, self.firsts[np.maximum(c, 0)] + step)

    def _compare(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b of the segments have in common; 0 where b is -1."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        x, y = a[live], b[live]
        end = lambda p: self.ends[np.searchsorted(self.ends, p, "right")]
        most, at, last, width = np.minimum(end(x) - x, end(y) - y), 0, len(data) - 1, 8
        while len(live):
            i = np.arange(at, at + width)
            same = (i < most[:, None]) & (data[np.minimum(x[:, None] + i, last)] == data[np.minimum(y[:, None] + i, last)])
            gained = np.where(same.all(1), width, same.argmin(1))
            out[live] += gained
            go = gained == width
            live, x, y, most = live[go], x[go], y[go], most[go]
            at, width = at + width, 32
        return out

    def matching_statistics(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes in common with the suffix that sorts before, its position or -1) of text positions, from the samples."""
        k = np.searchsorted(self.at, positions, "right") - 1
        moved = positions - self.at[k]
        length = np.maximum(self.agree[k] - moved, 0)
        return length, np.where(self.source[k] >= 0, self.source[k] + moved, -1)

    def repeated(self, size: int) -> list[list[tuple[int, int]]]:
        """For each segment the runs (first window, number of windows) of ``size`` bytes that start at two places.

        Each sample's stream marks the windows that it matches and those that it matches them with; nothing is
        done position by position.
        """
        until = np.append(self.at[1:], self.size) - self.at
        count = np.minimum(self.agree - size + 1, until)
        hit = count > 0
        starts = np.concatenate([self.at[hit], self.source[hit]])
        stops = starts + np.concatenate([count[hit], count[hit]])
        out: list[list[tuple[int, int]]] = [[] for _ in self.begins]
        if not len(starts):
            return out
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], np.maximum.accumulate(stops[order])
        owner = np.searchsorted(self.ends, starts, "right")
        new = np.append(True, (starts[1:] > stops[:-1]) | (owner[1:] != owner[:-1]))
        first = np.flatnonzero(new)
        lasts = np.append(first[1:], len(starts)) - 1
        for s, a, z in zip(owner[first], starts[first], stops[lasts], strict=True):
            out[s].append((int(a - self.begins[s]), int(z - a)))
        return out
