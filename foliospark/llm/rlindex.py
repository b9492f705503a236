"""Run-length index: a run-compressed Burrows-Wheeler transform of many short strings, and matching statistics.

Strings are put one after another in the order of their place in the corpus, each with its own end mark. What is kept
of the transform are its runs: first row, symbol, and the shift from a row to the row of the suffix one symbol longer.
At the two ends of every run the index samples, for the suffix one symbol longer, the place of its neighbour in suffix
order (above for the run's first row, below for its last) and how many symbols both share. The suffix array is dropped.

Strings are streamed through the runs from right to left, all at once. The state of a string is its row and, on either
side, a matching statistic: the place of the neighbour and the length of the common prefix. Inside a run both suffixes
take the same symbol, so the length grows by one and the place moves by one; at a run's end the sample replaces them.
Suffixes that share a prefix are neighbours, so the greater of both lengths is the longest match anywhere else, and
further places of the same match follow by going from neighbour to neighbour, which the samples allow from any place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SYMBOLS = 7  # symbols of 9 bits in the first sort key


class Side:
    """Neighbours above or below: at the run ends by run, and at the sampled places in order."""

    def __init__(self, place: np.ndarray, length: np.ndarray, own: np.ndarray, valid: np.ndarray, ends: np.ndarray, at_ends: np.ndarray) -> None:
        self.place, self.length = place, length
        at = np.concatenate([own[valid], ends])
        order = np.argsort(at)
        self.at = at[order]
        self.to = np.concatenate([place[valid], at_ends])[order]
        self.common = np.concatenate([length[valid], np.zeros(len(ends), np.int64)])[order]

    def next(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours' places and the common lengths, from the next sample to the right of each place."""
        e = np.searchsorted(self.at, place)
        back = self.at[e] - place
        return self.to[e] - back, self.common[e] + back


class RunLengthIndex:
    def __init__(self, data: np.ndarray, size: np.ndarray) -> None:
        """data: the strings one after another; size: their lengths."""
        m = len(size)
        self.size = size
        self.start = np.cumsum(size + 1) - (size + 1)
        n = int(size.sum()) + m
        text = np.zeros(n + SYMBOLS, np.uint64)
        ends = self.start + size
        inside = np.ones(n, bool)
        inside[ends] = False
        text[:n][inside] = data.astype(np.uint64) + np.uint64(1)
        left = np.repeat(ends, size + 1) - np.arange(n)  # symbols before the end mark
        rank, order = self._first(text, left, n)
        ranks, h = {SYMBOLS: rank}, SYMBOLS
        while h <= int(size.max(initial=0)) and int(rank.max(initial=0)) < n - 1:
            rank, order = self._double(rank, left, h)
            h *= 2
            ranks[h] = rank
        before = np.where(order > 0, text[order - 1], 0).astype(np.int64)
        self.run = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.last = np.append(self.run[1:], n) - 1
        self.symbol = before[self.run]
        count = self.last - self.run + 1
        by = np.argsort(self.symbol, kind="stable")
        to = np.empty(len(by), np.int64)
        to[by] = np.cumsum(count[by]) - count[by]
        self.shift = to - self.run
        rows = np.arange(m)  # end marks are the first rows, in order
        sides = []
        for row, step in ((self.run, -1), (self.last, 1)):
            longer, near = row + self.shift, row + self.shift + step
            valid = (self.symbol > 0) & (near >= 0) & (near < n)
            own = np.where(self.symbol > 0, order[row] - 1, 0)
            place = np.where(valid, order[np.clip(near, 0, n - 1)], 0)
            length = np.where(valid, self._common(own, place, ranks, text, left), 0)
            beside = rows + step
            sides.append(Side(place, length, own, self.symbol > 0, ends, np.where((beside >= 0) & (beside < n), order[np.clip(beside, 0, n - 1)], 0)))
        self.above, self.below = sides
        self.ends = [np.where((rows + s >= 0) & (rows + s < n), order[np.clip(rows + s, 0, n - 1)], 0) for s in (-1, 1)]

    @staticmethod
    def _first(text: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.zeros(n, np.uint64)
        for i in range(SYMBOLS):
            key = key << np.uint64(9) | np.where(left > i, text[i : i + n], np.uint64(0))
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < SYMBOLS)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank, order

    @staticmethod
    def _double(rank: np.ndarray, left: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(rank)
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:]
        key = rank << 32 | np.where(left >= h, second, 0)
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(new) - 1
        return out, order

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray, ranks: dict[int, np.ndarray], text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share; suffixes of equal rank at h share h of them."""
        n = len(left)
        out = np.zeros(len(a), np.int64)
        for h in sorted(ranks, reverse=True):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((x != y) & (ranks[h][x] == ranks[h][y]), h, 0)
        x, y = a + out, b + out
        going = np.ones(len(a), bool)
        for i in range(SYMBOLS):
            going &= (left[np.minimum(x, n - 1)] > i) & (left[np.minimum(y, n - 1)] > i) & (text[np.minimum(x + i, n - 1)] == text[np.minimum(y + i, n - 1)])
            out += going
        return out

    def stream(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For each count of symbols from the end: the strings of that length or more, and for the suffix that begins
        there the place and the length of the match above and of that below."""
        lane = np.arange(len(self.size))
        row = lane.copy()
        state = [self.ends[0], np.zeros(len(lane), np.int64), self.ends[1], np.zeros(len(lane), np.int64)]
        k = 0
        while True:
            more = self.size[lane] > k
            if not more.all():
                lane, row, state = lane[more], row[more], [x[more] for x in state]
            if not len(lane):
                return
            r = np.searchsorted(self.run, row, "right") - 1
            for i, side, edge in ((0, self.above, self.run), (2, self.below, self.last)):
                at = row == edge[r]
                state[i] = np.where(at, side.place[r], state[i] - 1)
                state[i + 1] = np.where(at, side.length[r], state[i + 1] + 1)
            row = row + self.shift[r]
            k += 1
            yield (lane, self.size[lane] - k, *state)

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """String and offset of every position from which `length` symbols start at an earlier place too."""
        strings, offsets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        unsettled = []
        for lane, offset, above, over, below, under in self.stream():
            up, down = over >= length, under >= length
            long = up | down
            if not long.any():
                continue
            own = self.start[lane] + offset
            early = up & (above < own) | down & (below < own)
            strings.append(lane[early])
            offsets.append(offset[early])
            for side, match, place in ((self.above, up, above), (self.below, down, below)):
                if (open_ := match & ~early).any():
                    unsettled.append((side, lane[open_], offset[open_], own[open_], place[open_]))
        done = []
        for side in (self.above, self.below):
            parts = [x[1:] for x in unsettled if x[0] is side]
            if not parts:
                continue
            lane, offset, own, place = (np.concatenate(x) for x in zip(*parts))
            while len(lane):  # from neighbour to neighbour, as long as the match lasts
                place, common = side.next(place)
                match = common >= length
                early = match & (place < own)
                done.append((lane[early], offset[early]))
                match &= ~early
                lane, offset, own, place = lane[match], offset[match], own[match], place[match]
        lane, offset = np.concatenate([*strings, *(x for x, _ in done)]), np.concatenate([*offsets, *(x for _, x in done)])
        both = np.unique(lane << 32 | offset)
        return both >> 32, both & 0xFFFFFFFF
