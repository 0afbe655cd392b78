"""A run-length index of short byte strings: a run-compressed Burrows-Wheeler transform with sampled run ends.

Other strings are streamed through it from their ends. What is kept of the transform are its runs: where each starts,
where its first suffix moves to when the run's byte is put before it, and the text places of its first and last suffix.
A string's match moves along while its next byte is the run's; otherwise it jumps to the end of the next run of that
byte, up or down, whichever has more in common with the match so far. Each place of the string so gets a place in the
text with the longest match (a matching statistic), which is then compared byte by byte.
"""

from __future__ import annotations

import numpy as np


def suffix_words(text: np.ndarray, left: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The 8 bytes from place `at` + 8 * k as an integer, zeros after the string's end; left: bytes from each place to the end."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8 * k, 8 * k + 8):
        here = np.where(left[at] > j, text[np.minimum(at + j, len(text) - 1)], 0)
        out = (out << np.uint64(8)) | here.astype(np.uint64)
    return out


def eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as an integer; zeros follow the last byte."""
    out = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        out[:-step] = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out


class RunIndex:
    """The suffixes of strings, each string ending in a terminator; equal suffixes stand in the strings' order.

    `depth` is the length that a match must have. Where the suffixes of each `depth` bytes start in the order, the least
    weight among their strings is kept.
    """

    def __init__(self, strings: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int):
        """strings: the bytes of all strings, end to end (each below 255); lengths and weights: of each string."""
        n = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        self.text = text = np.zeros(int(ends[-1]) + 1, np.uint8)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = strings + 1  # the terminator is 0
        owner = np.repeat(np.arange(n), lengths + 1)
        left = ends[owner] - np.arange(len(text)) + 1
        order, common = self._suffix_order(text, left, depth)
        before = np.where(order == (ends[owner] - lengths[owner])[order], 0, text[order - 1]).astype(np.int64)
        start = np.flatnonzero(np.diff(before, prepend=-1))
        size = np.diff(np.append(start, len(before)))
        self.start, self.end, self.head = start, start + size - 1, before[start]
        self.first_at, self.last_at = order[start], order[self.end]
        by_char = np.argsort(self.head, kind="stable")
        self.to = np.empty(len(start), np.int64)
        self.to[by_char] = np.cumsum(size[by_char]) - size[by_char]
        self.by_char, self.keys = by_char, self.head[by_char] * (len(start) + 1) + by_char
        self.turn = self._turns(common)
        deep = left[order] > depth  # the terminator is no part of a match
        self.interval = np.flatnonzero(deep & (common < depth))
        heavy = np.where(deep, weights[owner[order]], np.iinfo(np.int64).max)
        self.least = np.minimum.reduceat(heavy, self.interval) if len(self.interval) else np.zeros(0, np.int64)
        self.depth = depth

    @staticmethod
    def _suffix_order(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and how many bytes each has in common with the one before it, `depth` at most."""
        order = np.arange(len(text))
        rank = np.zeros(len(text), np.int64)  # of the row: where its group of equals starts
        open_rows, common = np.arange(len(text)), np.full(len(text), depth, np.int64)
        common[0] = 0
        k = 0
        while len(open_rows):
            at = order[open_rows]
            word = suffix_words(text, left, at, k)
            key = np.lexsort((word, rank[open_rows]))
            order[open_rows] = at[key]
            word, group = word[key], rank[open_rows]
            new = np.ones(len(key), bool)
            new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
            differ = word[1:] ^ word[:-1]
            # bytes that agree with the row before, where that is in the same group
            agree = 8 * k + sum((differ >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 8)) + (differ == 0)
            cut = np.flatnonzero(new[1:] & (group[1:] == group[:-1])) + 1
            common[open_rows[cut]] = np.minimum(agree[cut - 1], depth)
            start = np.maximum.accumulate(np.where(new, open_rows, 0))
            rank[open_rows] = start
            ends = np.append(new[1:], True)
            going = ~(new & ends) & (left[order[open_rows]] > 8 * (k + 1))  # the others differ, or have ended
            open_rows = open_rows[going]
            k += 1
        bytes_left = left[order] - 1  # without the terminator
        common[1:] = np.minimum(common[1:], np.minimum(bytes_left[1:], bytes_left[:-1]))
        return order, common

    def _turns(self, common: np.ndarray) -> np.ndarray:
        """For each run but the first of its byte, in order of byte and run: the row from which on the way to it is down.

        That is where the least is in common between the last run of the byte before it and this one.
        """
        packed = (common << 40) | np.arange(len(common))
        table = [np.minimum.reduceat(packed, self.start)]  # table[j][i]: the least of the 2**j runs from run i
        while 1 << len(table) <= len(self.start):
            step = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        a, b = self.by_char[:-1] + 1, self.by_char[1:]
        same = self.head[self.by_char[1:]] == self.head[self.by_char[:-1]]
        found = packed[self.start[b]]
        between = np.where(same, b - a, 0)
        for j, level in enumerate(table):
            here = np.flatnonzero((between >> j) > 0)
            here = here[between[here] < 2 << j]
            found[here] = np.minimum(found[here], np.minimum(level[a[here]], level[b[here] - (1 << j)]))
        return np.append(0, found & ((1 << 40) - 1))

    def matched(self, strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each string and each place where `depth` bytes start, in order: the least weight of an indexed string that
        has them, or the largest integer. All strings are streamed at once, from their ends."""
        counts = np.maximum(lengths - self.depth + 1, 0)
        begin, base = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
        rows, spots = np.zeros(int(counts.sum()), np.int64), np.full(int(counts.sum()), -1)
        symbols = strings.astype(np.int64) + 1
        runs = len(self.start)
        row, at = np.zeros(len(lengths), np.int64), np.full(len(lengths), -1)
        active = np.arange(len(lengths))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = active[lengths[active] >= step]
            symbol = symbols[begin[active] + lengths[active] - step]
            here, spot = row[active], at[active]
            run = np.searchsorted(self.start, here, "right") - 1
            off = np.flatnonzero((self.head[run] != symbol) | (spot < 0))
            if len(off):
                c = symbol[off]
                down = np.searchsorted(self.keys, c * (runs + 1) + run[off])
                has_down = (down < runs) & (self.keys[np.minimum(down, runs - 1)] // (runs + 1) == c)
                has_up = (down > 0) & (self.keys[np.maximum(down - 1, 0)] // (runs + 1) == c)
                up = has_up & (~has_down | (here[off] < self.turn[np.minimum(down, runs - 1)]))
                next_run = self.by_char[np.clip(np.where(up, down - 1, down), 0, runs - 1)]
                run[off] = next_run
                here[off] = np.where(up, self.end[next_run], self.start[next_run])
                spot[off] = np.where(has_up | has_down, np.where(up, self.last_at[next_run], self.first_at[next_run]), -1)
            here = np.where(spot >= 0, self.to[run] + here - self.start[run], 0)
            spot = np.where(spot >= 0, spot - 1, -1)
            row[active], at[active] = here, spot
            if step >= self.depth:
                to = base[active] + lengths[active] - step
                rows[to], spots[to] = here, spot
        place = np.repeat(begin - base, counts) + np.arange(len(rows))
        good = np.flatnonzero((spots >= 0) & (spots + self.depth <= len(self.text)))
        mine, theirs = eights((strings + 1).astype(np.uint8)), eights(self.text)
        for k in [*range(0, self.depth - 7, 8), max(0, self.depth - 8)]:
            if self.depth < 8:
                shift = np.uint64(8 * (8 - self.depth))
                good = good[mine[place[good]] >> shift == theirs[spots[good]] >> shift]
            else:
                good = good[mine[place[good] + k] == theirs[spots[good] + k]]
        out = np.full(len(rows), np.iinfo(np.int64).max)
        out[good] = self.least[np.searchsorted(self.interval, rows[good], "right") - 1]
        return out
