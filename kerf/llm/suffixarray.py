"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are of type S where smaller than the next one, else L; a leftmost S one
(LMS) follows an L. LMS substrings are sorted by inducing, named, and the string of
names is sorted by the same function where names repeat. From sorted LMS suffixes, L
suffixes are induced in ascending and S suffixes in descending order of buckets.

Buckets are handled in spans: within a span no suffix depends on another one of the
span, so one vector step places everything that the span induces. A bucket whose
suffixes depend on the bucket itself (runs of one symbol) is a span of its own that
is repeated until it brings nothing new.
"""

from __future__ import annotations

import numpy as np


def _place(sa: np.ndarray, at: np.ndarray, q: np.ndarray, symbol: np.ndarray, step: int) -> None:
    """Puts ``q``, in order, at the free ends of their buckets and moves the ends."""
    if not len(q):
        return
    order = np.argsort(symbol, kind="stable")
    q, symbol = q[order], symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    size = np.diff(np.concatenate([first, [len(q)]]))
    rank = np.arange(len(q)) - np.repeat(first, size)
    bucket = symbol[first]
    sa[np.repeat(at[bucket], size) + step * rank] = q
    at[bucket] += step * size


def _spans(limit: np.ndarray, descending: bool) -> list[tuple[int, int, bool]]:
    """Spans of buckets (first, last, depends on itself) in the order of handling.

    ``limit[c]`` is the latest bucket, in that order, that bucket c depends on.
    """
    out: list[tuple[int, int, bool]] = []
    k = len(limit)
    limits = limit.tolist()
    c = k - 1 if descending else 0
    while 0 <= c < k:
        if limits[c] == c:
            out.append((c, c, True))
            c += -1 if descending else 1
            continue
        first = c
        if descending:
            while c >= 0 and limits[c] > first:
                c -= 1
            out.append((c + 1, first, False))
        else:
            while c < k and limits[c] < first:
                c += 1
            out.append((first, c - 1, False))
    return out


class _Induced:
    def __init__(self, text: np.ndarray, k: int) -> None:
        n = len(text)
        self.text, self.n = text, n
        step = np.sign(text[1:].astype(np.int64) - text[:-1])
        # The type of a suffix is that of the next step that isn't level.
        place = np.where(step != 0, np.arange(n - 1), n - 1)
        place = np.minimum.accumulate(place[::-1])[::-1]
        self.is_s = np.concatenate([np.concatenate([step, [1]])[place] > 0, [True]])
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=k))])
        later = np.flatnonzero(~self.is_s[:-1])
        limit = np.full(k, -1)
        np.maximum.at(limit, text[later], text[later + 1])
        self.up = _spans(limit, False)
        earlier = np.flatnonzero(self.is_s[:-1])
        limit = np.full(k, k)
        np.minimum.at(limit, text[earlier], text[earlier + 1])
        self.down = _spans(limit, True)

    def sort(self, seeds: np.ndarray) -> np.ndarray:
        """The order of all suffixes induced by ``seeds``, LMS suffixes in order."""
        text, start, is_s = self.text, self.start, self.is_s
        sa = np.full(self.n, -1, np.int64)
        tail = start[1:] - 1
        _place(sa, tail, seeds[::-1], text[seeds[::-1]], -1)
        seeded = tail
        head = start[:-1].copy()
        for a, b, own in self.up:
            if own:
                done = start[a]
                while done < head[a]:
                    now, done = sa[done : head[a]], int(head[a])
                    self._up(sa, head, now)
                self._up(sa, head, sa[seeded[a] + 1 : start[a + 1]])
            else:
                self._up(sa, head, sa[start[a] : start[b + 1]])
        # Seeds make room for all S suffixes; the last suffix is induced by none.
        last = sa[0]
        keep = np.zeros(self.n, bool)
        keep[1:] = sa[1:] >= 0
        keep &= ~is_s[np.maximum(sa, 0)]
        sa[~keep] = -1
        tail = start[1:] - 1
        sa[0] = last
        tail[text[last]] -= 1
        for a, b, own in self.down:
            if own:
                done = int(start[a + 1])
                while tail[a] + 1 < done:
                    now, done = sa[tail[a] + 1 : done], int(tail[a]) + 1
                    self._down(sa, tail, now)
                self._down(sa, tail, sa[start[a] : head[a]])
            else:
                self._down(sa, tail, sa[start[a] : start[b + 1]])
        return sa

    def _up(self, sa: np.ndarray, head: np.ndarray, now: np.ndarray) -> None:
        q = now[now > 0] - 1
        q = q[~self.is_s[q]]
        _place(sa, head, q, self.text[q], 1)

    def _down(self, sa: np.ndarray, tail: np.ndarray, now: np.ndarray) -> None:
        now = now[::-1]
        q = now[now > 0] - 1
        q = q[self.is_s[q]]
        _place(sa, tail, q, self.text[q], -1)

    def names(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of LMS substrings in the order of the text, from their sorted ``order``."""
        text, lms = self.text, self.lms
        size = np.diff(np.concatenate([lms, [self.n]]))
        of = np.zeros(self.n, np.int64)
        of[lms] = np.arange(len(lms))
        rank = of[order]
        a, b = order[1:], order[:-1]
        same = size[rank[1:]] == size[rank[:-1]]
        live = np.flatnonzero(same)
        k = 0
        length = size[rank[1:]]
        while len(live):
            # The substring goes up to and with the next LMS; the very last one is alone.
            live = live[length[live] >= k]
            ok = text[np.minimum(a[live] + k, self.n - 1)] == text[np.minimum(b[live] + k, self.n - 1)]
            same[live[~ok]] = False
            live = live[ok]
            k += 1
        name = np.zeros(len(lms), np.int64)
        name[rank] = np.concatenate([[0], np.cumsum(~same)])
        return name, int((~same).sum()) + 1


def suffix_array(text: np.ndarray, k: int | None = None) -> np.ndarray:
    """The suffix array of ``text``, whose last symbol, 0, is the least and alone."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    k = int(text.max()) + 1 if k is None else k
    # Short symbols are sorted by radix.
    text = text.astype(np.uint16 if k <= 1 << 16 else np.int32)
    work = _Induced(text, k)
    lms = work.lms
    seeds = lms[np.argsort(text[lms], kind="stable")]
    sa = work.sort(seeds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    name, count = work.names(order)
    if count < len(lms):
        order = lms[suffix_array(name, count)]
    return work.sort(order)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``text``, symbols that its suffix shares with the one before it in ``sa``.

    Values come in the order of the text. Where the symbols before a place and before its
    predecessor are equal, the pair stands one place to the left as well, and the value is
    one less than there: it is carried on. Only at the other places are symbols compared,
    four at a time; their values sum to n log n at most, however repetitive the text.
    """
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0) + 1
    fresh[inner] = text[inner - 1] != text[before[inner] - 1]
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    four = padded[: n + 4].copy()
    for j in range(1, 4):
        four |= padded[j : n + 4 + j] << np.uint64(16 * j)
    value = np.zeros(n, np.int64)
    live = np.flatnonzero(fresh & (before >= 0))
    k = 0
    while len(live):
        apart = four[live + k] ^ four[before[live] + k]
        ends = apart != 0
        last = apart[ends]
        same = sum(((last & np.uint64((1 << 16 * j) - 1)) == 0).astype(np.int64) for j in (1, 2, 3))
        value[live[ends]] = k + same
        live = live[~ends]
        k += 4
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(fresh, place, 0))
    return value[start] - (place - start)
