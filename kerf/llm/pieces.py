"""Cuts texts into pieces that a byte-level pre-tokenizer handles independently.

A pre-token of these vocabularies never runs from a non-space character into white
space. So a text may be cut before each ASCII white space that follows a non-space
character, and each piece (white space, then non-space) encoded by itself. Cutting less
is always right: texts aren't cut after other white space of Unicode.

All of a batch is cut at once, on the bytes of its Arrow column. Pieces are looked up in
tables of bounded size, so Python sees a piece only when it is new, and the codes of all
texts are gathered by one indexed read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of ASCII, as regular expression engines define it.
ASCII_WHITE = b"\t\n\x0b\x0c\r "
_WHITE = np.zeros(256, bool)
_WHITE[list(ASCII_WHITE)] = True

#: Codes of a list of pieces, one after the other, and how many each piece has.
EncodeMany = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def text_bytes(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The UTF-8 bytes of a column of strings and the n + 1 bounds of its texts; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (data or pa.py_buffer(b"")).slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, ascending; each text that isn't empty begins one."""
    white = _WHITE[data]
    mark = np.zeros(len(data), bool)
    mark[1:] = white[1:] & ~white[:-1]
    # Of the cuts after a character beyond ASCII, those after white space go: C2 85, C2 A0, E1 9A 80, E2 80 80-8A, E2 80 A8/A9/AF, E2 81 9F, E3 80 80.
    at = np.flatnonzero(mark)
    at = at[(data[at - 1] >= 0x80) & (at >= 2)]
    last, one, two = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
    space = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
    space |= (two == 0xE1) & (one == 0x9A) & (last == 0x80)
    space |= (two == 0xE2) & (one == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    space |= (two == 0xE2) & (one == 0x81) & (last == 0x9F)
    space |= (two == 0xE3) & (one == 0x80) & (last == 0x80)
    mark[at[space]] = False
    mark[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(mark)


#: Items that are gathered at a time, which bounds what the places of each take.
GATHERED = 1 << 18


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[a : a + n]`` for each of ``start`` and ``size``, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, flat.dtype)
    shift = start - ends + size
    stops = np.unique(np.minimum(np.searchsorted(ends, np.arange(GATHERED, total + GATHERED, GATHERED)) + 1, len(ends))).tolist()
    a = done = 0
    for b in stops:
        to = int(ends[b - 1])
        out[done:to] = flat[np.repeat(shift[a:b], size[a:b]) + np.arange(done, to)]
        a, done = b, to
    return out


class _Table:
    """Codes of pieces, one after the other in an array that grows. Pieces stay in Arrow memory."""

    def __init__(self) -> None:
        self.pieces = pa.array([], pa.large_binary())
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.codes = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece, -1 where it isn't known."""
        return pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy()

    def add(self, pieces: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.codes[self.used : self.used + len(codes)] = codes
        self.used += len(codes)


class PieceCoder:
    """Codes of whole texts, through tables of the codes of pieces.

    There are two generations of tables. Where the young one has ``limit`` pieces it
    becomes the old one, and the old one is dropped; what is still in use moves to the
    young one again. Only a batch's own pieces can exceed the bound.
    """

    def __init__(self, encode_many: EncodeMany, limit: int = 250_000) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.young, self.old = _Table(), _Table()

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of the pieces in the young table, where all are afterwards."""
        if len(self.young.pieces) > self.limit:
            self.old, self.young = self.young, _Table()
        young = self.young
        number = young.find(pieces)
        new = np.flatnonzero(number < 0)
        if len(new):
            unknown = pieces.take(pa.array(new))
            missing, first = unknown.unique(), len(young.pieces)
            order = pc.index_in(unknown, value_set=missing).to_numpy()
            again = self.old.find(missing) if len(self.old.pieces) else np.full(len(missing), -1)
            back, rest = np.flatnonzero(again >= 0), np.flatnonzero(again < 0)
            place = np.zeros(len(missing), np.int64)
            place[back], place[rest] = np.arange(len(back)), len(back) + np.arange(len(rest))
            if len(back):
                sizes = self.old.size[again[back]]
                young.add(missing.take(pa.array(back)), gather(self.old.codes, self.old.start[again[back]], sizes), sizes)
            if len(rest):
                asked = missing.take(pa.array(rest))
                raw, bounds = asked.buffers()[2].to_pybytes(), np.frombuffer(asked.buffers()[1], np.int64)[: len(asked) + 1].tolist()
                young.add(asked, *self.encode_many([raw[a:b] for a, b in zip(bounds, bounds[1:])]))
            number = number.astype(np.int64)
            number[new] = first + place[order]
        return number

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one after the other, and the n + 1 bounds of the texts' codes."""
        buffer, bounds = text_bytes(texts)
        data = np.frombuffer(buffer, np.uint8)
        at = cuts(data, bounds)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        offsets = np.concatenate([at, [len(data)]]).astype(np.int64)
        number = self._numbers(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), buffer]))
        size = self.young.size[number]
        codes = gather(self.young.codes, self.young.start[number], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        return codes, ends[np.searchsorted(at, bounds)]
