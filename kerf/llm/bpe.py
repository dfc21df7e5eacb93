"""Byte-pair encoding and decoding of whole texts.

Encoding is the backtracking algorithm: for a pre-token, an Aho-Corasick automaton
finds the longest vocabulary entry at each position; a candidate is accepted if it
is compatible with the token before it, that is, if merging the two byte strings
together would leave exactly these two tokens. Otherwise a shorter entry is tried,
and where none is left the last token is taken back. The position is then marked,
so no position is entered twice and time is linear.

Decoding gathers bytes from one table of all tokens' bytes through an offset table.

Null text counts as empty; empty text has no tokens. Repeated rows give repeated
results. Texts are never cut. Extra input columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import id_and_text, map_batches
from kerf.llm.pieces import PieceCoder, gather

#: The pre-tokenizer pattern of byte-level vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    #: Entries kept of the memo of pair compatibility.
    PAIRS = 250_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Ranks: the 256 bytes first, then merges in order. A rank is the order in which a token can arise.
        text = [c for c in sorted(names, key=names.get)]
        rank = {c: i for i, c in enumerate(text)}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(text)
            text.append(a + b)
            rank.setdefault(a + b, r)
            self.split.append((rank[a], rank[b]))
            self.joined.setdefault((rank[a], rank[b]), r)
        self.ids = [vocab[t] for t in text]
        as_latin = ["".join(chr(names[c]) for c in t) for t in text]
        self.length = [len(t) for t in as_latin]
        known = {t: r for r, t in reversed(list(enumerate(as_latin)))}
        self.automaton = ahocorasick.Automaton()
        for t, r in known.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        # The longest proper prefix of each token that is a token itself.
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in as_latin]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.fits: dict[int, bool] = {}
        # Decoding: all tokens' bytes in one table, with offsets by id.
        by_id = {i: bytes(map(ord, t)) for i, t in zip(self.ids, as_latin)}
        by_id |= {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        pieces = [by_id.get(i, b"") for i in range(size)]
        self.sizes = np.fromiter(map(len, pieces), np.int64, size)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart where they stand side by side.

        Undo the merges of both, latest first. If at some time the two facing parts
        have a merge that comes before the ones that were undone, it would have
        happened first and the pair could not have come out.
        """
        key = a * len(self.split) + b
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, fits, joined, split = 1 << 60, True, self.joined, self.split
        while True:
            merged = joined.get((a, b))
            if merged is not None and merged < limit:
                fits = False
                break
            if a < 256 and b < 256:
                break
            # Of two equals the right one is undone: its merge happens later in a left-to-right pass.
            if a > b:
                limit, a = a, split[a][1]
            else:
                limit, b = b + 1, split[b][0]
        if len(self.fits) >= self.PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_pre_token(self, raw: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        n = len(raw)
        longest = [-1] * n
        length = self.length
        for end, r in self.automaton.iter(raw.decode("latin-1")):
            longest[end - length[r] + 1] = r  # a later end is a longer match
        if n and length[longest[0]] == n:
            return [longest[0]]
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0] if n else -1
        while token >= 0:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + length[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = self.shorter[token]
            else:
                open_at[at] = 0
                tokens.pop()
                at -= length[last]
                token = last
        return tokens

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.special_re.split(text) if self.special_re else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            else:
                for pre in self.pre_token.findall(part):
                    out.extend(map(self.ids.__getitem__, self.encode_pre_token(pre.encode("utf-8", "surrogatepass"))))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.offsets[ids], self.sizes[ids]).tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Bpe, PieceCoder]:
    """One coder a Python worker, kept between tasks."""
    coder = Bpe(path)

    def many(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes: list[int] = []
        sizes = []
        for piece in pieces:
            ids = coder.encode(piece.decode("utf-8", "surrogatepass"))
            codes += ids
            sizes.append(len(ids))
        return np.array(codes, np.uint32), np.array(sizes, np.int64)

    return coder, PieceCoder(many)


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each row of ``docs``.

    No shuffle: each partition is encoded where it is read.
    """
    path = vocabulary or default_vocabulary()

    def make():  # noqa: ANN202
        coder, pieces = load(path)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, bounds = pieces(batch.column("text"))
            raw = coder.decode(ids)
            ends = np.concatenate([[0], np.cumsum(coder.sizes[ids])])[bounds]
            decoded = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            try:
                decoded.validate(full=True)
            except pa.ArrowInvalid:
                # Ids that don't end where characters do, which no text of valid characters has.
                decoded = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.large_string())
            return [batch.column("doc_id"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids.view(np.int32)), decoded]

        return step

    return map_batches(id_and_text(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token counts and hashes of ids and decoded texts."""
    return bpe_round_trip(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
