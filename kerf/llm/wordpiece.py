"""Counts of greedy longest-match word pieces, in time linear in the text.

The vocabulary is a trie. Each node knows where matching goes on when the next
byte has no edge (its failure link) and how many pieces are complete by then (its
popped count). Both are computed once, so a word is counted by walking its bytes;
no piece is ever built.

A word is a run of characters other than blank and \\t to \\r, matched with one
blank before it, as the vocabulary's word-initial entries have it. Every byte is an
entry, so no word is unknown. Null text counts as empty and has 0 words and tokens.
Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from kerf.llm.bpe import byte_names, default_vocabulary
from kerf.llm.common import id_and_text, map_rows


class PieceCounter:
    """Longest-match automaton over a set of byte strings that has every byte used."""

    def __init__(self, entries: list[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        is_entry = [False]
        for entry in entries:
            at = 0
            for byte in entry:
                to = edges[at].get(byte)
                if to is None:
                    to = edges[at][byte] = len(edges)
                    edges.append({})
                    is_entry.append(False)
                at = to
            is_entry[at] = bool(entry)
        fail, popped = [-1] * len(edges), [0] * len(edges)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for byte, to in edges[at].items():
                todo.append(to)
                if is_entry[to]:
                    fail[to], popped[to] = 0, 1
                    continue
                back, n = fail[at], popped[at]
                while back >= 0 and byte not in edges[back]:
                    n += popped[back]
                    back = fail[back]
                if back >= 0:
                    fail[to], popped[to] = edges[back][byte], n
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; -1 if some part of it is no entry."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for byte in word:
            to = edges[at].get(byte)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = edges[at].get(byte)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class _WordCounts(dict):
    """Counts of words seen; emptied at a limit, so its size is bounded."""

    LIMIT = 400_000

    def __init__(self, counter: PieceCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self[word] = self.counter.count(b" " + word)
        return n


@lru_cache(maxsize=2)
def load(path: str) -> _WordCounts:
    names = byte_names()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    entries = [bytes(names[c] for c in t) for t in vocab if all(c in names for c in t)]
    return _WordCounts(PieceCounter(entries))


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, longest_word_tokens`` of each row; no shuffle."""
    path = vocabulary or default_vocabulary()

    def make():  # noqa: ANN202
        of_word = load(path).__getitem__

        def step(cols: dict[str, list]) -> dict[str, list]:
            counts = [list(map(of_word, (t or "").encode("utf-8", "surrogatepass").split())) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_words": list(map(len, counts)),
                "n_tokens": list(map(sum, counts)),
                "longest_word_tokens": [max(c, default=0) for c in counts],
            }

        return step

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")
