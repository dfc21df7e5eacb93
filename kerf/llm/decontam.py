"""Finds passages of test items in documents with an Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z to lower case, everything outside 0-9, a-z and
non-ASCII to white space; words are what is left. A window is 10 consecutive words of an
item, or a whole item of fewer. The automaton holds runs of six words of each item, so
chosen that one lies in each window: of the next five the one that the fewest items have,
the last of these, so that it is every fifth where all are as rare. So it has about as
many nodes as the items have bytes, where whole windows would have sixty times as many,
and phrases that many items begin with aren't searched where a rarer one is near. One
pass over a document finds all runs; where one occurs, the words around it are compared
with the item's, and what agrees over a window or more is hit. A run that more than
``MANY`` places of items have is looked up by the windows around it instead, so its cost
doesn't follow their number. Only then are word positions mapped back to code points of
the original text.

Documents are read once, whatever the benchmark's size, and no text is shuffled. Items lie
in shared storage; a Python worker builds the automaton once and keeps it between tasks.
Beyond ``block_chars`` characters of items there are several automata, of which a worker
holds one at a time: it takes them one after the other over each ``SPOOL`` bytes of
documents. So neither memory nor anything sent around grows with the benchmark.

Null or wordless documents have no words and are clean; null or wordless items have
no windows. Items with equal texts are all reported. Repeated document rows give
repeated results. A null item id counts for hits but isn't listed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import filter_rows, id_and_text, map_rows, shared_dir

WINDOW = 10
#: Words from the start of one run that the automaton holds to the next, at most.
STRIDE = 5
#: Places of items that are compared one by one where a run occurs.
MANY = 8
#: Characters of items in one automaton.
BLOCK_CHARS = 8_000_000
#: Bytes of documents that are held where several automata take turns.
SPOOL = 64 << 20
_SPACE = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
SCHEMA = "doc_id long, n_words long, hit_words array<int>, spans array<struct<start:int,end:int>>, items array<long>"


def normalised(text: str) -> bytes:
    """Lower-cased text of the same length in bytes, with a blank for each non-word byte."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACE)


class Matcher:
    """Finds where words agree with a window of any of the items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, stride: int = STRIDE) -> None:
        stride = min(stride, window)
        self.window = window
        same: dict[bytes, bytes] = {}
        self.items = [(i, [same.setdefault(w, w) for w in normalised(t or "").split()]) for i, t in items]
        size = window - stride + 1
        run_at = lambda words, at: b" %s " % b" ".join(words[at : at + min(size, len(words))])
        often: Counter[bytes] = Counter()
        for _, words in self.items:
            if len(words) >= window:
                often.update({run_at(words, at) for at in range(len(words) - size + 1)})
        runs: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            for at in self._chosen(words, stride, lambda at, words=words: often[run_at(words, at)]):
                runs.setdefault(run_at(words, at), []).append((k, at))
        self.places = list(runs.values())
        #: Windows around runs that many places have, with their items.
        self.windows: dict[bytes, set[int]] = {}
        self.hot: set[int] = set()
        for number, places in enumerate(self.places):
            long = [(k, at) for k, at in places if len(self.items[k][1]) >= window]
            if len(long) <= MANY:
                continue
            for k, at in long:
                words = self.items[k][1]
                for a in range(max(0, at + size - window), min(at, len(words) - window) + 1):
                    self.windows.setdefault(b" ".join(words[a : a + window]), set()).add(k)
            self.hot.add(number)
            self.places[number] = [(k, at) for k, at in places if len(self.items[k][1]) < window]
        self.automaton = None
        if runs:
            self.automaton = ahocorasick.Automaton()
            for number, run in enumerate(runs):
                self.automaton.add_word(run.decode("latin-1"), (number, run.count(b" ") - 1))
            self.automaton.make_automaton()

    def _chosen(self, words: list[bytes], stride: int, often: Callable[[int], int]) -> Iterator[int]:
        """Where runs begin of which each window has one, by how often a run occurs in the benchmark."""
        if len(words) < self.window:
            yield from range(min(len(words), 1))
            return
        last, ends = -1, len(words) - self.window + stride
        while last + stride < ends:
            last = min(range(last + 1, last + stride + 1), key=lambda at: (often(at), -at))
            yield last

    def find(self, words: list[bytes], joined: bytes, mark: np.ndarray, found: set) -> None:
        """Marks the words that are hit: +1 in ``mark`` where a run of them begins, -1 where it ends."""
        if self.automaton is None:
            return
        hits = list(self.automaton.iter(joined.decode("latin-1")))
        if not hits:
            return
        # A run's last blank is the one after its last word: count blanks up to there.
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        last = np.searchsorted(blanks, [end for end, _ in hits]).tolist()
        total = len(words)
        done: dict[tuple[int | None, int], int] = {}
        for end, (_, (number, size)) in zip(last, hits):
            start = end - size
            if number in self.hot:
                for a in range(max(0, end - self.window), min(start, total - self.window) + 1):
                    items = self.windows.get(b" ".join(words[a : a + self.window])) if (None, a) not in done else None
                    done[None, a] = 1
                    if items:
                        mark[a] += 1
                        mark[a + self.window] -= 1
                        found.update(self.items[k][0] for k in items)
            for k, at in self.places[number]:
                # What agreed with the item at this distance is known up to there.
                if done.get((k, start - at), -1) >= end:
                    continue
                item, own = self.items[k]
                a, b, c, d = start, at, end, at + size
                while a and b and words[a - 1] == own[b - 1]:
                    a, b = a - 1, b - 1
                while c < total and d < len(own) and words[c] == own[d]:
                    c, d = c + 1, d + 1
                done[k, start - at] = c
                if c - a >= min(self.window, len(own)):
                    mark[a] += 1
                    mark[c] -= 1
                    found.add(item)


def scan(matchers: Iterator[Matcher], texts: list[str | None]) -> list[tuple[int, list[int], list[tuple[int, int]], list[int]]]:
    """Words in each text, numbers of hit words, spans of code points, item ids."""
    plain = [normalised(t or "") for t in texts]
    words = [p.split() for p in plain]
    joined = [b" %s " % b" ".join(w) for w in words]
    marks: list[np.ndarray | None] = [None] * len(texts)
    found: list[set] = [set() for _ in texts]
    for matcher in matchers:
        for k, w in enumerate(words):
            if w:
                mark = np.zeros(len(w) + 1, np.int64) if marks[k] is None else marks[k]
                matcher.find(w, joined[k], mark, found[k])
                marks[k] = mark if mark.any() else None
    return [(len(w), *_mapped(p, m, f)) if m is not None else (len(w), [], [], []) for p, w, m, f in zip(plain, words, marks, found)]


def _mapped(plain: bytes, mark: np.ndarray, found: set) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    is_hit = np.cumsum(mark)[:-1] > 0
    raw = np.frombuffer(plain, np.uint8)
    in_word = np.concatenate([[0], raw != 0x20, [0]]).astype(np.int8)
    edge = np.diff(in_word)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    begins, ends = chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]
    runs = np.diff(np.concatenate([[0], is_hit, [0]]).astype(np.int8))
    spans = list(zip(begins[np.flatnonzero(runs == 1)].tolist(), ends[np.flatnonzero(runs == -1) - 1].tolist()))
    return np.flatnonzero(is_hit).tolist(), spans, sorted(i for i in found if i is not None)


@lru_cache(maxsize=1)
def _matcher(folder: str, block: int, window: int) -> Matcher:
    """The automaton of a block of items; a worker holds one."""
    fs, root = pafs.FileSystem.from_uri(folder)
    items: list[tuple[int | None, str | None]] = []
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/block={block}", allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                got = pq.read_table(source, columns=["item_id", "text"])
            items += zip(got.column("item_id").to_pylist(), got.column("text").to_pylist())
    return Matcher(items, window)


class Items:
    """Test items in shared storage, in blocks of about ``block_chars`` characters at most."""

    def __init__(self, benchmark: DataFrame, window: int, block_chars: int, id_col: str = "item_id", text_col: str = "text") -> None:
        items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
        total = items.agg(F.sum(F.length("text"))).first()[0] or 0
        n = -(-2 * total // block_chars) if total > block_chars else 1
        self.folder, self.blocks, self.window = shared_dir(benchmark.sparkSession, "items"), n, window
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        dealt.repartition(min(n, 1000), "block").write.partitionBy("block").parquet(self.folder)

    @property
    def size(self) -> int:
        """Bytes of documents that are worth a turn of all automata; one automaton takes batches as they come."""
        return 0 if self.blocks == 1 else SPOOL

    def scanner(self) -> Callable[[list[str | None]], list[tuple]]:
        folder, blocks, window = self.folder, self.blocks, self.window
        return lambda texts: scan((_matcher(folder, k, window) for k in range(blocks)), texts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_words, hit_words, spans, items`` of each row of ``docs``.

    ``hit_words`` are numbers of words within an occurrence of a window, ``spans``
    the same as code points [start, end) of the original text, ``items`` sorted ids.
    """
    items = Items(benchmark, window, block_chars)

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        find = items.scanner()

        def step(cols: dict[str, list]) -> dict[str, list]:
            got = find(cols["text"])
            spans = [[{"start": a, "end": b} for a, b in g[2]] for g in got]
            return {"doc_id": cols["doc_id"], "n_words": [g[0] for g in got], "hit_words": [g[1] for g in got], "spans": spans, "items": [g[3] for g in got]}

        return step

    return map_rows(id_and_text(docs), make, SCHEMA, items.size)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no window of any item."""
    items = Items(benchmark, window, block_chars)

    def make() -> Callable[[dict[str, list]], list[bool]]:
        find = items.scanner()
        return lambda cols: [not g[1] for g in find(cols["text"])]

    return filter_rows(docs, ["text"], make, items.size)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = contamination(docs, benchmark)
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return got.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
