"""Exact removal of repeated byte strings over a whole corpus, by suffix arrays.

Every 100-byte string has an anchor: the least hash among its 24-byte grams. Equal
strings have equal anchors, so the strings of a document fall into runs that share
an anchor, and a run's bytes make a segment. Segments meet by the gram of their
anchor; grams that occur once, most of them, are dropped after a count.

* Where a gram has different segments, one of each kind is sent to a shard. A shard
  is a text of many segments; its suffix array is built by induced sorting, and
  permuted common prefixes tell which suffixes share 100 bytes with the one before.
  In each run of such suffixes all but the first in order are repeats.
* Further copies of a kind would stand next to it in the suffix array and share all their
  bytes with it, so all their strings are repeats of its strings; they aren't sent, since
  one text may be a third of all rows. They are found by the hash of the kind's bytes.
* A gram with more kinds of segments than ``hot`` is too much for a task. Its strings are
  told apart by more of the symbols around the anchor, half of those that are left at each
  level: 38 after it where a string has them, else 38 before, and so on to the whole
  string. Equal strings agree on all of them. What falls apart so goes the same way again.

So each repeated string is found exactly once, wherever its copies are, and no group
has to fit in one task. Spans found are united by document and cut out.

Strings never cross documents. First means smaller ``doc_id`` (null is least), then
the smaller row number, then the earlier start. Texts are read several times and rows
told apart by number, so ``docs`` is written to shared storage first where it isn't read
from tables or made of rows at hand; texts themselves are never shuffled.
Null text counts as empty. Documents of fewer than ``width`` bytes lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerf.llm.common import Fetch, discard, free_shuffles, id_and_text, map_rows, materialize, numbered, released, short_batches
from kerf.llm.neardup import mix
from kerf.llm.suffixarray import permuted_prefixes, suffix_array

WIDTH = 100
GRAM = 24
#: Kinds of segments that a gram may have to be compared in a shard.
HOT = 2_000
#: Bytes of a shard, about.
SHARD = 1_000_000
#: Bytes whose anchors are found at a time; with the overlap below 2 ** 20.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + WIDTH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place."""
    if not _POWERS:
        _POWERS[:] = [_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)], out=total[1:])
    n = len(data) - GRAM + 1
    return mix((total[GRAM:] - total[:n]) * _POWERS[1][:n])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, from least values of blocks to both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], onward[w - 1 : w - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, start, count, place of the anchor): the strings that start at start, start + 1, ... share an anchor.

    ``ends`` are the ends of the documents that ``data`` is made of; strings lie within one.
    """
    out = []
    for at in range(0, max(0, len(data) - width + 1), CHUNK):
        part = data[at : at + CHUNK + width - 1]
        h = grams(part)
        m = len(part) - width + 1
        # The place is part of what is compared: of equal grams the first is the anchor.
        tagged = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(tagged, width - GRAM + 1) & _POSITION).astype(np.int64)
        place = np.arange(at, at + m)
        ok = place + width <= ends[np.searchsorted(ends, place, side="right")]
        turn = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])]))
        count = np.diff(np.concatenate([turn, [m]]))
        good = ok[turn]
        out.append((h[anchor[turn[good]]], turn[good] + at, count[good], anchor[turn[good]] + at))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


SEGMENTS = "g long, s long, doc_id long, row long, start int, n int, anchor int"


def segments(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """All segments: gram of the anchor, hash of the bytes, document, first string, number of strings, place of the anchor."""
    short_batches(rows.sparkSession)
    out = StructType.fromDDL(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            joined = b"".join(raw)
            ends = np.cumsum([len(r) for r in raw])
            gram, start, n, anchor = runs(np.frombuffer(joined, np.uint8), ends, width)
            doc = np.searchsorted(ends, start, side="right")
            stop = start + n + width - 1
            content = np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)
            begins = np.concatenate([[0], ends])[:-1]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    batch.column("doc_id").take(take),
                    batch.column("row").take(take),
                    pa.array((start - begins[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array((anchor - begins[doc]).astype(np.int32)),
                ],
                schema=arrow,
            )

    return rows.select("doc_id", "row", "text").mapInArrow(lambda batches: released(run(batches)), out)


def repeats_in_shard(parts: list[tuple[tuple, int, bytes]], width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(part, first, count) of the strings that occur before in the shard.

    A part is a place (an order over all strings), its number of strings and its bytes.
    """
    order = sorted(range(len(parts)), key=lambda k: parts[k][0])
    blobs = [parts[k][2] for k in order]
    text = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    size = np.array([len(b) for b in blobs])
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    between = np.zeros(len(text), bool)
    between[begin + size] = True
    symbols = np.concatenate([np.where(between, 1, text.astype(np.int64) + 2), [0]])
    sa = suffix_array(symbols)
    shared = permuted_prefixes(symbols, sa)
    n = np.array([parts[k][1] for k in order])
    # Only suffixes with ``width`` bytes count. Others can't stand between two that share as many.
    owner = np.full(len(symbols), -1)
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    owner[starts] = np.repeat(np.arange(len(parts)), n)
    sa = sa[owner[sa] >= 0]
    same = shared >= width
    head = np.flatnonzero(~same[sa])
    # Parts are in order within the shard, so a smaller place in its text is an earlier string.
    first = np.minimum.reduceat(sa, head) if len(sa) else sa
    repeated = np.sort(sa[sa != np.repeat(first, np.diff(np.concatenate([head, [len(sa)]])))])
    if not len(repeated):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(repeated) != 1) | (owner[repeated[1:]] != owner[repeated[:-1]])]))
    count = np.diff(np.concatenate([cut, [len(repeated)]]))
    lead = repeated[cut]
    who = owner[lead]
    return [(order[w], int(a), int(c)) for w, a, c in zip(who.tolist(), (lead - begin[who]).tolist(), count.tolist())]


def _in_shards(contents: DataFrame, width: int) -> DataFrame:
    """Streams over segments sorted by gram; grams are put together until a shard is full."""
    short_batches(contents.sparkSession)
    out = StructType.fromDDL("row long, start int, n int")
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contents.repartition(n, "g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        held: list[dict] = []
        size = 0

        def solve() -> pa.RecordBatch:
            place = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["row"], r["start"])
            found = repeats_in_shard([(place(r), r["n"], r["bytes"]) for r in held], width)
            cols = [[held[k]["row"] for k, _, _ in found], [held[k]["start"] + a for k, a, _ in found], [c for _, _, c in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if size >= SHARD and r["g"] != last:
                    yield solve()
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
                last = r["g"]
        if held:
            yield solve()

    return dealt.mapInArrow(lambda batches: released(run(batches)), out)


def _contents(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the segments in ``wanted``, each fetched where its document is read."""
    # Two whole numbers a segment: its gram, and start, number of strings and distance of the anchor in one.
    packed = F.shiftleft(F.col("start").cast("long"), 24) + F.shiftleft(F.col("n").cast("long"), 12) + (F.col("anchor") - F.col("start"))
    lists = wanted.groupBy("row").agg(F.flatten(F.collect_list(F.array("g", packed))).alias("cuts"))
    fetch = Fetch(rows, lists.withColumnRenamed("row", "at").withColumn("row", F.col("at")), "at", "cuts")

    def make():  # noqa: ANN202
        def step(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("g", "doc_id", "row", "start", "n", "anchor", "bytes")}
            for doc, row, text, cuts in zip(cols["doc_id"], cols["row"], cols["text"], cols["cuts"]):
                raw = text.encode("utf-8", "surrogatepass")
                for g, c in zip(cuts[::2], cuts[1::2]):
                    a, n = c >> 24, c >> 12 & 0xFFF
                    for k, v in zip(out, (g, doc, row, a, n, a + (c & 0xFFF), raw[a : a + n + width - 1])):
                        out[k].append(v)
            return out

        return step

    return fetch.rows_with(["doc_id", "text"], make=make, schema="g long, doc_id long, row long, start int, n int, anchor int, bytes binary")


def reach(level: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """For a string whose anchor begins at each of its places: the symbols before and after the anchor that tell it apart."""
    out = []
    for at in range(width - GRAM + 1):
        before = after = 0
        for _ in range(level):
            half = -(-(width - GRAM - before - after) // 2)
            if width - GRAM - at - after >= half:
                after += half
            else:
                before += half
        out.append((before, after))
    return out


def _finer(contents: DataFrame, level: int, width: int) -> DataFrame:
    """The segments of hot grams, cut and told apart by as many symbols around the anchor as ``level`` asks for."""
    known = reach(level, width)

    def make():  # noqa: ANN202
        def step(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k.split()[0]: [] for k in SEGMENTS.split(", ")}
            for doc, row, start, n, anchor, raw in zip(*(cols[k] for k in ("doc_id", "row", "start", "n", "anchor", "bytes"))):
                p, k = anchor - start, 0
                while k < n:
                    before, after = known[p - k]
                    to = k + 1
                    while to < n and known[p - to] == (before, after):
                        to += 1
                    key = b"%d %d " % (before, after) + raw[p - before : p + GRAM + after]
                    content = raw[k : to + width - 1]
                    hashed = (xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in (key, content))
                    for name, v in zip(out, (*hashed, doc, row, start + k, to - k, anchor)):
                        out[name].append(v)
                    k = to
            return out

        return step

    return map_rows(contents, make, SEGMENTS)


def repeated_strings(rows: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """``row, start, n``: strings of ``width`` bytes at start, ..., start + n - 1 of a row occur before."""
    spark = rows.sparkSession
    every = segments(rows, width)
    # Counting first moves eight bytes a segment, with partial counts; then only repeated grams move in full.
    often = materialize(every.groupBy("g").count().where("count > 1").select(F.col("g").alias("k")), "grams")
    free_shuffles(spark)
    alike = materialize(every.join(often, F.col("g") == F.col("k")).drop("k"), "segments")
    free_shuffles(spark)
    discard(often)
    found, level = None, 0
    while True:
        copies, several = _kinds(alike)
        discard(alike)
        free_shuffles(spark)
        shards = materialize(_in_shards(_contents(rows, several.where(F.col("kinds") <= hot), width), width), "shards")
        free_shuffles(spark)
        found = copies.unionAll(shards) if found is None else found.unionAll(copies).unionAll(shards)
        more = several.where(F.col("kinds") > hot)
        # At the last level all symbols are known, and a gram has one kind.
        if more.isEmpty():
            discard(several)
            return found
        level += 1
        hot_ones = materialize(_contents(rows, more, width), "hot")
        alike = materialize(_finer(hot_ones, level, width), "finer")
        discard(hot_ones)
        discard(several)


def _kinds(alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of a kind but the first, as repeats; and the first of each kind of grams that have several kinds."""
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start", "n", "anchor")
    kinds = materialize(alike.groupBy("g", "s").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "kinds")
    firsts = kinds.where("copies > 1").select(F.col("g").alias("k"), F.col("s").alias("t"), F.col("first.row").alias("r"), F.col("first.start").alias("a"))
    copies = alike.join(firsts, (F.col("g") == F.col("k")) & (F.col("s") == F.col("t")))
    copies = copies.where((F.col("row") != F.col("r")) | (F.col("start") != F.col("a"))).select("row", "start", "n")
    copies = materialize(copies, "copies")
    # Written, so that Spark can split a gram of very many kinds where it joins.
    number = materialize(kinds.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("kinds")).where("kinds > 1"), "number")
    several = kinds.join(number, F.col("g") == F.col("k")).select("g", "kinds", *(f"first.{c}" for c in ("row", "start", "n", "anchor")))
    several = materialize(several, "several")
    discard(kinds)
    discard(number)
    return copies, several


def cut(raw: bytes, spans: list[int] | None, width: int = WIDTH) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal runs removed.

    A span is the first string's start and, in the lower 32 bits, the number of strings.
    """
    if not spans:
        return raw, 0, 0
    packed = np.array(spans, np.int64)
    start, n = packed >> 32, packed & 0xFFFFFFFF
    size = len(raw) + 1
    mark = np.bincount(start, minlength=size) - np.bincount(start + n + width - 1, minlength=size)
    gone = np.cumsum(mark)[:-1] > 0
    data = np.frombuffer(raw, np.uint8)
    return data[~gone].tobytes(), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of each row of ``docs``."""
    rows = numbered(id_and_text(docs, id_col, text_col))
    found = repeated_strings(rows, width, hot)
    # Lists are bounded by the length of a document.
    lists = found.groupBy(F.col("row").alias("at")).agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")).alias("spans"))
    fetch = Fetch(rows, lists, "at", "spans")

    def make():  # noqa: ANN202
        def step(cols: dict[str, list]) -> dict[str, list]:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in cols["text"]]
            got = [cut(r, s, width) for r, s in zip(raw, cols["spans"])]
            return {
                "doc_id": cols["doc_id"],
                "n_bytes": list(map(len, raw)),
                "n_removed": [g[1] for g in got],
                "n_spans": [g[2] for g in got],
                "kept": [g[0] for g in got],
            }

        return step

    return fetch.rows_with(["doc_id", "text"], others=True, make=make, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
