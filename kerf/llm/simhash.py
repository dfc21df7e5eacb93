"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit for each bit of a 64-bit hash: it is 1 if it is set in over half
of the hashes of a text's shingles. Two fingerprints that differ in three bits at most
differ in one bit at most in one of their halves. So each half of each fingerprint is a
key of a table; a small Hamming ball around each half, the half itself and all that are
one bit away, is enumerated and looked up there, and what is found is verified by the
whole distance, in the join's condition. Of two halves that differ in a bit, only the one
without it asks, so a pair is met once a table.

Only different fingerprints are indexed; copies meet in a grouping before. A key that
more than ``HOT`` fingerprints share is no join of all of them: there the remaining 32 bits
must differ by three at most as well, so both sides are cut in halves again, and are keyed
by one half and the ball around it, down to keys of 56 of the 64 bits, which 256 different
fingerprints have at most. Links are contracted where they are found, before they are
exchanged, and components grow by alternating stars on shared storage.

Lower-casing is of A-Z only; words are runs without ASCII white space; fewer words than a
shingle are one shingle; a null, empty or wordless text has the fingerprint 0 and is linked
like any other. Repeated rows have a row each in the result. A row with a null id is
grouped as others are, but a component is never named after it. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import discard, id_and_text, map_rows, materialize
from kerf.llm.graph import components

#: Words of a shingle, the seed of its hash, differing bits of a link.
WORDS, SEED, RADIUS = 3, 42, 3
#: Keys that more fingerprints share are split by further bits.
HOT = 1000
#: Hashes of a text that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed number of 64 bits."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    plain = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n], ends[-n:]
    hashed = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = [hashed(plain[a:b], seed) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())]
        total += np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of each row of ``docs``."""

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        return lambda cols: {"doc_id": cols["doc_id"], "fp": [fingerprint(t, words, seed) for t in cols["text"]]}

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, fp long")


def _masks(width: int, radius: int) -> list[int]:
    """Bits to turn, for all within a radius of a part of ``width`` bits; nothing first."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _halves(rows: DataFrame, width: int, masks: list[int], one_side: bool = False) -> DataFrame:
    """``key, rest, fp, own`` for both halves of ``rest``, which has ``width`` bits, and each mask.

    The key gets the half's number and its bits as the mask turns them; what remains is
    the other half. With ``one_side``, the lowest bit to be turned must be 0.
    """
    half = width // 2
    low = F.col("rest").bitwiseAND(F.lit((1 << half) - 1))
    high = F.shiftrightunsigned("rest", half).bitwiseAND(F.lit((1 << half) - 1))

    def turned(value: Column) -> Column:
        all_ = F.array(*(F.lit(m).cast("long") for m in masks))
        if one_side:
            all_ = F.filter(all_, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0)
        return all_

    def keyed(number: int, value: Column, other: Column) -> Column:
        made = lambda m: F.struct(value.bitwiseXOR(m).bitwiseOR(F.lit(number << half)).alias("part"), other.alias("rest"), (m == 0).alias("own"))
        return F.transform(turned(value), made)

    out = rows.select("key", "fp", F.inline(F.concat(keyed(0, low, high), keyed(1, high, low))))
    return out.select(F.shiftleft("key", half + 1).bitwiseOR(F.col("part")).alias("key"), "rest", "fp", "own")


def _met(table: DataFrame, probes: DataFrame, radius: int, first: bool) -> DataFrame:
    """Pairs of fingerprints that share a key and differ by ``radius`` bits at most."""
    a, b = F.col("a"), F.col("b")
    close = F.bit_count(a.bitwiseXOR(b)) <= radius
    # Where each is asked for by all, equal halves would be met from both sides.
    once = F.when(F.col("own"), a < b).otherwise(a != b) if first else a != b
    return probes.select("key", F.col("fp").alias("a"), "own").join(table.select(F.col("key").alias("k"), F.col("fp").alias("b")), (F.col("key") == F.col("k")) & close & once).select("a", "b")


def _search(table: DataFrame, probes: DataFrame, width: int, radius: int, hot: int, written: list[DataFrame]) -> DataFrame:
    """Links between ``table`` and ``probes`` (key, rest, fp), by keys of further ``width // 2`` bits."""
    half = width // 2
    reach = radius // 2
    first = table is probes
    table, probes = _halves(table, width, [0]), _halves(probes, width, _masks(half, reach), one_side=first)
    if half <= 8:
        return _met(table, probes, radius, first)
    busy = materialize(table.groupBy("key").count().where(F.col("count") > hot).select(F.col("key").alias("busy")), "busy")
    written.append(busy)
    if busy.isEmpty():
        return _met(table, probes, radius, first)
    is_busy = F.col("key") == F.col("busy")
    calm = _met(table.join(busy, is_busy, "left_anti"), probes.join(busy, is_busy, "left_anti"), radius, first)
    # Written, as each is used several times.
    some = [materialize(x.join(busy, is_busy, "left_semi"), "hot") for x in (table, probes)]
    written += some
    return calm.unionAll(_search(*some, half, radius, hot, written))


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """(``a, b``: different fingerprints that differ by ``radius`` bits at most, tables to discard).

    ``prints`` has each ``fp`` once. A link may come more than once.
    """
    rows = prints.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp")
    written: list[DataFrame] = []
    return _search(rows, rows, 64, radius, hot, written), written


def simhash_groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``; the component is the least id that can be reached."""
    each = materialize(fingerprints(docs, words, seed, id_col, text_col), "prints")
    prints = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    found, written = links(prints.select("fp"), radius, hot)
    of = materialize(components(found, "groups"), "of")
    named = prints.join(of, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that Spark can split a fingerprint that very many rows share where it joins.
    names = materialize(named.join(least, "root").select(F.col("fp").alias("vertex"), "component_id"), "names")
    for t in (prints, of, *written):
        discard(t)
    return each.join(names, F.col("fp") == F.col("vertex"), "left").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    got = simhash_groups(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
