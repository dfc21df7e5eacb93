"""How far the sources of each language lie apart in their terms, by systolic rotation.

Terms are counted by (lang, source) within tasks before anything is exchanged. Of each
language the terms stay that ``MIN_DOCS`` of its documents have; they are dealt to shards
of about ``SHARD`` terms, and a term's number is its place in its shard. Groups of a
language are dealt to blocks of about ``BLOCK``. So what one task holds, the counts of a
block within a shard, is bounded however large a source, a vocabulary or a language is.

A task takes its residents, ranks the terms of each with a heap of its own, and leaves
their vectors, compressed, in shared storage. Then a tournament runs within each shard:
in round r block i meets block (r - i) mod the number of blocks, as in a round robin, so
every two blocks meet once and each meets itself once. Residents stay where they are; the
peer's vectors come around, and a meeting evaluates both directions. Only sums leave a
task, and partial sums of the shards are added up.

Probabilities and divergences are whole numbers, by exact arithmetic throughout: a count
is scaled by 10^9 in three steps of 1000, so totals may have fifteen digits.

Null text, lang and source are read as empty. Every (lang, source) that occurs is a group,
even without text; languages without kept terms have divergences of 0. Repeated rows count
each as a document. Ties rank by the item's UTF-8 bytes. Ids aren't read, and further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerf.llm.common import discard, give_back, materialize, released, shared_dir, short_batches

MIN_DOCS, TOP = 10, 10
#: Terms of a shard and groups of a block.
SHARD, BLOCK = 16384, 32
#: Entries of counts that a task holds before it hands them on.
HELD = 200_000
_TERMS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
COUNTS = "lang string, source string, term binary, n long, docs long"
_UNIT = "unit string, lang string, shard int, block int, blocks int, top array<struct<lang:string,source:string,term:string,value:long>>"
PAIRS = "lang string, source string, item string, value long"


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and of anything beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, summed within tasks only.

    Each group has a row with a null term as well.
    """
    some = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    short_batches(some.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(COUNTS))

    def handed(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, has) in groups.items():
            keys = [None, *n]
            cols = [[lang] * len(keys), [source] * len(keys), keys, [0, *n.values()], [0, *(has[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, has = groups.setdefault((lang, source), (Counter(), Counter()))
                own = terms(text)
                before = len(n)
                n.update(own)
                has.update(set(own))
                held += len(n) - before
            if held > HELD or len(groups) > HELD // 10:
                yield from handed(groups)
                groups, held = {}, 0
        yield from handed(groups)

    return some.mapInArrow(lambda batches: released(run(batches)), COUNTS)


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), for counts + 2 up to ``total``."""
    rest = count.astype(np.int64) + 2
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        part = rest // total
        out = out * 1000 + part
        rest -= part * total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Block:
    """Vectors of the groups of a block within a shard: numbers of terms in order, and their scaled counts."""

    def __init__(self, terms_: int, groups: list[tuple[str, int, np.ndarray, np.ndarray]]) -> None:
        """``groups`` are (source, scaled count of an absent term, numbers, scaled counts)."""
        self.terms, self.groups = terms_, groups

    def packed(self) -> bytes:
        """Compressed: differences of numbers, then scaled counts."""
        head = [f"{self.terms}"]
        parts = []
        for source, absent, at, p in self.groups:
            head.append(f"{source.encode('utf-8', 'surrogatepass').hex()} {absent} {len(at)}")
            parts += [np.diff(at, prepend=0).astype("<i4").tobytes(), p.astype("<i4").tobytes()]
        front = "\n".join(head).encode()
        return len(front).to_bytes(4, "little") + zlib.compress(front + b"".join(parts), 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> Block:
        front = int.from_bytes(raw[:4], "little")
        body = zlib.decompress(raw[4:])
        n, *rest = body[:front].decode().split("\n")
        groups, at = [], front
        for line in rest:
            name, absent, size = line.split(" ")
            own = np.frombuffer(body, "<i4", 2 * int(size), at).astype(np.int64)
            at += 8 * int(size)
            groups.append((bytes.fromhex(name).decode("utf-8", "surrogatepass"), int(absent), np.cumsum(own[: int(size)]), own[int(size) :]))
        return cls(int(n), groups)

    def meet(self, peer: Block) -> Iterator[tuple[str, str, int]]:
        """(source, other, value) in both directions of each pair; of a block with itself, each pair once."""
        for k, (other, absent, at, q) in enumerate(peer.groups):
            dense = np.full(self.terms, absent, np.int64)
            dense[at] = q
            has = np.zeros(self.terms, bool)
            has[at] = True
            for source, own, mine, p in self.groups[:k] if peer is self else self.groups:
                both = has[mine]
                alone = has.copy()
                alone[mine] = False
                value = int(divergence(p, dense[mine]).sum()) + int(divergence(np.int64(own), dense[alone]).sum())
                neither = self.terms - len(mine) - len(at) + int(both.sum())
                value += neither * int(divergence(np.int64(own), np.int64(absent)))
                # The divergence is the same seen from either.
                yield source, other, value
                yield other, source, value


def _resident(folder: str, most: int) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of a block in a shard: ranks terms, writes the vectors, gives a row for the unit."""

    schema = to_arrow_schema(StructType.fromDDL(_UNIT))

    def run(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        number, n, of_lang, total = (got.column(c).fill_null(-1).to_numpy() for c in ("number", "n", "of_lang", "total"))
        # Each group has a row without a number, which holds what is the same for all its terms.
        marks = np.flatnonzero(number < 0)
        first = {c: got.column(c)[int(marks[0])].as_py() for c in ("lang", "shard", "block", "blocks", "terms", "kept", "lang_n")}
        spare = 2 * first["kept"]
        spelt, names = got.column("term"), got.column("source").to_pylist()
        of: dict[str, list[int]] = {}
        for k in np.flatnonzero(number >= 0).tolist():
            of.setdefault(names[k], []).append(k)
        groups, top = [], []
        for mark in marks.tolist():
            source, size = names[mark], int(total[mark]) + spare
            absent = int(scaled(np.zeros(1), size)[0]) if spare else 1
            rows = np.array(of.get(source, []), np.int64)
            rows = rows[np.argsort(number[rows])]
            p = scaled(n[rows], size)
            groups.append((source, absent, number[rows].astype(np.int64), p))
            q = scaled(of_lang[rows], first["lang_n"] + spare)
            more = np.flatnonzero(p > q)
            value = divergence(p[more], q[more]).tolist()
            best = heapq.nsmallest(most, ((-v, spelt[r].as_py().encode("utf-8", "surrogatepass")) for v, r in zip(value, rows[more].tolist())))
            top += [{"lang": first["lang"], "source": source, "term": t.decode("utf-8", "surrogatepass"), "value": -v} for v, t in best]
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        unit = uuid.uuid5(uuid.NAMESPACE_URL, first["lang"]).hex
        name = f"{root}/{unit}-{first['shard']}-{first['block']}"
        own = f"{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(Block(int(first["terms"]), groups).packed())
        fs.move(own, name)
        row = {"unit": unit, "lang": first["lang"], "shard": first["shard"], "block": first["block"], "blocks": first["blocks"], "top": top}
        return pa.Table.from_pylist([row], schema=schema)

    return run


def _tournament(units: DataFrame, folder: str) -> DataFrame:
    """``lang, source, item, value`` of each meeting of two groups within a shard."""

    schema = to_arrow_schema(StructType.fromDDL(PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)

        def fetched(unit: str, shard: int, block: int) -> Block:
            with fs.open_input_stream(f"{root}/{unit}-{shard}-{block}") as source:
                return Block.unpacked(source.read())

        for batch in batches:
            for unit, lang, shard, block, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                own = fetched(unit, shard, block)
                for turn in range(blocks):
                    peer = (turn - block) % blocks
                    # One of the two has the meeting: half of the rounds each.
                    if peer != block and (block < peer) != (turn % 2 == 0):
                        continue
                    met = list(own.meet(own if peer == block else fetched(unit, shard, peer)))
                    if met:
                        cols = [[lang] * len(met), *map(list, zip(*met))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            give_back()

    return units.mapInArrow(lambda batches: released(run(batches)), PAIRS)


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each group of ``docs``.

    Part ``pair``: each other source of the language and the divergence from it. Part
    ``term``: the terms that set the group apart from its language most, ``top`` at most.
    """
    spark = docs.sparkSession
    counted = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counted.withColumn("term", F.col("term").cast("string")), "counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", "term", "of_lang"), "terms")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_n")), "lang", "left").select(
        "lang", F.greatest(F.lit(1), F.ceil(F.col("sources") / block)).cast("int").alias("blocks"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / shard)).cast("int").alias("shards"),
    )
    langs = materialize(langs, "langs")
    place = Window.partitionBy("lang", "shard").orderBy("term")
    numbered = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    numbered = materialize(numbered.withColumn("number", F.row_number().over(place) - 1).drop("shards"), "numbers")
    entries = materialize(counts.join(numbered, ["lang", "term"]).select("lang", "source", "shard", "number", "n", "of_lang", "term"), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = numbered.groupBy("lang", "shard").agg(F.count("*").alias("terms"))
    known = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks", "kept", "lang_n", "shards"
    )
    # A block that no group falls to stays away: blocks are numbered by those that have some.
    busy = known.select("lang", "block").distinct().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("block")) - 1)
    busy = busy.withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    known = known.join(busy, ["lang", "block"]).drop("block", "blocks").withColumnsRenamed({"at": "block", "of": "blocks"})
    known = materialize(known.withColumn("blocks", F.col("blocks").cast("int")), "known")
    # Each group has a row in each shard, so that absent terms count as well.
    present = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(sizes, ["lang", "shard"], "left")
    own = entries.join(known.select("lang", "source", "block"), ["lang", "source"])
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("lang", "shard", "block", "source", "number", "n", "of_lang", "term", "total", "blocks", "kept", "lang_n", "terms")
    marks = present.withColumn("terms", F.coalesce("terms", F.lit(0))).select(
        *(none(dict(number="int", n="long", of_lang="long", term="string")[c]).alias(c) if c in ("number", "n", "of_lang", "term") else F.col(c) for c in columns)
    )
    rows = marks.unionByName(own, allowMissingColumns=True).select(*columns)
    folder = shared_dir(spark, "vectors")
    units = materialize(rows.groupBy("lang", "shard", "block").applyInArrow(_resident(folder, top), _UNIT), "units")
    pairs = _tournament(units.select("unit", "lang", "shard", "block", "blocks").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit", "shard", "block"), folder)
    pairs = materialize(pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    best = units.select(F.inline("top")).select("lang", "source", F.col("term").alias("item"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    for t in (counts, kept, langs, numbered, entries, known):
        discard(t)
    return ranked(pairs, "pair").unionAll(ranked(best, "term").where(F.col("rank") <= top))

