"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct shingles of five words (fewer words: the whole
sequence). Sets that are equal are collapsed first, so groups of exact copies cost
one set. Each remaining set has a sketch of minwise tokens. A tree branches sets: at
a node, one or two coordinates of the sketch are drawn by the node's own hash (1 / 0.85
on average at a threshold of 0.85, so that a similar pair survives each level about
once), and a set goes on
to the child of its minwise token there. Nodes of up to ``small`` sets are compared
exhaustively by sketch; larger ones branch again. Sets that stay together with many
others down to the deepest level of two trees form a dense group beforehand, and a node
that lies within one dense group is done. Trees are repeated until a pair at the threshold
is missed with a chance of at most 5e-5 at the first level whose nodes are compared; sets
that are in a large node there get further trees, until it is at most 5e-5 at the deepest
level, too: below 1e-4 together, as ``missed`` computes it from how sketches spread.

Sets that compare as similar form candidate groups, in which all exact links are then
accounted for on full sets. A group is cut into blocks of ``ROWS`` sets or fewer, and a
set is compared with all others of its block that aren't connected with it already. Of a
group of many blocks, one set of each component that a block found goes on and is compared
with those of other blocks, round by round; so copies of one text, however many, cost linear
work in tasks of bounded size. What is then outside its group's largest component is compared
with all sets of the group it isn't connected with, in pairs of blocks; nothing is capped.

Documents without words are linked with nothing. Rows with equal text are linked.
Texts are read twice and rows are told apart by number, so ``docs`` is written to shared
storage first where it isn't read from tables or made of rows at hand. A null id never becomes a component's id where another is there; a component of null
ids alone has a null id. Repeated rows appear as often as they come in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerf.llm.common import Fetch, discard, id_and_text, map_rows, materialize, numbered, released, short_batches
from kerf.llm.graph import components

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union; op1's threshold.
PERCENT = 85
#: Coordinates of a sketch; 16 bits are kept of each.
COORDINATES = 96
#: Levels that are branched before sizes of nodes are looked at, and at most.
FIRST, DEEPEST = 4, 8
SMALL = 64
#: Trees that are branched to the deepest level at once, to find dense groups first.
DENSE_TREES = 2
#: Sets whose sketches agree so many standard errors below the threshold are still candidates.
ERRORS = 5.2
#: What a set that stands for its dense group may have less: its fellows may be that much nearer.
NEARER = 0.16
#: Trees are added until a pair at the threshold is missed with at most this chance at the first
#: level, and further ones for sets in large nodes until it is so at the deepest.
CHANCE = 5e-5
#: Sets of a group, and their shingles, that one task compares at a time.
ROWS = 256
LIMIT = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_501)
_MULTIPLY = _rng.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Plan(NamedTuple):
    """What a threshold asks of trees and sketches."""

    percent: int
    #: Of 100 nodes, those that draw two coordinates.
    again: int
    #: Shares of agreeing coordinates that make candidates, of two sets and of two that stand for groups.
    lenient: float
    loose: float
    trees: int
    #: Trees for sets that are in a large node of any of the first ones.
    deep: int


def missed(percent: int, again: int, lenient: float, trees: int, levels: int) -> float:
    """The chance that a pair at the threshold doesn't meet at a level of any tree, or fails by its sketches.

    Trees share one sketch, so they are independent only for a given number of agreeing coordinates.
    """
    j, total = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        share, apart = k / COORDINATES, 0.0
        for _ in range(levels):
            lost = 1 - share * (1 - apart)
            apart = lost * (1 - again / 100 + again / 100 * lost)
        total += math.comb(COORDINATES, k) * j**k * (1 - j) ** (COORDINATES - k) * (apart**trees if share >= lenient else 1.0)
    return total


def plan(percent: int) -> Plan:
    if not 50 <= percent <= 100:
        raise ValueError("a threshold is from 50 to 100 percent")
    j = percent / 100
    again = round(10_000 / percent) - 100
    lenient = math.floor(100 * (j - ERRORS * math.sqrt(j * (1 - j) / COORDINATES)) + 1e-9) / 100
    trees, deep = (next(n for n in range(1, 1000) if missed(percent, again, lenient, n, k) <= CHANCE) for k in (FIRST, DEEPEST))
    return Plan(percent, again, lenient, round(lenient - NEARER, 2), trees, deep)


class Words(dict):
    """Hashes of the words that a task has seen; bounded, and gone with the task."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, known: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    n = len(words) - w + 1
    acc = np.full(n, w, np.uint64)
    for k in range(w):
        acc = mix(acc * _ODD + h[k : k + n])
    return np.unique(acc)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least value of the set under each of the hash functions."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        values = hashes[None, at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def children(which: np.ndarray, key: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the next level: (number of the set, node) for each set and node; ``percent`` of nodes draw twice."""
    again = mix(key + np.uint64(3)) % np.uint64(100) < np.uint64(percent)
    which, key, turn = (np.concatenate(x) for x in ((which, which[again]), (key, key[again]), (np.zeros(len(key), np.uint64), np.ones(again.sum(), np.uint64))))
    coordinate = (mix(key * _ODD + turn + np.uint64(1)) % np.uint64(COORDINATES)).astype(np.int64)
    value = sketches[which, coordinate].astype(np.uint64)
    return which, mix(mix(key + turn) + _ODD * (value + np.uint64(1)))


def _paths(cols: dict[str, list], trees: range, levels: int, again: int) -> dict[str, list]:
    """The nodes of each set: of ``trees`` at a level, or the children of ``node``. No pair twice."""
    sketches = np.frombuffer(b"".join(cols["sketch"]), np.uint16).reshape(-1, COORDINATES)
    if "node" in cols:
        which, key = np.arange(len(sketches)), np.array(cols["node"], np.int64).view(np.uint64)
    else:
        which = np.repeat(np.arange(len(sketches)), len(trees))
        key = np.tile(mix(np.array(trees, np.uint64) + np.uint64(1)), len(sketches))
    for _ in range(levels):
        which, key = children(which, key, sketches, again)
    order = np.lexsort((key, which))
    which, key = which[order], key[order]
    fresh = np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
    which, key = which[fresh], key[fresh]
    return {c: [cols[c][k] for k in which.tolist()] for c in cols if c not in ("node", "sketch")} | {"node": key.view(np.int64)}


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[dict[str, list]], list[tuple]]], schema: str) -> DataFrame:
    """Applies a Python function to each group, streaming over sorted partitions.

    One task handles many groups, one after the other; only one is in memory.
    """
    short_batches(df.sparkSession)
    out = StructType.fromDDL(schema)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys)
    others = [c for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        step = make()
        now, held, done = None, {c: [] for c in others}, []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in others}
            marks = list(zip(*(cols[k] for k in keys)))
            at = 0
            for k in range(len(marks) + 1):
                if k == len(marks) or marks[k] != (marks[at] if at < k else marks[k]):
                    if k > at:
                        if marks[at] != now and now is not None:
                            done += step(held)
                            held = {c: [] for c in others}
                        now = marks[at]
                        for c in others:
                            held[c] += cols[c][at:k]
                    at = k
            if len(done) > 10_000:
                yield emit()
                done = []
        if now is not None:
            done += step(held)
        if done:
            yield emit()

    return dealt.mapInArrow(lambda batches: released(run(batches)), out)


class _Forest:
    """Union-find over a few numbers; remembers the unions that joined two trees."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            x, y = self.label[a], self.label[b]
            if x != y:
                self.edges.append((a, b))
                self.label[self.label == y] = x


def _compare_sketches(lenient: float, loose: float) -> Callable[[], Callable[[dict[str, list]], list[tuple]]]:
    """Candidate edges that connect the similar sets of a small node."""

    def step(node: dict[str, list]) -> list[tuple]:
        m = node["m"]
        least = loose if node["loose"][0] else lenient
        s = np.frombuffer(b"".join(node["sketch"]), np.uint16).reshape(-1, COORDINATES)
        forest = _Forest(len(m))
        for a in range(len(m) - 1):
            later = np.arange(a + 1, len(m))
            later = later[forest.label[later] != forest.label[a]]
            if len(later):
                forest.join(a, later[(s[later] == s[a]).mean(axis=1) >= least])
        return [(m[a], m[b]) for a, b in forest.edges]

    return lambda: step


def links(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links between the sets.

    Each set is compared in full with all others, but those it is connected with
    already and those whose size rules a link out. With ``side``, only sets of
    different sides are compared; sets of one ``label`` are connected from the start.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size = [sets[k] for k in order], size[order]
    side = None if side is None else side[order]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, token = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(token.max() + 1 if len(token) else 0, np.uint8)
    forest = _Forest(len(sets))
    if label is not None:
        forest.label = np.unique(label[order], return_inverse=True)[1]
    reach = np.searchsorted(size, size * 100 // percent, side="right")
    for a in range(len(sets)):
        lo, hi = a + 1, int(reach[a])
        if size[a] == 0 or hi <= lo:
            continue
        open_ = forest.label[lo:hi] != forest.label[a]
        if side is not None:
            open_ &= side[lo:hi] != side[a]
        if not open_.any():
            continue
        wanted = np.flatnonzero(open_) + lo
        # Only sets that are still open are read.
        n = size[wanted]
        at = np.concatenate([[0], np.cumsum(n)])
        mine = token[start[a] : start[a + 1]]
        marked[mine] = 1
        both = np.add.reduceat(marked[token[np.repeat(start[wanted] - at[:-1], n) + np.arange(at[-1])]], at[:-1], dtype=np.int64)
        marked[mine] = 0
        forest.join(a, wanted[100 * both >= percent * (size[a] + size[wanted] - both)])
    return [(int(order[a]), int(order[b])) for a, b in forest.edges]


def _compare_sets(percent: int) -> Callable[[], Callable[[dict[str, list]], list[tuple]]]:
    """Stars (a, b): each set of a block that is linked with another, and the least of its component."""

    def make():  # noqa: ANN202
        known = Words()

        def step(block: dict[str, list]) -> list[tuple]:
            m = block["m"]
            found = links([shingles(t, known) for t in block["text"]], None, percent) if len(m) > 1 else []
            if not found:
                return []
            label = np.arange(len(m))
            for a, b in found:
                label[label == label[b]] = label[a]
            linked = sorted({k for edge in found for k in edge})
            root: dict[int, int] = {}
            for k in linked:
                root[label[k]] = min(root.get(label[k], m[k]), m[k])
            return [(m[k], root[label[k]]) for k in linked]

        return step

    return make


def _compare_sides(percent: int) -> Callable[[], Callable[[dict[str, list]], list[tuple]]]:
    """Links, as edges of labels, between the sets of two sides that aren't connected by their labels."""

    def make():  # noqa: ANN202
        known = Words()

        def step(pair: dict[str, list]) -> list[tuple]:
            found = links([shingles(t, known) for t in pair["text"]], np.array(pair["side"]), percent, np.array(pair["label"]))
            return [(pair["label"][a], pair["label"][b]) for a, b in found]

        return step

    return make


def _in_blocks(sets: DataFrame, limit: int) -> DataFrame:
    """``sets`` (m, group, n, ...) with the number of blocks of its group and its own block."""
    total = sets.groupBy(F.col("group").alias("k")).agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    by_size = F.when(F.col("total") <= limit, 1).otherwise(F.ceil(2 * F.col("total") / limit))
    total = total.select("k", F.greatest(F.ceil(F.col("sets") / ROWS), by_size).cast("int").alias("blocks"))
    joined = sets.join(total, F.col("group") == F.col("k")).drop("k")
    return joined.withColumn("block", F.pmod(F.xxhash64("m", "blocks"), F.col("blocks")).cast("int"))


def exact_components(texts: Callable[[DataFrame], DataFrame], members: DataFrame, limit: int, percent: int) -> DataFrame:
    """``vertex, root`` of the sets that are linked within their group of ``members`` (m, at, n, group), and of others maybe.

    ``texts`` gives such rows with ``text`` for ``at``.
    """
    star = "a long, b long"
    compare = lambda rows: materialize(map_groups(rows.select("group", "block", "m", "text"), ["group", "block"], _compare_sets(percent), star), "links")
    members = materialize(_in_blocks(members, limit), "members")
    found = compare(texts(members.select("m", "at", "group", "block")))
    done = found.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    hot = members.where("blocks > 1").select("m", "at", "group", "n")
    if hot.isEmpty():
        return done
    hot = materialize(texts(hot), "hot")
    # One set of each component that a block found goes on, until a round brings little.
    step = lambda some, stars: some.join(stars.select(F.col("a").alias("k"), "b"), F.col("label") == F.col("k"), "left").select("m", "group", "n", F.coalesce("b", "label").alias("label"))
    labels = step(hot.select("m", "group", "n", F.col("m").alias("label")), found)
    open_, left = hot, hot.count()
    while True:
        not_first = found.where("a <> b").select(F.col("a").alias("k"))
        open_ = materialize(_in_blocks(open_.select("m", "group", "n", "text").join(not_first, F.col("m") == F.col("k"), "left_anti"), limit), "open")
        before, left = left, open_.count()
        if 2 * left > before:
            break
        found = compare(open_)
        labels = step(labels, found)
        if open_.where("blocks > 1").isEmpty():
            break
    labels = materialize(labels, "labels")
    cold = done.join(hot.select("m"), F.col("vertex") == F.col("m"), "left_anti")
    sizes = labels.groupBy("group", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("total"))
    most = sizes.groupBy(F.col("group").alias("k")).agg(
        F.max_by("label", F.struct("sets", "label")).alias("main"),
        (F.sum("sets") - F.max("sets")).alias("others"), F.sum("sets").alias("sets"), F.sum("total").alias("total"),
    )
    most = materialize(most.where("others > 0"), "most")
    if not most.isEmpty():
        by_size = F.ceil(2 * F.col("total") / limit)
        chunks = F.greatest(F.ceil(F.sqrt(F.col("others") / ROWS)), F.ceil(F.col("others") / F.col("sets") * by_size))
        most = most.withColumn("chunks", chunks.cast("int")).withColumn("parts", F.greatest(F.ceil(F.col("sets") / (ROWS * F.col("chunks"))), by_size).cast("int"))
        rows = labels.join(most, F.col("group") == F.col("k")).join(hot.select(F.col("m").alias("v"), "text"), F.col("m") == F.col("v"))
        own = lambda n: F.pmod(F.xxhash64("m", F.lit(n)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = rows.where("label <> main").select("group", own("chunks").alias("i"), every("parts").alias("j"), "m", "label", "text", F.lit(0).alias("side"))
        other = rows.select("group", every("chunks").alias("i"), own("parts").alias("j"), "m", "label", "text", F.lit(1).alias("side"))
        found = materialize(map_groups(one.unionAll(other), ["group", "i", "j"], _compare_sides(percent), star), "links")
        if not found.isEmpty():
            roots = components(found, "linked").select(F.col("vertex").alias("k"), F.col("root").alias("b"))
            labels = labels.join(roots, F.col("label") == F.col("k"), "left").select("m", F.coalesce("b", "label").alias("label"))
    return cold.select("vertex", "root").unionAll(labels.select(F.col("m").alias("vertex"), F.col("label").alias("root")))


def dense_groups(some: DataFrame, again: int) -> DataFrame | None:
    """``m, group`` of sets in nodes that stay large down to the deepest level of a few trees.

    Sets that share so many minwise tokens with so many others are one candidate group,
    whatever its size; each node adds a star. None where there are no such nodes.
    """
    deep = materialize(map_rows(some, lambda: lambda cols: _paths(cols, range(DENSE_TREES), DEEPEST, again), "node long, m long"), "deep")
    hubs = deep.groupBy(F.col("node").alias("k")).agg(F.count("*").alias("size"), F.min("m").alias("a")).where(F.col("size") > SMALL)
    stars = deep.join(hubs, F.col("node") == F.col("k")).select("a", F.col("m").alias("b")).where("a <> b")
    stars = materialize(stars.distinct(), "stars")
    discard(deep)
    if stars.isEmpty():
        return None
    return materialize(components(stars, "dense").select(F.col("vertex").alias("m"), F.col("root").alias("group")), "dense")


def candidate_edges(reps: DataFrame, by: Plan) -> DataFrame:
    """Edges (a, b) between sets that are similar by sketch, from all trees.

    A node whose sets are all of one dense group adds nothing and is dropped when it is
    counted. Of a large node one set of each group stays; where these are still many, all
    its sets get further trees and it branches again, to the deepest level, where what is
    left large is a candidate group. Small nodes with the same sets, as different trees
    find them, are compared once.
    """
    some = reps.where("n > 0").select("m", "sketch")
    dense = dense_groups(some, by.again)
    edges = None if dense is None else dense.select(F.col("m").alias("a"), F.col("group").alias("b")).where("a <> b")

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("node").alias("k")).agg(
            F.count("*").alias("size"), F.min("group").alias("g0"), F.max("group").alias("g1"),
            F.bit_xor(F.xxhash64("m")).alias("x"), F.bit_xor(F.xxhash64("m", F.lit(1))).alias("y"),
        ).where("g0 <> g1")

    def sized(rows: DataFrame, size: DataFrame) -> DataFrame:
        return materialize(rows.join(size, F.col("node") == F.col("k")).select("node", "m", "group", "size", "x", "y"), "nodes")

    def nodes(sets: DataFrame, trees: range) -> DataFrame:
        paths = materialize(map_rows(sets, lambda: lambda cols: _paths(cols, trees, FIRST, by.again), "node long, m long"), "paths")
        rows = paths.withColumn("group", F.col("m"))
        if dense is not None:
            rows = paths.join(dense.select(F.col("m").alias("v"), "group"), F.col("m") == F.col("v"), "left").select("node", "m", F.coalesce("group", "m").alias("group"))
        # Sizes are written first, so that Spark can split a node of very many sets where it joins.
        out = sized(rows, materialize(sizes(rows), "sizes"))
        discard(paths)
        return out

    def one_of_each(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("node", "group").agg(F.min("m").alias("m"))
        return sized(one, sizes(one))

    kept = nodes(some, range(by.trees))
    one = one_of_each(kept.where(F.col("size") > SMALL))
    large = one.where(F.col("size") > SMALL)
    if not large.isEmpty():
        if by.deep > by.trees:
            wide = materialize(large.select(F.col("node").alias("l")).distinct(), "large")
            sets = kept.join(wide, F.col("node") == F.col("l"), "left_semi").select("m").distinct()
            more = nodes(some.join(sets, "m"), range(by.trees, by.deep))
            kept, one = kept.unionAll(more), one.unionAll(one_of_each(more.where(F.col("size") > SMALL)))
            large = one.where(F.col("size") > SMALL)
        deeper = lambda cols: _paths(cols, range(0), DEEPEST - FIRST, by.again)
        down = materialize(map_rows(large.join(some, "m").select("node", "m", "group", "sketch"), lambda: deeper, "node long, m long, group long"), "paths")
        deep = one_of_each(down)
        least = deep.where(F.col("size") > SMALL).groupBy(F.col("node").alias("k")).agg(F.min("m").alias("a"))
        rest = deep.join(least, F.col("node") == F.col("k")).select("a", F.col("m").alias("b")).where("a <> b")
        edges = rest if edges is None else edges.unionAll(rest)
        one = one.unionAll(deep)
    small = kept.withColumn("loose", F.lit(False)).unionAll(one.withColumn("loose", F.lit(True))).where(F.col("size") <= SMALL)
    # Sums of hashes tell nodes with the same sets.
    small = small.select(F.concat_ws(":", "loose", "size", "x", "y").alias("node"), "loose", "m").distinct()
    found = materialize(map_groups(small.join(some, "m"), ["node"], _compare_sketches(by.lenient, by.loose), "a long, b long"), "candidates")
    return found if edges is None else edges.unionAll(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row, n_shingles, component_id`` of each row of ``docs``.

    ``row`` is the number of the row. Links need a similarity of ``percent`` at least, from 50 to 100.
    """
    return _near(numbered(id_and_text(docs, id_col, text_col)), limit, percent)


def _near(rows: DataFrame, limit: int, percent: int) -> DataFrame:
    by = plan(percent)

    def make():  # noqa: ANN202
        known = Words()

        def step(cols: dict[str, list]) -> dict[str, list]:
            sets = [shingles(t, known) for t in cols["text"]]
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            return {
                "row": cols["row"],
                "doc_id": cols["doc_id"],
                "n": [len(s) for s in sets],
                "hi": [(p >> 64) - (1 << 63) for p in prints],
                "lo": [(p & ((1 << 64) - 1)) - (1 << 63) for p in prints],
                "sketch": [sketch(s).tobytes() if len(s) else b"" for s in sets],
            }

        return step

    sketched = materialize(map_rows(rows, make, "row long, doc_id long, n long, hi long, lo long, sketch binary"), "sketches")
    reps = sketched.where("n > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    reps = materialize(reps.withColumn("m", F.monotonically_increasing_id()), "sets")
    groups = components(candidate_edges(reps, by), "groups").select(F.col("vertex").alias("m"), F.col("root").alias("group"))
    members = groups.join(reps.select("m", F.col("row").alias("at"), "n"), "m")
    texts = lambda some: Fetch(rows, some, "at", "wanted").rows_with(["text"])
    roots = exact_components(texts, members, limit, percent)
    ids = roots.join(reps.select("m", "least_id"), F.col("vertex") == F.col("m"))
    ids = ids.select("m", "root").join(ids.groupBy("root").agg(F.min("least_id").alias("component")), "root").select("m", "component")
    ids = reps.select("hi", "lo", "m", "least_id").join(ids, "m", "left")
    ids = ids.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("component", "least_id").alias("component"))
    own = sketched.select("row", "doc_id", "n", "hi", "lo")
    joined = own.join(ids, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"))


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with its least id; all columns stay.

    Rows that share an id and a component count as one document. Rows whose
    component has no id can't be told apart and all stay.
    """
    # The row number gets a name that no column has.
    name = "row"
    while name in docs.columns:
        name += "_"
    rows = numbered(docs, name)
    got = _near(rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(name).alias("row")), LIMIT, percent)
    first = F.struct(~F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))
    one = got.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min_by("row", first).alias("row")).select("row")
    keep = one.unionAll(got.where("component_id IS NULL").select("row"))
    return rows.join(keep.withColumnRenamed("row", name), name, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
