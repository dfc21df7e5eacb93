"""Centroid clustering of whole-number vectors, with balls of metric trees assigned whole.

The vectors of each partition are put into metric trees, once, and the trees are written
to shared storage. A node stores the radius of its ball, the number of its vectors, their
exact sum and the sum of their squares. In each round a task walks its trees from the
roots: a centroid whose distance to a ball's middle is more than the nearest one's by two
radii or more can't be nearest to any vector inside, by the triangle inequality. Where
one centroid is left, the ball is assigned whole, by its sums; else its halves are looked
at, down to leaves, whose vectors are compared exactly. Radii and distances are taken with
a margin for rounding, so every tie is settled in whole numbers in a leaf.

Nothing but sums by centroid leaves a task: centroids times components, whatever the
input. No vector is shuffled and a vector that very many rows share is one ball of radius
nought. The driver holds centroids only.

Vectors count if they have exactly ``dim`` components, none null, NaN or infinite; others
have no row in the result. Repeated rows count each; of equal ids that draw the same place
the smaller vector comes first. A null id is never drawn as a first centroid, and its row
has a null id. With fewer vectors than centroids there are fewer centroids, with none the
result is empty. A component times ``scale`` must be below 2^20 in magnitude, or an error
says so: that keeps sums of squares exact. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import full_batches, materialize, released

#: Vectors of a tree and of a leaf.
TREE, LEAF = 8192, 32
#: Components are below this in magnitude, so that squares are exact as doubles.
LIMIT = 1 << 20
TREES = "ids array<long>, vectors binary, start binary, count binary, child binary, radius binary, sums binary, squares binary"
PARTS = "cluster int, place int, total decimal(38,0)"


@dataclass
class Tree:
    """``vectors`` in the order of the leaves; nodes are ranges of them, children follow each other."""

    vectors: np.ndarray
    start: np.ndarray
    count: np.ndarray
    #: The first child; -1 for a leaf.
    child: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def grown(cls, vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of ``vectors`` (rows of int64) and the order in which it keeps them."""
        x = vectors.astype("f8")
        order = np.arange(len(x))
        start, count, child, radius, sums = [0], [len(x)], [], [], []
        k = 0
        while k < len(start):
            a, n = start[k], count[k]
            own = x[order[a : a + n]]
            total = own.sum(0)
            away = own - total / n
            apart = np.einsum("ij,ij->i", away, away)
            sums.append(total)
            radius.append(np.sqrt(apart.max()))
            if n <= leaf or not np.any(own != own[0]):
                child.append(-1)
            else:
                # Halves along the line from the outermost vector to the one farthest from it.
                one = own[apart.argmax()]
                off = own - one
                other = own[np.einsum("ij,ij->i", off, off).argmax()]
                half = np.argpartition(off @ (other - one), n // 2)
                order[a : a + n] = order[a : a + n][half]
                child.append(len(start))
                start += [a, a + n // 2]
                count += [n // 2, n - n // 2]
            k += 1
        put = vectors[order]
        start, count = np.array(start), np.array(count)
        upto = np.concatenate([[0], np.cumsum(np.einsum("ij,ij->i", put, put))])
        return cls(put, start, count, np.array(child), np.array(radius), np.array(sums).astype("i8"), upto[start + count] - upto[start]), order

    def packed(self) -> list[bytes]:
        kinds = (("<i4", self.vectors), ("<i4", self.start), ("<i4", self.count), ("<i4", self.child), ("<f8", self.radius), ("<i8", self.sums), ("<i8", self.squares))
        return [a.astype(kind).tobytes() for kind, a in kinds]

    @classmethod
    def unpacked(cls, parts: list[bytes], dim: int) -> Tree:
        kinds = ("<i4", "<i4", "<i4", "<i4", "<f8", "<i8", "<i8")
        vectors, start, count, child, radius, sums, squares = (np.frombuffer(p, k) for p, k in zip(parts, kinds))
        return cls(vectors.reshape(-1, dim).astype("i8"), start, count, child, radius, sums.reshape(-1, dim), squares)

    def walk(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes assigned whole, their centroids, vectors compared one by one, their centroids)."""
        c = centroids.astype("f8")
        cc = np.einsum("ij,ij->i", c, c)
        whole, whole_at, leaves = [], [], []
        now = np.zeros(1, np.int64)
        while len(now):
            mid = self.sums[now] / self.count[now][:, None]
            mm = np.einsum("ij,ij->i", mid, mid)
            away = np.sqrt(np.maximum(mm[:, None] - 2 * (mid @ c.T) + cc, 0))
            margin = 1e-6 * (1 + np.sqrt(mm) + np.sqrt(cc.max()))
            best = away.argmin(1)
            near = away - (away[np.arange(len(now)), best] + 2 * self.radius[now] + margin)[:, None] <= 0
            done = near.sum(1) == 1
            whole.append(now[done])
            whole_at.append(best[done])
            rest = now[~done]
            first = self.child[rest]
            leaves.append(rest[first < 0])
            first = first[first >= 0].astype(np.int64)
            now = np.concatenate([first, first + 1])
        leaf = np.concatenate(leaves)
        n = self.count[leaf]
        each = np.repeat(self.start[leaf] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own = self.vectors[each].astype("f8")
        # |v|^2 is the same for all centroids; all numbers are whole and below 2^53, so exact.
        exact = (cc - 2 * (own @ c.T)).argmin(1)
        return np.concatenate(whole), np.concatenate(whole_at), each, exact

    def summed(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By centroid: vectors, their sum, their squared distances."""
        nodes, at, each, own = self.walk(centroids)
        k = len(centroids)
        count = np.bincount(at, self.count[nodes], k).astype("i8") + np.bincount(own, minlength=k)
        sums = np.zeros(centroids.shape, np.int64)
        np.add.at(sums, at, self.sums[nodes])
        np.add.at(sums, own, self.vectors[each])
        squares = np.zeros(k, np.int64)
        np.add.at(squares, at, self.squares[nodes])
        np.add.at(squares, own, np.einsum("ij,ij->i", self.vectors[each], self.vectors[each]))
        inertia = squares - 2 * np.einsum("ij,ij->i", centroids, sums) + count * np.einsum("ij,ij->i", centroids, centroids)
        return count, sums, inertia

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector and the squared distance."""
        nodes, at, each, own = self.walk(centroids)
        out = np.empty(len(self.vectors), np.int64)
        for a, n, c in zip(self.start[nodes].tolist(), self.count[nodes].tolist(), at.tolist()):
            out[a : a + n] = c
        out[each] = own
        away = self.vectors - centroids[out]
        return out, np.einsum("ij,ij->i", away, away)


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors that count, as floor(scale * x) of each component."""
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return kept.where((F.size("v") == dim) & fine).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def grow(whole: DataFrame, dim: int, size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """A row for each tree over the vectors of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in full_batches(batches, size * (dim + 1) * 8):
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            if v.max() >= LIMIT or v.min() <= -LIMIT:
                raise ValueError(f"a component is {LIMIT} or more in magnitude after scaling")
            tree, order = Tree.grown(v, leaf)
            ids = batch.column(0).take(pa.array(order))
            cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in tree.packed())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in TREES.split(", ")])

    return whole.mapInArrow(lambda batches: released(run(batches)), TREES)


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].values, Tree.unpacked([batch.column(c)[k].as_py() for c in range(1, batch.num_columns)], dim)


def totals(trees: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]], list[int]]:
    """By centroid: vectors nearest to it, their sum, their squared distances. Exact."""
    held = np.array(centroids, np.int64)
    k, dim = held.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Objects, as sums over a task may pass 64 bits.
        total = np.zeros((k, dim + 2), object)
        for _, tree in _trees(batches, dim):
            count, sums, inertia = tree.summed(held)
            total += np.column_stack([count, inertia, sums]).astype(object)
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array([Decimal(int(v)) for v in total[c, p]], pa.decimal128(38, 0))], names=["cluster", "place", "total"]
        )

    got = trees.mapInArrow(lambda batches: released(run(batches)), PARTS).groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    out = [[0] * (dim + 2) for _ in range(k)]
    for r in got:
        out[r["cluster"]][r["place"]] = int(r["total"])
    return [o[0] for o in out], [o[2:] for o in out], [o[1] for o in out]


def assign(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of each vector; the distance is squared."""
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, held.shape[1]):
            at, away = tree.assigned(held)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(lambda batches: released(run(batches)), "vec_id long, cluster int, distance long")


def first_centroids(whole: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors whose ids hash lowest with the seed."""
    drawn = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v").where("h IS NOT NULL")
    return [list(r["v"]) for r in drawn.orderBy("h", "v").limit(k).collect()]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(``vec_id, cluster, distance``, final centroids, squared distances by centroid)."""
    whole = whole_vectors(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(whole, k, seed)
    trees = materialize(grow(whole, dim), "trees")
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), [], []
    for _ in range(rounds):
        counts, sums, _ = totals(trees, centroids)
        centroids = [[s // n for s in total] if n else c for n, total, c in zip(counts, sums, centroids)]
    return assign(trees, centroids), centroids, totals(trees, centroids)[2]


def cluster_report(vectors: DataFrame) -> DataFrame:
    rows, centroids, inertia = cluster(vectors)
    each = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1).cast(kind) if values else F.lit(None).cast(kind)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select(
        "vec_id", "cluster", "distance", each(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), each(digests, "string").alias("centroid_sha256"),
    )
