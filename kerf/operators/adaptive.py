"""The octree over a sparse distance field, built from the root down by samples.

A node is looked at in nine cells: its corners and its middle. Where these have one sign and
differ by less than the resolution it is a leaf, else it has eight children; single cells are
leaves. A field has rows only below its band, so what no row comes near to is a leaf of the band
high up, and no dense lattice is made.

Within a block of cells (see :mod:`kerf.operators.blocks`) all levels are decided at once, from an array;
above blocks, only the corners of blocks can be samples, one row a block, and levels follow by joins
of nodes with their samples.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.grid import AXES, Grid
from kerf.operators.blocks import BLOCK, SIDE
from kerf.storage import shared_folder

#: The level of a node that is a block.
BLOCK_LEVEL = SIDE.bit_length() - 1
NODE = [f"c{n}" for n in AXES]
LEAVES = "level array<int>, cx array<int>, cy array<int>, cz array<int>, value array<double>, corner array<double>"


def _even(lo, hi, res: float):  # noqa: ANN001, ANN202
    """Whether one value would do, of columns as of arrays."""
    return ((lo > 0) | (hi <= 0)) & (hi - lo < res)


def _within(d: np.ndarray, top: int, res: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves of the node ``d`` (z, y, x) of the level ``top``: level, places (n, 3) in nodes of the level, and values."""
    found, open_ = [], np.ones((1, 1, 1), bool)
    for level in range(top, -1, -1):
        size = 1 << level
        lo = hi = d[::size, ::size, ::size]
        for at in [*product((0, size - 1), repeat=3), (size // 2,) * 3]:
            v = d[at[0] :: size, at[1] :: size, at[2] :: size]
            lo, hi = np.minimum(lo, v), np.maximum(hi, v)
        leaf = open_ & (_even(lo, hi, res) if level else True)
        found.append((level, np.argwhere(leaf), ((lo + hi) / 2)[leaf]))
        open_ = open_ & ~leaf
        for axis in range(3):
            open_ = np.repeat(open_, 2, axis)
    return found


def _packed(field: DataFrame, top: int, grid: Grid, band: float) -> DataFrame:
    """bx, by, bz of each block that has rows, its leaves if it is a node of the tree, and its eight corners."""
    level, res = min(top, BLOCK_LEVEL), float(grid.res)

    def block(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        d = np.full((1 << level,) * 3, float(band))
        x, y, z = (table[n].to_numpy() - b * SIDE for n, b in zip(AXES, at))
        d[z, y, x] = np.minimum(table["d"].to_numpy(), band)
        found = _within(d, level, res)
        places = np.concatenate([p + [b << (level - k) for b in at[::-1]] for k, p, _ in found]).astype(np.int32)
        columns = {
            "level": np.concatenate([np.full(len(p), k, np.int32) for k, p, _ in found]),
            **{n: np.ascontiguousarray(places[:, 2 - i]) for i, n in enumerate(NODE)},
            "value": np.concatenate([v for _, _, v in found]),
            "corner": d[np.ix_(*[[0, -1]] * 3)].ravel(),
        }
        one = {n: pa.array([b], pa.int32()) for n, b in zip(BLOCK, at)}
        return pa.table(one | {n: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for n, v in columns.items()})

    n = int(field.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = field.where(grid.contains(F.col("x"), F.col("y"), F.col("z"))).select(*AXES, "d", *(F.shiftright(a, BLOCK_LEVEL).alias(b) for a, b in zip(AXES, BLOCK)))
    return inside.repartition(n, *BLOCK).groupBy(*BLOCK).applyInArrow(block, ", ".join(f"{b} int" for b in BLOCK) + ", " + LEAVES)


def _samples(packed: DataFrame, level: int) -> DataFrame:
    """cx, cy, cz, lo, hi, n: the samples of nodes above blocks that are in blocks with rows. Any other is at the band."""
    across = 1 << (level - BLOCK_LEVEL)
    place = [F.col(b).bitwiseAND(F.lit(across - 1)) for b in BLOCK]
    corner, middle, index = F.lit(True), F.lit(True), F.lit(1)
    for k, p in enumerate(place):
        corner, middle = corner & p.isin(0, across - 1), middle & (p == across // 2)
        index = index + F.when(p == across - 1, 1 << k).otherwise(0)
    nodes = [F.shiftright(b, level - BLOCK_LEVEL).alias(c) for b, c in zip(BLOCK, NODE)]
    values = F.array(F.when(corner, F.element_at("corner", index)), F.when(middle, F.element_at("corner", F.lit(1))))
    rows = packed.where(corner | middle).select(*nodes, F.explode(F.filter(values, lambda v: v.isNotNull())).alias("_v"))
    return rows.groupBy(*NODE).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))


def top_level(grid: Grid) -> int:
    """The level of the root: the least cube of a power of two that holds the lattice."""
    return max(0, max(grid.dims) - 1).bit_length()


def octree(field: DataFrame, grid: Grid, band: float) -> DataFrame:
    """level, cx, cy, cz, value of all leaves: cubes of ``2 ** level`` cells, numbered by their place among such.

    ``field`` has x, y, z, d of one lattice, each cell once; cells without a row, and all outside the lattice, are
    at ``band``. A leaf's value is the mean of its least and greatest sample. The blocks are written
    once, to shared storage, as nodes above and leaves within both need them.
    """
    spark, top = field.sparkSession, top_level(grid)
    folder = shared_folder(spark, "octree")
    _packed(field, top, grid, band).write.parquet(folder)
    packed, far = spark.read.parquet(folder), F.lit(float(band))
    nodes, done = spark.range(1).select(*(F.lit(0).alias(c) for c in NODE)), []
    for level in range(top, BLOCK_LEVEL, -1):
        known = nodes.join(_samples(packed, level), NODE, "left")
        # Of nine samples those without a row are at the band.
        some = F.coalesce(F.col("n"), F.lit(0)) < 9
        lo, hi = F.coalesce(F.when(some, F.least("lo", far)).otherwise(F.col("lo")), far), F.when(some, far).otherwise(F.col("hi"))
        known = known.select(*NODE, lo.alias("lo"), hi.alias("hi"))
        even = _even(F.col("lo"), F.col("hi"), float(grid.res))
        done.append(known.where(even).select(F.lit(level).alias("level"), *NODE, ((F.col("lo") + F.col("hi")) / 2).alias("value")))
        nodes = known.where(~even)
        for c in NODE:
            nodes = nodes.select(*(n for n in NODE if n != c), F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c))
    blocks = nodes.select(*(F.col(c).alias(b) for c, b in zip(NODE, BLOCK))).join(packed, BLOCK, "left")
    alone = F.array(F.struct(F.lit(min(top, BLOCK_LEVEL)).alias("level"), *(F.col(b).alias(c) for b, c in zip(BLOCK, NODE)), far.alias("value")))
    rows = blocks.select(F.inline(F.coalesce(F.arrays_zip("level", *NODE, "value"), alone)))
    for leaves in done:
        rows = rows.unionByName(leaves)
    return rows
