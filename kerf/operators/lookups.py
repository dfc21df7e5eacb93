"""Values and gradients of a field at points, from blocks that are computed where points are.

Points find their block by its number; only blocks that some point is in are computed, with three
cells around them, so that a block's row has all nodes of its points. Each point is a row and
meets one row, where :func:`kerf.operators.sdf.gradient` sends 32 nodes to the field and groups them.
Points whose nodes the lattice doesn't hold are outside it, and their nodes' values follow from
their places alone.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.grid import AXES, Grid
from kerf.operators import blocks, sdf
from kerf.operators.blocks import BLOCK, SIDE

#: Cells around a block that its points' nodes may be in, of points up to two cells before the lattice and one behind it.
MARGIN = 3


def _values(words: DataFrame, at: DataFrame, grid: Grid, band: float) -> DataFrame:
    """bx, by, bz, values: the blocks of ``at`` and the cells around them, in millimetres, in the order z, y, x."""
    most, res = blocks.most_steps(band), float(grid.res)
    reach = most + 1 + MARGIN

    def make(solid: np.ndarray, within: tuple[slice, slice, slice], first: tuple[int, int, int]) -> dict[str, np.ndarray]:
        code = blocks.codes_of(solid, within, most)
        held = np.minimum(np.where(code > 0, 0.5, np.where(code == 0, 0.1, (-1.0 - code) + 0.1)), float(band))
        d = np.where(code < 0, -held, held) * res
        square, outside = 0.0, False
        for axis, k in enumerate((2, 1, 0)):
            cell = np.arange(d.shape[axis]) + first[k] - MARGIN
            w = grid.lo[k] + (cell + 0.5) * res
            shape = [-1 if a == axis else 1 for a in range(3)]
            over = np.maximum(0.0, np.maximum(grid.lo[k] - w, w - grid.hi[k])).reshape(shape)
            square, outside = square + over * over, outside | ((cell < 0) | (cell >= grid.dims[k])).reshape(shape)
        return {"values": np.where(outside, -np.minimum(float(band), np.sqrt(square)), d)}

    near = blocks.near_blocks(words, grid, reach).join(at, BLOCK, "left_semi")
    return blocks.by_block(near, at, grid, reach, make, "values array<double>")


def _met(points: DataFrame, words: DataFrame, grid: Grid, band: float, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Points of which a node may be in the lattice with their block's values and ``_at``, and all others as they came."""
    cell = {f"_c{n}": F.floor((F.col(f"w{n}") - F.lit(float(grid.lo[k]))) / F.lit(float(grid.res))) for k, n in enumerate(AXES)}
    known = F.lit(True)
    for k, n in enumerate(AXES):
        known = known & cell[f"_c{n}"].between(-2, grid.dims[k])
    known = F.coalesce(known, F.lit(False))
    based = sdf._based(points.where(known), grid, keys)
    based = based.withColumns({b: F.shiftright(F.greatest(F.lit(0), F.least(F.col(f"_i{n}"), F.lit(d - 1))), SIDE.bit_length() - 1) for n, b, d in zip(AXES, BLOCK, grid.dims)})
    wide = {n: F.least(F.lit(SIDE), F.lit(d) - F.col(b) * SIDE) + 2 * MARGIN for n, b, d in zip(AXES, BLOCK, grid.dims)}
    local = {n: F.col(f"_i{n}") - F.col(b) * SIDE + MARGIN for n, b in zip(AXES, BLOCK)}
    based = based.withColumns({"_sx": wide["x"], "_sxy": wide["x"] * wide["y"], "_at": (local["z"] * wide["y"] + local["y"]) * wide["x"] + local["x"]})
    return based.join(_values(words, based.select(*BLOCK).distinct(), grid, band), BLOCK), points.where(~known)


def _node(x: int, y: int, z: int) -> Column:
    return F.get("values", F.col("_at") + x + F.col("_sx") * y + F.col("_sxy") * z)


def sample(points: DataFrame, words: DataFrame, grid: Grid, band: float = sdf.BAND, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """As :func:`kerf.operators.sdf.sample`, of the field that is left by removed ``words`` (y, z, w, bits) of one lattice. Points with a null are outside."""
    met, others = _met(points, words, grid, band, keys)
    d = F.lit(0.0)
    for at in product((0, 1), repeat=3):
        weight = F.lit(1.0)
        for o, n in zip(at, AXES):
            weight = weight * sdf._weight(n, o)
        d = d + weight * _node(*at)
    return sdf._each_row(met.select("_key", d.alias("d")), keys, F.col("d")).unionByName(sdf.sample(others, _nowhere(words), grid, band, keys))


def gradient(points: DataFrame, words: DataFrame, grid: Grid, band: float = sdf.BAND, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """As :func:`kerf.operators.sdf.gradient`, of the field that is left by removed ``words`` of one lattice."""
    met, others = _met(points, words, grid, band, keys)
    slopes = []
    for k, n in enumerate(AXES):
        beside, slope = [m for m in AXES if m != n], F.lit(0.0)
        for at in product((0, 1), repeat=2):
            node = dict(zip(beside, at))
            step = lambda o: _node(**{**node, n: o})  # noqa: B023, E731
            along = (1 - F.col(f"_t{n}")) * (step(1) - step(-1)) + F.col(f"_t{n}") * (step(2) - step(0))
            slope = slope + along * sdf._weight(beside[0], at[0]) * sdf._weight(beside[1], at[1])
        slopes.append((slope / (2 * float(grid.res))).alias(f"_g{n}"))
    unit = g.normalized(g.point("_g"), g.const(0, 1, 0), 1e-6)
    rows = sdf._each_row(met.select("_key", *slopes), keys, *(c.alias(f"g{n}") for c, n in zip(unit, AXES)))
    return rows.unionByName(sdf.gradient(others, _nowhere(words), grid, band, keys))


def _nowhere(words: DataFrame) -> DataFrame:
    """A field without rows: no node of the other points is in the lattice."""
    return words.sparkSession.createDataFrame([], "x int, y int, z int, d double")
