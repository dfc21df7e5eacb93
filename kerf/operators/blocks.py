"""Distances over a lattice, block by block.

A block is ``SIDE`` cells along each axis. What is removed comes as words of bits (see
:mod:`kerf.operators.runs`); a word is one line of a block. Distances are cut at a band or
a radius, so a block needs its own words and those of its surroundings so far: each word
goes to the blocks that it is near to, one exchange of bits, and each block is computed
by itself, as an array, with one pass over its lines for each axis. Cells are rows only
in the result, where they are asked for; work and memory of a task are those of one block
and its surroundings, however many primitives removed them.

A block's result is one row with an array of codes in the order z, y, x: 1 material, 0
material at a surface, -1 - n empty and n steps away from the nearest empty surface cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.grid import AXES, Grid
from kerf.operators.runs import WORD

#: Cells along the edge of a block; as many as a word has, so that a word is a line of one block.
SIDE = WORD
BLOCK = [f"b{n}" for n in AXES]
#: More steps than this don't fit into a code.
MOST_STEPS = 30_000

Array = np.ndarray
Make = Callable[[Array, tuple[slice, slice, slice], tuple[int, int, int]], dict[str, Array]]


def counts(grid: Grid) -> tuple[int, int, int]:
    """Blocks along each axis."""
    return tuple(-(-d // SIDE) for d in grid.dims)


def words_of(cut: DataFrame, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """keys, y, z, w, bits of removed cells (x, y, z); repeated cells count once, those outside the lattice not at all."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(WORD - 1)))
    inside = cut.where(grid.contains(F.col("x"), F.col("y"), F.col("z")))
    return inside.groupBy(*(keys or []), "y", "z", F.shiftright("x", 5).alias("w")).agg(F.bit_or(bit).alias("bits"))


def near_blocks(words: DataFrame, grid: Grid, reach: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bx, by, bz, y, z, w, bits: each word for each block that has some of its cells within ``reach``."""
    last = dict(zip(AXES, (n - 1 for n in counts(grid))))
    span = lambda lo, hi, n: F.explode(F.sequence(F.greatest(F.floor(lo / SIDE).cast("int"), F.lit(0)), F.least(F.floor(hi / SIDE).cast("int"), F.lit(last[n]))))
    rows = words.select(*(keys or []), "y", "z", "w", "bits")
    for n in ("y", "z"):
        rows = rows.withColumn(f"b{n}", span(F.col(n) - reach, F.col(n) + reach, n))
    rows = rows.withColumn("bx", span(F.col("w") * WORD - reach, F.col("w") * WORD + WORD - 1 + reach, "x"))
    # Bits further than the reach from the block go.
    low = F.greatest(F.lit(0), (F.col("bx") - F.col("w")) * WORD - reach)
    high = F.least(F.lit(WORD - 1), (F.col("bx") - F.col("w")) * WORD + SIDE - 1 + reach)
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), high - low + 1) - 1
    rows = rows.withColumn("bits", F.col("bits").bitwiseAND(F.call_function("shiftleft", ones, low)))
    return rows.where(F.col("bits") != 0).select(*(keys or []), *BLOCK, "y", "z", "w", "bits")


def every_block(owners: DataFrame | SparkSession, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """keys and bx, by, bz of all blocks, for each row of ``owners``; of one lattice without keys, for a session."""
    rows = owners.range(1) if isinstance(owners, SparkSession) else owners
    rows = rows.select(*(keys or []), F.explode(F.sequence(F.lit(0), F.lit(counts(grid)[2] - 1))).alias("bz"))
    # Axis by axis: no array is longer than an axis has blocks; the first is dealt before the others follow.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or []), "bz")
    for n, count in (("y", counts(grid)[1]), ("x", counts(grid)[0])):
        rows = rows.withColumn(f"b{n}", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return rows.select(*(keys or []), *BLOCK)


def by_block(near: DataFrame, blocks: DataFrame | None, grid: Grid, reach: int, make: Make, schema: str, keys: list[str] | None = None) -> DataFrame:
    """keys, bx, by, bz and what ``make`` gives for each block of ``near`` (see :func:`near_blocks`) and of ``blocks``.

    ``make`` gets the block with ``reach`` cells around it (z, y, x; 1 material, 0 removed or outside
    the lattice), where the lattice is in it, and its first cell; it returns an array for each column of
    ``schema``, which becomes one row.
    """
    keys = keys or []
    dims, names = grid.dims, [c.split()[0] for c in schema.split(", ")]

    def block(key: tuple, table: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key[-3:]]
        first = [b * SIDE for b in at]
        lo = [f - reach for f in first]
        size = [min(f + SIDE, d) + reach - a for f, d, a in zip(first, dims, lo)]
        within = tuple(slice(max(0, -a), min(d - a, s)) for a, d, s in zip(lo, dims, size))[::-1]
        solid = np.zeros(size[::-1], np.uint8)
        solid[within] = 1
        table = table.filter(pa.compute.is_valid(table["w"]))
        if table.num_rows:
            y, z, w, bits = (table[n].to_numpy() for n in ("y", "z", "w", "bits"))
            w0 = lo[0] // WORD
            gone = np.zeros((size[2], size[1], (lo[0] + size[0] - 1) // WORD - w0 + 1, WORD), np.uint8)
            gone[z - lo[2], y - lo[1], w - w0] = np.unpackbits(bits.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            solid &= 1 - gone.reshape(size[2], size[1], -1)[:, :, lo[0] - w0 * WORD :][:, :, : size[0]]
        made = make(solid, within, tuple(first))
        out = {n: pa.array([k.as_py()], t) for n, k, t in zip([*keys, *BLOCK], key, (k.type for k in key))}
        for n in names:
            values = pa.array(made[n].ravel())
            out[n] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(out)

    rows = near if blocks is None else near.unionByName(blocks, allowMissingColumns=True)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    # Bits are few bytes and much work, so tasks aren't put together by size.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *BLOCK)
    return rows.groupBy(*keys, *BLOCK).applyInArrow(block, ", ".join([f"{n} {types[n]}" for n in (*keys, *BLOCK)] + [schema]))


def _cut(a: Array, by: int, axis: int) -> Array:
    return a[(slice(None),) * axis + (slice(by, a.shape[axis] - by),)]


def _around(a: Array, pick: np.ufunc) -> Array:
    """The least or greatest of each cell's 27, without the outermost cells."""
    for axis in range(3):
        n = a.shape[axis]
        part = lambda k: a[(slice(None),) * axis + (slice(k, n - 2 + k),)]  # noqa: B023, E731
        a = pick(pick(part(0), part(1)), part(2))
    return a


def codes_of(solid: Array, within: tuple[slice, slice, slice], most: int) -> Array:
    """Codes of the cells of ``solid`` (see :func:`by_block`) but the outermost ``most + 1`` on each side."""
    own = solid
    for axis in range(3):
        own = _cut(own, most + 1, axis)
    inner = _around(solid, np.minimum)
    for axis in range(3):
        inner = _cut(inner, most, axis)
    codes = inner.astype(np.int16)
    if own.all():
        return codes
    lattice = np.zeros(solid.shape, bool)
    lattice[within] = True
    core = (slice(1, -1),) * 3
    seeds = (solid[core] == 0) & (_around(solid, np.maximum) == 1) & lattice[core]
    f = np.where(seeds, np.int32(0), np.int32(most))
    for axis in range(3):
        i = np.arange(f.shape[axis], dtype=np.int32).reshape([-1 if k == axis else 1 for k in range(3)])
        up = np.minimum.accumulate(f - i, axis=axis) + i
        down = np.flip(np.minimum.accumulate(np.flip(f + i, axis), axis=axis), axis) - i
        f = _cut(np.minimum(up, down), most, axis)
    return np.where(own == 1, codes, (-1 - np.minimum(f, most)).astype(np.int16))


def most_steps(band: float) -> int:
    """Steps beyond which a value is the band."""
    most = max(1, math.ceil(band))
    if most > MOST_STEPS:
        raise ValueError(f"a band has at most {MOST_STEPS} cells")
    return most


def computed(near: DataFrame, grid: Grid, band: float, keys: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """As :func:`steps`, from words that are with their blocks already (:func:`near_blocks`, within the band's steps and one)."""
    most = most_steps(band)
    return by_block(near, blocks, grid, most + 1, lambda solid, within, first: {"codes": codes_of(solid, within, most)}, "codes array<smallint>", keys)


def steps(words: DataFrame, grid: Grid, band: float, keys: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """keys, bx, by, bz, codes of each block that is near to removed cells, and of ``blocks``."""
    return computed(near_blocks(words, grid, most_steps(band) + 1, keys), grid, band, keys, blocks)


def _each_cell(packed: DataFrame, grid: Grid, codes: str, *keep: str) -> DataFrame:
    """A row for each cell: columns ``keep``, x, y, z and ``_code``."""
    size = {f"_s{n}": F.least(F.lit(SIDE), F.lit(d) - F.col(f"b{n}") * SIDE) for n, d in zip(AXES, grid.dims)}
    rows = packed.withColumns(size).select(*keep, *BLOCK, *size, F.posexplode(codes).alias("_p", "_code"))
    place = {
        "x": F.col("bx") * SIDE + F.col("_p") % F.col("_sx"),
        "y": F.col("by") * SIDE + F.expr("_p div _sx").cast("int") % F.col("_sy"),
        "z": F.col("bz") * SIDE + F.expr("_p div (_sx * _sy)").cast("int"),
    }
    return rows.select(*keep, *(c.cast("int").alias(n) for n, c in place.items()), "_code")


def value(code: Column, grid: Grid, band: float) -> Column:
    """Millimetres of a code."""
    held = lambda v: F.least(F.lit(float(band)), v)
    away = F.lit(-1.0) - code.cast("double") + F.lit(0.1)
    return F.when(code == 1, held(F.lit(0.5))).when(code == 0, held(F.lit(0.1))).otherwise(-held(away)) * float(grid.res)


def cells(packed: DataFrame, grid: Grid, band: float, keys: list[str] | None = None) -> DataFrame:
    """keys, x, y, z, d of each cell of the blocks of :func:`steps`."""
    rows = _each_cell(packed, grid, "codes", *(keys or []))
    return rows.select(*(keys or []), *AXES, value(F.col("_code"), grid, band).alias("d"))


def field(words: DataFrame, grid: Grid, band: float, keys: list[str] | None = None, owners: DataFrame | None = None) -> DataFrame:
    """keys, x, y, z, d of all cells, as :func:`kerf.operators.sdf.from_cells` has them.

    With ``keys``, the lattices are those of ``owners``, a row for each, by default those of ``words``; a
    lattice without words is solid.
    """
    if keys:
        owners = (words if owners is None else owners).select(*keys).distinct()
    blocks = every_block(owners if keys else words.sparkSession, grid, keys)
    return cells(steps(words, grid, band, keys, blocks), grid, band, keys)


def _nearest(solid: Array, within: tuple[slice, slice, slice], first: tuple[int, int, int], radius: int) -> dict[str, Array]:
    """Square of the distance to the nearest surface cell and its number in the block and its surroundings; -1 without one.

    One axis after the other: of the lines beside a cell's, each has its own nearest already, so
    a cell takes the best of ``2 * radius + 1`` along the axis. Of equals the first along the axis
    stays, and axes go x, y, z, which is the first by z, y, x over all.
    """
    lattice = np.zeros(solid.shape, bool)
    lattice[within] = True
    core = (slice(1, -1),) * 3
    surface = np.zeros(solid[core].shape, bool)
    for axis in range(3):
        for k in (0, 2):
            beside = tuple(slice(k, solid.shape[a] - 2 + k) if a == axis else slice(1, -1) for a in range(3))
            surface |= (solid[beside] != solid[core]) | ~lattice[beside]
    surface &= lattice[core]
    number = np.arange(surface.size, dtype=np.int64).reshape(surface.shape)
    none = np.iinfo(np.int32).max
    best, at = np.where(surface, 0, none).astype(np.int64), np.where(surface, number, -1)
    for axis in (2, 1, 0):
        n = best.shape[axis] - 2 * radius
        part = lambda a, k: a[(slice(None),) * axis + (slice(k, k + n),)]  # noqa: B023, E731
        new, place = np.full(part(best, 0).shape, none, np.int64), np.full(part(at, 0).shape, -1, np.int64)
        for k in range(2 * radius + 1):
            d2 = part(best, k) + (k - radius) ** 2
            better = (part(at, k) >= 0) & (d2 < new)
            new[better], place[better] = d2[better], part(at, k)[better]
        best, at = new, place
    z, y, x = np.unravel_index(np.maximum(at, 0), surface.shape)
    own = solid
    for axis in range(3):
        own = _cut(own, radius + 1, axis)
    found = at >= 0
    place = {f"s{n}": np.where(found, v + f - radius, -1).astype(np.int32) for n, v, f in zip(AXES, (x, y, z), first)}
    return {"material": own == 1, "d2": np.where(found, best, -1).astype(np.int32), **place}


def nearest(words: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """x, y, z, material, d2, sx, sy, sz of all cells of one lattice: squared steps to the nearest surface cell within ``radius`` along each axis, and which; -1 without one."""
    names = {"material": "boolean", "d2": "int", **{f"s{n}": "int" for n in AXES}}
    near = near_blocks(words, grid, radius + 1)
    schema = ", ".join(f"{n} array<{t}>" for n, t in names.items())
    packed = by_block(near, every_block(words.sparkSession, grid), grid, radius + 1, lambda solid, within, first: _nearest(solid, within, first, radius), schema)
    rows = _each_cell(packed.withColumn("_all", F.arrays_zip(*names)), grid, "_all")
    return rows.select(*AXES, *(F.col("_code")[n].alias(n) for n in names))
