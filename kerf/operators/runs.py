"""Removed cells as words of bits, united and told apart bit by bit.

A word is ``WORD`` cells along x. A union is a bitwise or, the cells that a command is
the first to remove are its bits without those before, and counts and boxes come from the
bits. Cells are listed only where they are asked for.

There are two ways from primitives to words. :func:`tested` tests each cell of each box,
as :mod:`kerf.operators.lattice` does, and puts what is inside into words where the tiles
were dealt. :func:`words` tests almost none: spheres, cylinders and capsules are convex,
so what one takes of a line of cells along x is a run, whose ends follow from the shape;
only a cell whose centre lies so near the surface that rounding could decide is tested.
Runs pay where tools are many cells wide, about a hundred; both give the same words.

Primitives are dealt by tiles or squares of lines and by slices of ``seq``, so no task
gets all that ever cut a place. Each slice keeps its first cuts, at most ``WORD`` rows a
word, and only these are exchanged and put in order over all slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.functions.gcode import bound
from kerf.grid import AXES, Grid
from kerf.operators.lattice import SLICE_BITS, TILE, cells_in_boxes, index_box, inside

#: Cells of a word. Fewer than a long has bits, so that words are never negative.
WORD = 32
#: An end within this share of a cell from a cell's centre is tested.
TIE = 1e-4
#: Below this an axis counts as almost along or across x, and each cell of the line is tested.
SLIGHT = 1e-6


def _ends(rows: DataFrame, grid: Grid) -> DataFrame:
    """``rows`` with ``_low`` and ``_high``: where the line y, z of cells enters and leaves the primitive, in cells; null where it misses.

    One step after the other, so that each value is computed once.
    """
    slack = F.lit(1e-9 * grid.res * grid.res)
    r2, axis, zero, far = F.col("r") * F.col("r"), F.col("axis"), F.lit(0.0), F.lit(1e9)
    ux, uy, uz = g.point("u")
    y, z = grid.world(F.col("y"), 1), grid.world(F.col("z"), 2)
    root = lambda v: F.when(v >= -slack, F.sqrt(F.greatest(v, zero)))
    rows = rows.withColumns(dict(_dy=y - F.col("ay"), _dz=z - F.col("az"), _ey=y - F.col("by"), _ez=z - F.col("bz")))
    dy, dz, ey, ez = (F.col(n) for n in ("_dy", "_dz", "_ey", "_ez"))
    rows = rows.withColumns(dict(_k=uy * dy + uz * dz, _d2=dy * dy + dz * dz, _a=uy * uy + uz * uz, _hb=root(r2 - (ey * ey + ez * ez))))
    k, a, d2 = F.col("_k"), F.col("_a"), F.col("_d2")
    rows = rows.withColumns(dict(_ha=root(r2 - d2), _b=-ux * k, _c=d2 - k * k - r2))
    b, c = F.col("_b"), F.col("_c")
    rows = rows.withColumns(dict(_root=root(b * b - a * c), _s=F.try_divide(-g.END_TOLERANCE - k, ux), _t=F.try_divide(axis + g.END_TOLERANCE - k, ux)))
    # Along x the line is in or out as a whole; across x its place along the axis is the same everywhere.
    wall = lambda sign: F.when(a == 0, F.when(c <= slack, sign * far)).otherwise((sign * F.col("_root") - b) / a)
    within = (k >= -g.END_TOLERANCE) & (k <= axis + g.END_TOLERANCE)
    cap = lambda sign, v: F.when(ux == 0, F.when(within, sign * far)).otherwise(v)
    less, more = F.lit(-1.0), F.lit(1.0)
    rows = rows.withColumns(dict(_w0=wall(less), _w1=wall(more), _c0=cap(less, F.least("_s", "_t")), _c1=cap(more, F.greatest("_s", "_t"))))
    rows = rows.withColumns(dict(_low=F.greatest("_w0", "_c0"), _high=F.least("_w1", "_c1"), _some=F.col("_w0").isNotNull() & F.col("_c0").isNotNull()))
    some = F.col("_some") & (F.col("_low") <= F.col("_high") + SLIGHT * grid.res)
    parts = {"_l": F.when(some, F.col("ax") + F.col("_low")), "_h": F.when(some, F.col("ax") + F.col("_high"))}
    rows = rows.withColumns(parts)
    rows = rows.withColumns({
        n: F.when(F.col("point"), F.col("ax") + s * F.col("_ha")).when(F.col("shape") == "capsule", f(v, F.col("ax") + s * F.col("_ha"), F.col("bx") + s * F.col("_hb"))).otherwise(F.col(v))
        for n, v, s, f in (("_from", "_l", less, F.least), ("_to", "_h", more, F.greatest))
    })
    place = lambda v: (F.col(v) - F.lit(float(grid.lo[0]))) / F.lit(float(grid.res)) - 0.5
    return rows.withColumns({"_low": place("_from"), "_high": place("_to")})


def runs(boxed: DataFrame, grid: Grid) -> DataFrame:
    """Columns of ``boxed`` (see :func:`kerf.operators.lattice.index_box`) with y, z, first, last: cells of each line in each box."""
    n = int(boxed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = boxed.withColumn("_slice", F.shiftright("seq", SLICE_BITS))
    for a in AXES[1:]:
        rows = rows.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / TILE).cast("int"), F.floor(F.col(f"hi_{a}") / TILE).cast("int"))))
    rows = rows.repartition(n, "job_id", "_ty", "_tz", "_slice")
    for a in AXES[1:]:
        rows = rows.withColumn(a, F.explode(F.sequence(F.greatest(f"lo_{a}", F.col(f"_t{a}") * TILE), F.least(F.col(f"hi_{a}"), F.col(f"_t{a}") * TILE + TILE - 1))))
    along, across = F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"), F.abs("ux")
    slight = ~F.col("point") & ((along > 0) & (along < SLIGHT) | (across > 0) & (across < SLIGHT))
    rows = _ends(rows, grid).withColumns({"_slight": slight, "_lo": F.rint("_low"), "_hi": F.rint("_high")})
    lo, hi = F.col("_low"), F.col("_high")
    rows = rows.withColumns({"_at_lo": F.abs(lo - F.col("_lo")) < TIE, "_at_hi": F.abs(hi - F.col("_hi")) < TIE})
    run = lambda first, last, a, b: F.struct(first.cast("int").alias("_first"), last.cast("int").alias("_last"), a.alias("_at"), b.alias("_bt"))
    whole = run(F.when(F.col("_at_lo"), F.col("_lo")).otherwise(F.ceil(lo)), F.when(F.col("_at_hi"), F.col("_hi")).otherwise(F.floor(hi)), F.col("_at_lo"), F.col("_at_hi"))
    each = F.transform(F.sequence("lo_x", "hi_x"), lambda x: run(x, x, F.lit(True), F.lit(True)))
    rows = rows.select("*", F.inline(F.when(F.col("_slight"), each).when(lo.isNotNull() & hi.isNotNull(), F.array(whole))))
    # Most ends aren't tested: the test stands behind the condition.
    out = lambda c: ~F.coalesce(inside(grid, F.col(c)), F.lit(False))
    rows = rows.withColumn("_f", F.when(F.col("_at") & out("_first"), F.col("_first") + 1).otherwise(F.col("_first")))
    # Behind a generator of one row, so that the filter doesn't compute them again.
    rows = bound(rows, first=F.greatest("_f", "lo_x"), last=F.least(F.when(F.col("_bt") & out("_last"), F.col("_last") - 1).otherwise(F.col("_last")), F.col("hi_x")))
    return rows.where(F.col("first") <= F.col("last"))


def _shift(v: Column, by: Column) -> Column:
    return F.call_function("shiftleft", v, by)


def words(primitives: DataFrame, grid: Grid, some: Callable[[DataFrame], DataFrame] = lambda boxed: boxed) -> DataFrame:
    """job_id, seq, y, z, w, bits of each run (with _ty, _tz, _slice, by which rows are dealt): bit k of word w is cell 32 * w + k along x.

    ``some`` may take boxes in parts, or leave out those that can't matter.
    """
    rows = runs(some(index_box(primitives, grid)), grid)
    rows = rows.select("job_id", "_ty", "_tz", "_slice", "seq", "y", "z", "first", "last", F.explode(F.sequence(F.shiftright("first", 5), F.shiftright("last", 5))).alias("w"))
    low, high = F.greatest(F.col("first") - F.col("w") * WORD, F.lit(0)), F.least(F.col("last") - F.col("w") * WORD, F.lit(WORD - 1))
    bits = _shift(_shift(F.lit(1).cast("long"), high - low + 1) - 1, low)
    return rows.select("job_id", "_ty", "_tz", "_slice", "seq", "y", "z", "w", bits.alias("bits"))


def tested(primitives: DataFrame, grid: Grid, some: Callable[[DataFrame], DataFrame] = lambda boxed: boxed) -> DataFrame:
    """As :func:`words`, by a test of each cell; tiles along x as well."""
    cells_ = cells_in_boxes(some(index_box(primitives, grid))).where(inside(grid))
    bit = _shift(F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(WORD - 1)))
    return cells_.select("job_id", F.col("ty").alias("_ty"), F.col("tz").alias("_tz"), F.shiftright("seq", SLICE_BITS).alias("_slice"), "tx", "seq", "y", "z", F.shiftright("x", 5).alias("w"), bit.alias("bits"))


def union(words_: DataFrame) -> DataFrame:
    """job_id, y, z, w, bits: all removed cells of :func:`words` or :func:`tested`."""
    return words_.groupBy("job_id", "y", "z", "w").agg(F.bit_or("bits").alias("bits"))


def _fresh(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each word the bits that no row before has; rows without such bits go."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.bit_or("bits").over(w), F.lit(0).cast("long"))
    return rows.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(old))).where(F.col("bits") != 0)


def first_cuts(words_: DataFrame) -> DataFrame:
    """job_id, seq, y, z, w, bits: the cells that each command was the first to remove."""
    own = [c for c in ("job_id", "tx", "_ty", "_tz", "_slice", "y", "z", "w") if c in words_.columns]
    # Parts of a command are united and slices reduced where the rows were dealt.
    rows = words_.groupBy(*own, "seq").agg(F.bit_or("bits").alias("bits"))
    rows = _fresh(rows, own).select("job_id", "seq", "y", "z", "w", "bits")
    return _fresh(rows, ["job_id", "y", "z", "w"]).select("job_id", "seq", "y", "z", "w", "bits")


def cells(cuts: DataFrame) -> DataFrame:
    """job_id, x, y, z, first_cut: the words of :func:`first_cuts` as cells."""
    each = cuts.select("job_id", "seq", "y", "z", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("_k"))
    has = F.call_function("shiftright", F.col("bits"), F.col("_k")).bitwiseAND(F.lit(1).cast("long")) == 1
    return each.where(has).select("job_id", (F.col("w") * WORD + F.col("_k")).alias("x"), "y", "z", F.col("seq").alias("first_cut"))


def after(cuts: DataFrame, seq: int) -> DataFrame:
    """What of :func:`first_cuts` is removed once the command ``seq`` is done."""
    return cuts.where(F.col("seq") <= seq)


def count(rows: DataFrame) -> DataFrame:
    """Per job: removed cells of words that don't overlap."""
    return rows.groupBy("job_id").agg(F.sum(F.bit_count("bits").cast("long")).alias("cells"))


def material_count(rows: DataFrame, grid: Grid) -> DataFrame:
    """Per job: cells removed and left, by counting bits."""
    return count(rows).select("job_id", F.col("cells").alias("removed"), (F.lit(grid.cells).cast("long") - F.col("cells")).alias("remaining"))


def changed_region(cuts: DataFrame) -> DataFrame:
    """Per job and command: the exact index box of cells that it was the first to remove, from the ends of words."""
    bits = F.col("bits")
    lowest = F.bit_count(bits.bitwiseAND(-bits) - 1)
    filled = bits
    for k in (1, 2, 4, 8, 16):
        filled = filled.bitwiseOR(F.shiftright(filled, k))
    rows = cuts.select("job_id", "seq", "y", "z", (F.col("w") * WORD + lowest).alias("_x0"), (F.col("w") * WORD + F.bit_count(filled) - 1).alias("_x1"), F.bit_count(bits).cast("long").alias("_n"))
    return rows.groupBy("job_id", "seq").agg(
        F.min("_x0").alias("min_x"), F.min("y").alias("min_y"), F.min("z").alias("min_z"),
        F.max("_x1").alias("max_x"), F.max("y").alias("max_y"), F.max("z").alias("max_z"), F.sum("_n").alias("cells"),
    )
