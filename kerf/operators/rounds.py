"""First cuts of long jobs, in rounds of commands: what is gone isn't tested again.

A cell goes once, so most commands of a long job pass through places that are empty. A job
is taken in rounds, each ``GROWTH`` times as long as all before it. What rounds before
removed is known as blocks of cells, ``EDGE`` a side, of which nothing is left; boxes of
primitives are cut into such blocks, and those that are gone are dropped where primitives
are made, before anything is dealt. All that is dropped was removed by earlier commands,
so the result is the same wherever rounds end, and every command is looked at. As rounds
grow by a factor, a cell is tested a few times and not once a command.

Rounds before the last, and commands, are written to shared storage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.functions.gcode import bound
from kerf.grid import AXES, Grid
from kerf.operators import runs
from kerf.storage import shared_folder

#: About as many commands of a job are in its first round.
FIRST = 1024
#: A round is about this many times as long as those before it together.
GROWTH = 16
#: Cells along the edge of a block. A word holds a whole number of them.
EDGE = 4
#: At most so many sums of a job, and of all jobs together, by which boxes are looked up: they are sent to all tasks.
SUMS, ALL_SUMS = 1 << 15, 1 << 23
#: Added to the box of a command, as points along its way are rounded.
SLACK = 1e-6
WORD_KEY = ["job_id", "y", "z", "w"]


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """By equal keys, of which only those of ``a`` stay; a job may be null."""
    same = reduce(lambda c, d: c & d, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return a.join(b.withColumnsRenamed({k: f"_of_{k}" for k in keys}), same, how).drop(*(f"_of_{k}" for k in keys))


def _numbered(rows: DataFrame, ends: DataFrame, rounds: int) -> DataFrame:
    """``rows`` with ``_round``, from 0, by the share of the job's numbers of ``seq`` up to a row; never less for a greater ``seq``."""
    share = (F.col("seq").cast("double") - F.col("_lo") + 1) / (F.col("_hi") - F.col("_lo") + 1)
    after = (F.when(share > float(GROWTH) ** (k + 1 - rounds), 1).otherwise(0) for k in range(rounds - 1))
    return _joined(rows, ends, ["job_id"], "inner").withColumn("_round", sum(after, F.lit(0))).drop("_lo", "_hi")


def _block(grid: Grid, at: list[Column]) -> Column:
    nx, ny, _ = (-(-n // EDGE) for n in grid.dims)
    return at[0].cast("long") + at[1].cast("long") * nx + at[2].cast("long") * (nx * ny)


def gone_blocks(gone: DataFrame, grid: Grid) -> DataFrame:
    """job_id, block: blocks without a cell left, of words (job_id, y, z, w, bits), each once."""
    nx, full = grid.dims[0], (1 << EDGE) - 1
    each, last = runs.WORD // EDGE, (nx - 1) // EDGE

    def part(k: int) -> Column:
        bx = F.col("w") * each + k
        # The last block along x may be cut off by the lattice's end.
        need = F.when(bx == last, (1 << (nx - last * EDGE)) - 1).otherwise(full)
        return F.when((bx <= last) & (F.shiftright("bits", EDGE * k).bitwiseAND(F.lit(full).cast("long")) == need), bx)

    lines = gone.select("job_id", "y", "z", F.explode(F.filter(F.array(*(part(k) for k in range(each))), lambda v: v.isNotNull())).alias("_bx"))
    by, bz = F.shiftright("y", EDGE.bit_length() - 1), F.shiftright("z", EDGE.bit_length() - 1)
    held = [F.least(F.lit(EDGE), F.lit(n) - b * EDGE) for n, b in zip(grid.dims[1:], (by, bz))]
    lines = lines.select("job_id", _block(grid, [F.col("_bx"), by, bz]).alias("block"), (held[0] * held[1]).alias("_need"))
    return lines.groupBy("job_id", "block").agg(F.count("*").alias("_n"), F.first("_need").alias("_need")).where(F.col("_n") == F.col("_need")).select("job_id", "block")


def open_boxes(boxed: DataFrame, gone: DataFrame, grid: Grid) -> DataFrame:
    """``boxed`` (see :func:`kerf.operators.lattice.index_box`) cut into blocks, without those of :func:`gone_blocks`."""
    rows = boxed
    for a in AXES:
        first, last = (F.floor(F.col(f"{e}_{a}") / EDGE).cast("int") for e in ("lo", "hi"))
        rows = rows.withColumn(f"_b{a}", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("block", _block(grid, [F.col(f"_b{a}") for a in AXES]))
    rows = _joined(rows, gone, ["job_id", "block"], "left_anti")
    clipped = {}
    for a in AXES:
        clipped[f"lo_{a}"] = F.greatest(F.col(f"lo_{a}"), F.col(f"_b{a}") * EDGE)
        clipped[f"hi_{a}"] = F.least(F.col(f"hi_{a}"), F.col(f"_b{a}") * EDGE + EDGE - 1)
    return rows.withColumns(clipped).select(*boxed.columns)


def _strides(grid: Grid, bits: int) -> list[int]:
    """By how many bits corners along y and z are shifted in the array of sums, and its length."""
    nx, ny, nz = (-(-n >> bits) for n in grid.dims)
    sy, sz = nx.bit_length(), nx.bit_length() + ny.bit_length()
    return [sy, sz, nz + 1 << sz]


def node_bits(grid: Grid, jobs: int) -> int | None:
    """A node is 2^bits cells a side, the fewest by which sums stay within bounds; None where they can't."""
    most = min(SUMS, ALL_SUMS // max(jobs, 1))
    return next((k for k in range(31) if _strides(grid, k)[2] <= most), None)


def left_sums(gone: DataFrame, grid: Grid, bits: int) -> DataFrame:
    """job_id, sums: for each corner of nodes, how many nodes below it have something left, of words as for :func:`gone_blocks`.

    Whole numbers far below 2^24, as floats: these are added without a test for overflow.
    """
    edge, width = 1 << bits, min(runs.WORD, 1 << bits)
    dims, (sy, sz, _) = [-(-n >> bits) for n in grid.dims], _strides(grid, bits)
    parts = (F.struct(F.lit(k).alias("_k"), F.bit_count(F.shiftright("bits", width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).alias("_n")) for k in range(runs.WORD // width))
    rows = gone.select("job_id", "y", "z", "w", F.inline(F.filter(F.array(*parts), lambda v: v["_n"] > 0)))
    node = [F.shiftright(c, bits) for c in (F.col("w") * runs.WORD + F.col("_k") * width, F.col("y"), F.col("z"))]
    rows = rows.groupBy("job_id", *(c.alias(n) for c, n in zip(node, AXES))).agg(F.sum(F.col("_n").cast("long")).alias("_n"))
    size = reduce(lambda a, b: a * b, (F.least(F.lit(edge), F.lit(n) - F.col(a) * edge).cast("long") for a, n in zip(AXES, grid.dims)))

    def summed(key: tuple, nodes: pa.Table) -> pa.Table:
        left = np.zeros((dims[2] + 1, 1 << sz - sy, 1 << sy), np.float32)
        left[1:, 1 : dims[1] + 1, 1 : dims[0] + 1] = 1
        left[tuple(nodes[n].to_numpy() + 1 for n in "zyx")] = 0
        for axis in range(3):
            np.cumsum(left, axis, out=left)
        sums = pa.ListArray.from_arrays(pa.array([0, left.size], pa.int32()), pa.array(left.ravel()))
        return pa.table({"job_id": pa.array([key[0].as_py()], pa.int64()), "sums": sums})

    # Of a job these are fewer rows than SUMS.
    return rows.where(F.col("_n") == size).select("job_id", *AXES).groupBy("job_id").applyInArrow(summed, "job_id long, sums array<float>")


def with_left(boxed: DataFrame, sums: DataFrame, grid: Grid, bits: int) -> DataFrame:
    """Rows whose box lo_x .. hi_z of cells has a node in which something is left, by :func:`left_sums`; a job without sums has all of it.

    Corners come first, behind a generator of one row, and places in the array are put
    together by bits: the JVM doesn't compile methods of more than 8,000 bytes.
    """
    at = zip(AXES, (0, *_strides(grid, bits)[:2]))
    shifted = lambda c, by: F.call_function("shiftleft", c, F.lit(by))
    ends = {f"_{a}{e}": shifted(c, by) for a, by in at for e, c in enumerate((F.shiftright(f"lo_{a}", bits), F.shiftright(f"hi_{a}", bits) + 1))}
    rows = _joined(bound(boxed, **ends), F.broadcast(sums), ["job_id"], "left")
    more, less = ([F.get("sums", F.col(f"_x{i}").bitwiseOR(F.col(f"_y{j}")).bitwiseOR(F.col(f"_z{k}"))) for i in (0, 1) for j in (0, 1) for k in (0, 1) if (i + j + k) % 2 == odd] for odd in (1, 0))
    some = reduce(lambda a, b: a + b, more) > reduce(lambda a, b: a + b, less)
    return rows.where(F.col("sums").isNull() | some).select(*boxed.columns)


def _within_reach(rows: DataFrame, reach: tuple[g.Point, g.Point], grid: Grid, some: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` of which ``some`` leaves the box of cells between two points."""
    names, boxed = rows.columns, rows
    for k, n in enumerate(AXES):
        lo, hi = grid.index(reach[0][k] - SLACK, k), grid.index(reach[1][k] + SLACK, k)
        boxed = boxed.withColumns({f"lo_{n}": F.greatest(F.lit(0), lo), f"hi_{n}": F.least(F.lit(grid.dims[k] - 1), hi)})
    touched = reduce(lambda a, b: a & b, (F.col(f"lo_{n}") <= F.col(f"hi_{n}") for n in AXES))
    return some(boxed.where(touched)).select(*names)


def _left(cuts: DataFrame, gone: DataFrame) -> DataFrame:
    """``cuts`` without cells of ``gone``: blocks of which something is left were tested whole."""
    old = gone.select(*WORD_KEY, F.col("bits").alias("_old"))
    rows = _joined(cuts, old, WORD_KEY, "left")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))
    return rows.select("job_id", "seq", "y", "z", "w", bits.alias("bits")).where(F.col("bits") != 0)


def _asked(gone: DataFrame, grid: Grid, bits: int | None, path: str) -> Callable[[DataFrame], DataFrame]:
    """Boxes without those of which nothing is left; all of them where sums would be too many."""
    if bits is None:
        return lambda boxed: boxed
    left_sums(gone, grid, bits).write.parquet(path)
    sums = gone.sparkSession.read.parquet(path)
    return lambda boxed: with_left(boxed, sums, grid, bits)


def _dealt(rows: DataFrame) -> DataFrame:
    """A round's commands stand in few files, and one makes many primitives."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id", "seq")


def first_cuts(
    rows: DataFrame, primitives: Callable[[DataFrame], DataFrame], grid: Grid, make: Callable[..., DataFrame] = runs.tested, first: int = FIRST, reach: tuple[g.Point, g.Point] | None = None
) -> DataFrame:
    """As :func:`kerf.operators.runs.first_cuts`, of what ``primitives`` makes of ``rows`` (job_id, seq and more).

    ``make`` is ``runs.tested`` or ``runs.words``; ``first`` is about the length of a job's first round.
    ``reach``, if given, is the least and the greatest point that primitives of a row touch, by its columns.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "rounds")
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    ends = rows.groupBy("job_id").agg(F.min("seq").cast("double").alias("_lo"), F.max("seq").cast("double").alias("_hi"), F.count("*").alias("_n"))
    # Read again, its size is known: by what an aggregate may have, Spark would send all commands of a job to one task.
    ends.write.parquet(f"{folder}/ends")
    ends = spark.read.parquet(f"{folder}/ends")
    longest, jobs = ends.agg(F.max("_n"), F.count("*")).first()
    rounds = 1
    while first * GROWTH ** (rounds - 1) < (longest or 0):
        rounds += 1
    bits = node_bits(grid, jobs)
    rows, done, gone = _numbered(rows, ends.drop("_n"), rounds), [], None
    for k in range(rounds):
        now = rows.where(F.col("_round") == k).drop("_round")
        if gone is None:
            cuts = runs.first_cuts(make(primitives(_dealt(now)), grid))
        else:
            some, blocks = _asked(gone, grid, bits, f"{folder}/left-{k}"), gone_blocks(gone, grid)
            if reach is not None:
                now = _within_reach(now, reach, grid, some)
            cuts = _left(runs.first_cuts(make(primitives(_dealt(now)), grid, lambda boxed: some(open_boxes(some(boxed), blocks, grid)))), gone)
        done.append(f"{folder}/round-{k}")
        cuts.write.parquet(done[-1])
        gone = runs.union(spark.read.parquet(*done))
    return spark.read.parquet(*done)
