"""Toolpaths that arrive over time.

Removal is monotone, so a micro-batch only adds: its removed cells are kept as they come
and merged by the least ``seq`` where they are read. What a program's lines leave behind from batch to batch, the modal
position, is the only state that has to be ordered; it is kept by job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerf.grid import AXES, Grid
from kerf.operators import blocks, lattice, sdf

WORDS = "job_id long, seq long, code int, x double, y double, z double, f double"
MODAL = "job_id long, seq long, kind string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, feed double"


def modal_stream(words: DataFrame, start: tuple[float, float, float] = (0.0, 0.0, 0.0), idle_ms: int | None = None) -> DataFrame:
    """Segments from a stream of rows as :data:`WORDS`; positions survive from batch to batch.

    Rows of a job must come in batches in the order of ``seq``; within a batch they are
    sorted. With ``idle_ms``, a job without rows for so long is over: its position is
    forgotten, and if more rows come it begins at ``start`` again.
    """
    names = [c.split()[0] for c in MODAL.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = pd.Series(list(state.get) if state.exists else list(start), index=list(AXES), dtype="float64")
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        # The position before the first row fills what no row of the batch has said yet.
        ends = pd.concat([at.to_frame().T, rows[list(AXES)].astype("float64")], ignore_index=True).ffill()
        rapid = (rows["code"] == 0).to_numpy()
        out = pd.DataFrame({"job_id": key[0], "seq": rows["seq"].to_numpy(), "kind": np.where(rapid, "G0", "G1")})
        for n in AXES:
            out[f"{n}0"], out[f"{n}1"] = ends[n].to_numpy()[:-1], ends[n].to_numpy()[1:]
        out["feed"] = np.where(rapid, 0.0, rows["f"].astype("float64").fillna(0.0).to_numpy())
        state.update(tuple(float(ends[n].iloc[-1]) for n in AXES))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out[names]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return words.groupBy("job_id").applyInPandasWithState(step, MODAL, "x double, y double, z double", "append", timeout)


def dirty_region(cut: DataFrame) -> DataFrame:
    """Per job: the index box of the cells of a batch."""
    return cut.groupBy("job_id").agg(*(F.min(n).alias(f"min_{n}") for n in AXES), *(F.max(n).alias(f"max_{n}") for n in AXES))


def merged(known: DataFrame | None, cut: DataFrame) -> DataFrame:
    both = cut if known is None else known.unionByName(cut)
    return both.groupBy(*lattice.KEY).agg(F.min("first_cut").alias("first_cut"))


class RemovedTable:
    """Removed cells that micro-batches add to, in a folder of shared storage.

    A batch is written as its own part, ``cuts/batch=N``, so work grows with the batch and
    not with what is known. Each time the number of batches has doubled, the parts are put
    together as ``whole/batch=N``. What is there is told by the folder alone, by the marker
    that Spark writes last: an object made anew on the same folder, as after a restart,
    goes on from there. A batch that is replayed replaces its part and changes nothing else.
    """

    #: Batches after which parts are put together for the first time.
    FIRST_WHOLE = 8

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _written(self, kind: str) -> list[int]:
        """Numbers of the batches whose part or whole is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    @property
    def version(self) -> int:
        """The last batch that was added, -1 if none."""
        return max(self._written("cuts"), default=-1)

    def read(self, until: int | None = None) -> DataFrame | None:
        """Removed cells after the batch ``until``, by default after the last; None where there are none."""
        fits = lambda n: until is None or n <= until
        whole = max(filter(fits, self._written("whole")), default=-1)
        paths = [f"{self.folder}/cuts/batch={n}" for n in self._written("cuts") if n > whole and fits(n)]
        paths += [f"{self.folder}/whole/batch={whole}"] if whole >= 0 else []
        if not paths:
            return None
        return merged(None, self.spark.read.parquet(*paths))

    def part(self, batch: int) -> DataFrame:
        """The cells that a batch brought."""
        return self.spark.read.parquet(f"{self.folder}/cuts/batch={batch}")

    def add(self, cut: DataFrame, batch: int) -> DataFrame:
        """Adds a batch; returns its dirty region."""
        part = f"{self.folder}/cuts/batch={batch}"
        cut.write.mode("overwrite").parquet(part)
        wholes = self._written("whole")
        # A batch that was put together already and comes again has brought the same cells.
        if batch + 1 >= max(self.FIRST_WHOLE, 2 * (max(wholes, default=-1) + 1)):
            self.read(batch).write.mode("overwrite").parquet(f"{self.folder}/whole/batch={batch}")
        return dirty_region(self.spark.read.schema(cut.schema).parquet(part))


class BoundField:
    """A distance field that follows a table of one job's removed cells, batch by batch, in versions of blocks.

    A batch computes and writes only the blocks that are near to the cells it removed (see
    :mod:`kerf.operators.blocks`), as ``field/batch=N``: what is read, computed and written follows
    the change, not the lattice. A block's newest version counts; one that no batch has come near is
    solid stock and stored nowhere. Each time the number of batches has doubled, the newest versions are put
    together as ``whole/batch=N``, and what two wholes have overtaken is deleted. Like the table, it goes on
    from what the folder holds after a restart, and a batch that is replayed replaces its own part with the same.
    """

    #: Batches after which versions are put together for the first time.
    FIRST_WHOLE = 8

    def __init__(self, table: RemovedTable, grid: Grid, folder: str, band: int = sdf.BAND) -> None:
        self.table, self.grid, self.band = table, grid, band
        self.versions = RemovedTable(table.spark, folder)

    def _paths(self, until: int | None) -> list[tuple[str, int]]:
        """Folders that make the field after the batch ``until``, with their batches."""
        fits = lambda n: until is None or n <= until
        wholes, parts = self.versions._written("whole"), self.versions._written("field")
        whole = max(filter(fits, wholes), default=-1)
        if whole < 0 and wholes and (not parts or parts[0] > 0):
            raise ValueError(f"the field after batch {until} is overtaken and deleted")
        some = [("field", n) for n in parts if n > whole and fits(n)] + ([("whole", whole)] if whole >= 0 else [])
        return [(f"{self.versions.folder}/{kind}/batch={n}", n) for kind, n in some]

    def packed(self, until: int | None = None) -> DataFrame | None:
        """bx, by, bz, codes: the newest version of each block that some batch came near to; None where there are none."""
        paths = self._paths(until)
        if not paths:
            return None
        parts = [self.table.spark.read.parquet(path).withColumn("_batch", F.lit(n)) for path, n in paths]
        rows = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return rows.drop("_batch")
        # Which version counts is told from numbers alone; arrays are read once and not grouped.
        newest = rows.groupBy(*blocks.BLOCK).agg(F.max("_batch").alias("_batch"))
        return rows.join(newest, [*blocks.BLOCK, "_batch"], "left_semi").drop("_batch")

    def read(self, until: int | None = None) -> DataFrame:
        """x, y, z, d of all cells after the batch ``until``, by default after the last; of solid stock where there was none."""
        packed, every = self.packed(until), blocks.every_block(self.table.spark, self.grid)
        untouched = every if packed is None else every.join(packed.select(*blocks.BLOCK), blocks.BLOCK, "left_anti")
        solid = blocks.steps(self._words(None), self.grid, self.band, blocks=untouched)
        return blocks.cells(solid if packed is None else packed.unionByName(solid), self.grid, self.band)

    def _words(self, cells: DataFrame | None) -> DataFrame:
        none = self.table.spark.createDataFrame([], "x int, y int, z int")
        return blocks.words_of(none if cells is None else cells, self.grid)

    def update(self, dirty: DataFrame, batch: int) -> None:
        """Called with each batch's dirty region; see :func:`listen`."""
        box = dirty.agg(*(F.min(f"min_{n}").alias(f"min_{n}") for n in AXES), *(F.max(f"max_{n}").alias(f"max_{n}") for n in AXES)).first()
        if box["min_x"] is None:
            return
        reach = blocks.most_steps(self.band) + 1
        near = blocks.near_blocks(blocks.words_of(self.table.part(batch), self.grid), self.grid, reach).select(*blocks.BLOCK).distinct()
        # Cells beyond the blocks of the box and their surroundings aren't read; the filter reaches the files.
        side = blocks.SIDE
        ends = {n: ((box[f"min_{n}"] - reach) // side * side - reach, (box[f"max_{n}"] + reach) // side * side + side - 1 + reach) for n in AXES}
        around = self.table.read(batch).where(F.expr(" AND ".join(f"{n} BETWEEN {a} AND {b}" for n, (a, b) in ends.items())))
        words = blocks.near_blocks(self._words(around), self.grid, reach).join(near, blocks.BLOCK, "left_semi")
        fresh = blocks.computed(words, self.grid, self.band)
        fresh.write.mode("overwrite").parquet(f"{self.versions.folder}/field/batch={batch}")
        wholes = self.versions._written("whole")
        if batch + 1 >= max(self.FIRST_WHOLE, 2 * (max(wholes, default=-1) + 1)):
            self.packed(batch).write.mode("overwrite").parquet(f"{self.versions.folder}/whole/batch={batch}")
            self._forget(max((n for n in wholes if n < batch), default=-1))

    def _forget(self, whole: int) -> None:
        """Deletes what the whole of that batch has taken up."""
        gone = [("field", n) for n in self.versions._written("field") if n <= whole] + [("whole", n) for n in self.versions._written("whole") if n < whole]
        for kind, n in gone:
            path = self.table.spark._jvm.org.apache.hadoop.fs.Path(f"{self.versions.folder}/{kind}/batch={n}")
            path.getFileSystem(self.table.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def listen(primitives: DataFrame, grid: Grid, table: RemovedTable, on_change: Callable[[DataFrame, int], None] | None = None):  # noqa: ANN201
    """A writer (not started) that merges a stream of primitives and reports each batch's dirty region.

    ``on_change`` may be ``BoundField.update``: the field is then bound to the cells until the query is stopped.
    """

    def batch(df: DataFrame, number: int) -> None:
        dirty = table.add(lattice.removed(df, grid), number)
        if on_change:
            on_change(dirty, number)

    return primitives.writeStream.foreachBatch(batch)


def updated_field(field: DataFrame, cells: DataFrame, grid: Grid, box: tuple[tuple[int, int, int], tuple[int, int, int]], band: int = sdf.BAND) -> DataFrame:
    """The distance field after cells in ``box`` (lo, hi) changed: only it and a halo are computed anew.

    A change reaches ``band`` cells far. So cells up to the band around the box get new
    values, from those up to twice the band around it.
    """
    (lo, hi) = box
    near = [(max(0, a - band - 1), min(d - 1, b + band + 1)) for a, b, d in zip(lo, hi, grid.dims)]
    wide = [(max(0, a - 2 * band - 2), min(d - 1, b + 2 * band + 2)) for a, b, d in zip(lo, hi, grid.dims)]
    within = lambda ranges: F.expr(" AND ".join(f"{n} BETWEEN {a} AND {b}" for n, (a, b) in zip(AXES, ranges)))
    moved = cells.where(within(wide)).select(*((F.col(n) - a).alias(n) for n, (a, _) in zip(AXES, wide)), "material")
    part = Grid(
        tuple(g0 + a * grid.res for g0, (a, _) in zip(grid.lo, wide)), tuple(g0 + (b + 1) * grid.res for g0, (_, b) in zip(grid.lo, wide)), grid.res
    )
    fresh = sdf.from_cells(moved, part, band).select(*((F.col(n) + a).alias(n) for n, (a, _) in zip(AXES, wide)), "d")
    return field.where(~within(near)).unionByName(fresh.where(within(near)))


def volume_by_window(cuts: DataFrame, grid: Grid, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Volume removed in each window of event time, from rows of ts and cells. An extension."""
    df = cuts.withWatermark("ts", late) if late else cuts
    return df.groupBy(F.window("ts", width).alias("w")).agg(F.sum("cells").alias("cells")).select(
        F.col("w.start").alias("start"), "cells", (F.col("cells") * float(grid.res) ** 3).alias("volume")
    )
