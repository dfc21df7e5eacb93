"""One stock, its tools and its toolpath, behind one object.

``execute`` runs one job, to know where the commands end; all else but counts and exports
is lazy. Each list of commands is a branch of the plan, so many short lists are better
put together before they are executed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.grid import Grid
from kerf.operators import lattice, mesh, sdf
from kerf.plans import toolpath
from kerf.plans.toolpath import Tool
from kerf.sources import config, stl


class Simulation:
    """Commands run one list after the other; each runs with the tool that is set then."""

    def __init__(self, spark: SparkSession, grid: Grid, tool: Tool, start: toolpath.Vec = (0.0, 0.0, 0.0)) -> None:
        self.spark, self.grid, self.tool, self.start = spark, grid, tool, start
        self._parts: list[tuple[DataFrame, Tool, toolpath.Vec, toolpath.Vec]] = []
        self._at, self._turn, self._next = start, (0.0, 0.0, 0.0), 0

    @classmethod
    def from_files(cls, spark: SparkSession, stock: str, tool: str, res: float = 1.0) -> Simulation:
        t = config.read_tool(spark, tool).first()
        return cls(spark, config.grid_of(config.read_stock(spark, stock), res), Tool(t["diameter"], t["length"], t["type"] == "Ball"))

    def execute(self, commands: DataFrame) -> Simulation:
        """Adds the commands of one job after those before. ``seq`` goes on counting."""
        if commands is None:
            raise ValueError("commands are needed")
        moved = commands.withColumn("seq", F.col("seq") + self._next).withColumn("job_id", F.lit(0).cast("long"))
        self._parts.append((moved, self.tool, self._at, self._turn))
        last = moved.agg(
            F.count("*").alias("n"), F.max("seq").alias("seq"), *(F.max_by(n, "seq").alias(n) for n in "xyz"),
            *(F.max_by(F.coalesce(n, F.lit(0.0)), F.when(F.col("kind").endswith("_5"), F.col("seq"))).alias(n) for n in "abc"),
        ).first()
        if last["n"]:
            self._at, self._next = tuple(last[n] for n in "xyz"), last["seq"] + 1
            self._turn = tuple(last[n] if last[n] is not None else t for n, t in zip("abc", self._turn))
        return self

    def change_tool(self, tool: Tool) -> Simulation:
        """From here on with another tool, from the same position, upright."""
        self.tool, self._turn = tool, (0.0, 0.0, 0.0)
        return self

    @property
    def position(self) -> toolpath.Vec:
        return self._at

    def segments(self) -> DataFrame:
        """All segments, with diameter, length and ball of their tool."""
        out = None
        for commands, tool, at, turn in self._parts:
            part = toolpath.segments(commands, at, turn).withColumns({"diameter": F.lit(float(tool.diameter)), "length": F.lit(float(tool.length)), "ball": F.lit(tool.ball)})
            out = part if out is None else out.unionByName(part)
        if out is None:
            empty = toolpath.segments(self.spark.createDataFrame([], toolpath.COMMANDS))
            out = empty.withColumns({"diameter": F.lit(1.0), "length": F.lit(1.0), "ball": F.lit(False)})
        return out

    def removed(self, until: int | None = None) -> DataFrame:
        """Removed cells; ``until``: as it was after that command."""
        cut = lattice.removed(toolpath.primitives(self.segments(), None, self.grid.res), self.grid)
        return cut if until is None else lattice.after(cut, until)

    def material_count(self, until: int | None = None) -> int:
        return lattice.count_one(self.removed(until), self.grid)

    def field(self, band: float = sdf.BAND) -> DataFrame:
        """The distance field of the cut cells."""
        return sdf.from_removed(self.removed(), self.grid, band)

    def direct_field(self, band: float = sdf.BAND) -> DataFrame:
        """The field straight from the primitives, without cells: only rows below the band."""
        return sdf.from_primitives(toolpath.primitives(self.segments(), None, self.grid.res, field=True), self.grid, band)

    def facets(self, averaged: bool = False) -> DataFrame:
        quads = mesh.quads(mesh.faces(self.spark, self.removed(), self.grid), self.grid)
        return mesh.facets(mesh.triangles(quads), self.grid, mesh.vertices(quads, self.grid) if averaged else None)

    def smooth_facets(self, band: float = sdf.BAND) -> DataFrame:
        return mesh.dual_triangles(mesh.dual_quads(mesh.dual_vertices(self.field(band), self.grid, band), self.grid))

    def export_stl(self, path: str, smooth: bool = False) -> int:
        """Writes the surface; returns the number of triangles."""
        return stl.write(self.smooth_facets() if smooth else self.facets(), path)

    def stl_bytes(self) -> bytes:
        return stl.to_bytes(self.facets())

    def reset(self) -> Simulation:
        """Whole stock again, back at the start."""
        self._parts, self._at, self._turn, self._next = [], self.start, (0.0, 0.0, 0.0), 0
        return self
