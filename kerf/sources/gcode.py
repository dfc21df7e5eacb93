"""G-code files as tables of lines, commands written in code, and generated paths."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from kerf.functions.gcode import USUAL, Dialect, code_words
from kerf.plans.scan import carried, last_known, onward, two_level
from kerf.plans.toolpath import COMMANDS, feed, move_kind

Move = tuple  # (kind, x, y, z) or (kind, x, y, z, a, b, c), and feed by name in command()


def _split(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place, text of each line: the part of the file that a task reads, and an order within it."""
    if not path:
        raise ValueError("a path is needed")
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text")
    )


def _rank(w: WindowSpec) -> dict[str, Column]:
    return {"_k": F.row_number().over(w)}


def _ahead(w: WindowSpec) -> Column:
    return F.coalesce(F.sum("_lines").over(w), F.lit(0)).alias("_ahead")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), text. Lines end with CR, LF or both; a final line end adds no line.

    One file is read by as many tasks as it has parts of ``spark.sql.files.maxPartitionBytes``.
    Lines are numbered within each part, and the lines of the parts before it are added.
    """
    lines = two_level(_split(spark, path), "file", "block", "place", _rank, [F.count("*").alias("_lines")], lambda w: [_ahead(w)])
    return lines.select("file", (F.col("_ahead") + F.col("_k") - 1).alias("line_no"), "text")


def moves(lines: DataFrame, job: str = "file", order: str = "line_no", dialect: Dialect = USUAL) -> DataFrame:
    """G0 and G1 lines as rows of job_id, seq, code and the words X, Y, Z and F that they have."""
    words = code_words(lines.select(F.col(job).alias("job_id"), F.col(order).alias("seq"), "text"), "XYZF", dialect=dialect)
    return words.where(F.col("code").isin(0, 1)).select("job_id", "seq", "code", *"xyzf")


def read_program(spark: SparkSession, path: str, start: tuple[float, float, float] = (0.0, 0.0, 0.0), dialect: Dialect = USUAL) -> DataFrame:
    """Commands of all programs under ``path``; each is a job of its own, and ``seq`` is the line.

    Lines are parsed where they are read, and one exchange by parts of files gives both
    their numbers and what axes without a word carry on.
    """
    words = code_words(_split(spark, path), "XYZF", dialect=dialect, others=True)
    is_move = F.col("code").isin(0, 1)
    rows = words.select("file", "block", "place", F.when(is_move, F.col("code")).alias("code"), *(F.when(is_move, F.col(n)).alias(n) for n in "xyzf"))
    rows = two_level(
        rows, "file", "block", "place",
        lambda w: _rank(w) | {f"_{n}": onward(n, w) for n in "xyz"},
        [F.count("*").alias("_lines"), *(last_known(n, "place") for n in "xyz")],
        lambda w: [_ahead(w), *(carried(n, w) for n in "xyz")],
    )
    axes = [F.coalesce(f"_{n}", f"_from_{n}", F.lit(float(s))).alias(n) for n, s in zip("xyz", start)]
    none = F.lit(None).cast("double")
    seq = (F.col("_ahead") + F.col("_k") - 1).alias("seq")
    return rows.where(F.col("code").isNotNull()).select(F.col("file").alias("job_id"), seq, move_kind(F.col("code")), *axes, none.alias("a"), none.alias("b"), none.alias("c"), feed())


def command(kind: str, x: float, y: float, z: float, a: float | None = None, b: float | None = None, c: float | None = None, feed: float = 0.0) -> tuple:
    if kind not in ("G0", "G1", "G0_5", "G1_5"):
        raise ValueError(f"no such command: {kind}")
    num = lambda v: None if v is None else float(v)
    return kind, num(x), num(y), num(z), num(a), num(b), num(c), float(feed)


def commands(spark: SparkSession, rows: Iterable[tuple], job_id: int = 0) -> DataFrame:
    """Commands from :func:`command` tuples or (kind, x, y, z)."""
    full = [(job_id, i, *(r if len(r) == 8 else command(*r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COMMANDS)


def circle(spark: SparkSession, radius: float, z: float, segments: int = 36, feed: float = 500.0, job_id: int = 0, first: int = 0) -> DataFrame:
    """A move to the circle's start, then cuts along it."""
    angle = F.col("i") * (2 * math.pi / segments)
    cut = spark.range(0, segments + 1).withColumnRenamed("id", "i").select(
        F.lit(job_id).cast("long").alias("job_id"), (F.col("i") + first + 1).alias("seq"), F.lit("G1").alias("kind"),
        (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), F.lit(float(z)).alias("z"), F.lit(float(feed)).alias("feed"),
    )
    go = spark.createDataFrame([(job_id, first, "G0", float(radius), 0.0, float(z), 0.0)], "job_id long, seq long, kind string, x double, y double, z double, feed double")
    return _full(go.unionByName(cut))


def dome_spiral(spark: SparkSession, sphere: float, turns: int, per_turn: int, top: float, drop: float, feed: float = 600.0, job_id: int = 0, first: int = 0) -> DataFrame:
    """Cuts down a dome: one turn after the other, lower and wider."""
    n = turns * per_turn
    t = F.col("i") / F.lit(float(n))
    z = F.lit(float(top)) - t * float(drop)
    r = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(sphere) ** 2) - (F.lit(float(top)) - z) * (F.lit(float(top)) - z)))
    angle = F.col("i") * (2 * math.pi / per_turn)
    return _full(
        spark.range(0, n + 1).withColumnRenamed("id", "i").select(
            F.lit(job_id).cast("long").alias("job_id"), (F.col("i") + first).alias("seq"), F.lit("G1").alias("kind"),
            (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), z.alias("z"), F.lit(float(feed)).alias("feed"),
        )
    )


def _full(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.withColumns({c: none for c in "abc"}).select("job_id", "seq", "kind", "x", "y", "z", "a", "b", "c", "feed")
