"""From commands to segments to primitives.

Order matters only here, and only within a job. A job is cut into ranges of ``seq``, which
are put in order apart from each other; what a range leaves behind is one row, and only
these rows are put in order over the whole job. Rows and ends of ranges come from one
exchange, so what stands before, parsing included, is read and done once. Everything
after is a set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from kerf.functions import geometry as g
from kerf.plans.scan import carried, last_known, onward, two_level

COMMANDS = "job_id long, seq long, kind string, x double, y double, z double, a double, b double, c double, feed double"
Vec = tuple[float, float, float]
#: Commands are put in order within ranges of 2^20 numbers of ``seq``.
RANGE_BITS = 20


@dataclass(frozen=True)
class Tool:
    """An end mill with a flat or a ball end."""

    diameter: float = 10.0
    length: float = 50.0
    ball: bool = False

    def __post_init__(self) -> None:
        if not (self.diameter > 0 and self.length > 0):
            raise ValueError("a tool needs a positive diameter and length")

    @property
    def radius(self) -> float:
        return self.diameter / 2


def _scanned(rows: DataFrame, local: Callable[[WindowSpec], dict[str, Column]], ends: list[Column], before: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    return two_level(rows.withColumn("_range", F.shiftright("seq", RANGE_BITS)), "job_id", "_range", "seq", local, ends, before)


def move_kind(code: Column) -> Column:
    return F.when(code == 0, "G0").otherwise("G1").alias("kind")


def feed() -> Column:
    """The feed isn't carried on, and is 0 for rapid moves."""
    return F.when(F.col("code") == 1, F.coalesce("f", F.lit(0.0))).otherwise(0.0).alias("feed")


def modal(words: DataFrame, start: Vec = (0.0, 0.0, 0.0)) -> DataFrame:
    """Commands from rows of job_id, seq, code, x, y, z, f: an axis without a word stays where it was."""
    rows = words.select("job_id", "seq", "code", *"xyzf")
    rows = _scanned(rows, lambda w: {f"_{n}": onward(n, w) for n in "xyz"}, [last_known(n) for n in "xyz"], lambda w: [carried(n, w) for n in "xyz"])
    none = F.lit(None).cast("double")
    axes = [F.coalesce(f"_{n}", f"_from_{n}", F.lit(float(s))).alias(n) for n, s in zip("xyz", start)]
    return rows.select("job_id", "seq", move_kind(F.col("code")), *axes, none.alias("a"), none.alias("b"), none.alias("c"), feed())


def modal_segments(words: DataFrame, start: Vec = (0.0, 0.0, 0.0)) -> DataFrame:
    """The segments of :func:`modal`'s commands, in one scan: where an axis was before a row is known with where it is after."""
    rows = words.select("job_id", "seq", "code", *"xyzf")
    rows = _scanned(
        rows,
        lambda w: {f"_{n}": onward(n, w) for n in "xyz"} | {f"_{n}0": onward(n, w, -1) for n in "xyz"},
        [last_known(n) for n in "xyz"],
        lambda w: [carried(n, w) for n in "xyz"],
    )
    ends = [F.coalesce(f"_{n}{e}", f"_from_{n}", F.lit(float(s))).alias(f"{n}{e or 1}") for e in ("0", "") for n, s in zip("xyz", start)]
    return rows.select("job_id", "seq", move_kind(F.col("code")), feed(), *ends, *(F.lit(0.0).alias(f"{n}{e}") for e in "01" for n in "abc"))


def segments(commands: DataFrame, start: Vec = (0.0, 0.0, 0.0), orientation: Vec = (0.0, 0.0, 0.0)) -> DataFrame:
    """job_id, seq, kind, feed, x0.. z0, x1.. z1, a0.. c0, a1.. c1.

    A command starts where the last one ended. Only 5-axis commands turn the tool.
    """
    five = F.col("kind").endswith("_5")
    turned = [F.when(five, F.coalesce(n, F.lit(0.0))).alias(f"_{n}") for n in "abc"]
    at = [F.max_by(n, "seq").alias(f"_end_{n}") for n in "xyz"]
    rows = _scanned(
        commands.select("job_id", "seq", "kind", "feed", *"xyz", *turned),
        lambda w: {"_first": F.row_number().over(w) == 1} | {f"_{n}": F.lag(n).over(w) for n in "xyz"} | {f"_{n}0": onward(f"_{n}", w, -1) for n in "abc"},
        [*at, *(last_known(f"_{n}") for n in "abc")],
        lambda w: [*(F.last(f"_end_{n}").over(w).alias(f"_from_{n}") for n in "xyz"), *(carried(f"_{n}", w) for n in "abc")],
    )
    starts = [F.coalesce(F.when(F.col("_first"), F.col(f"_from_{n}")).otherwise(F.col(f"_{n}")), F.lit(float(s))).alias(f"{n}0") for n, s in zip("xyz", start)]
    turns = [F.coalesce(f"_{n}0", f"_from__{n}", F.lit(float(s))) for n, s in zip("abc", orientation)]
    return rows.select(
        "job_id", "seq", "kind", "feed", *starts, *(F.col(n).alias(f"{n}1") for n in "xyz"),
        *(c.alias(f"{n}0") for n, c in zip("abc", turns)), *(F.coalesce(f"_{n}", c).alias(f"{n}1") for n, c in zip("abc", turns)),
    )


def steps(commands: DataFrame, done: int, count: int) -> DataFrame:
    """The next ``count`` commands after the first ``done`` of each job, by rank within the job."""
    rows = _scanned(
        commands, lambda w: {"_k": F.row_number().over(w)}, [F.count("*").alias("_n")], lambda w: [F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead")]
    )
    rank = F.col("_k") + F.coalesce("_ahead", F.lit(0))
    return rows.where((rank > done) & (rank <= done + count)).select(*commands.columns)


def progress(commands: DataFrame, done: int) -> DataFrame:
    """Per job: commands in all, the number of the last one done (-1: none) and whether all are."""
    total = commands.groupBy("job_id").agg(F.count("*").alias("total"))
    current = F.least(F.lit(done), F.col("total")) - 1
    return total.select("job_id", "total", current.alias("current"), (current >= F.col("total") - 1).alias("completed"))


def _primitive(part: Column, shape: str, a: g.Point, b: g.Point, r: Column) -> Column:
    fields = [*(c.cast("double").alias(f"a{n}") for c, n in zip(a, "xyz")), *(c.cast("double").alias(f"b{n}") for c, n in zip(b, "xyz"))]
    return F.struct(part.cast("int").alias("part"), F.lit(shape).alias("shape"), *fields, r.cast("double").alias("r"))


def _stretched(p: g.Point, q: g.Point, t: Column) -> g.Point:
    return tuple(g.lerp(a, b, t) for a, b in zip(p, q))


def _tool_columns(tool: Tool | None) -> tuple[Column, Column, Column]:
    """(radius, length, is ball) from a tool, or from columns diameter, length, ball of the segments."""
    if tool is None:
        return F.col("diameter") / 2, F.col("length"), F.col("ball")
    return F.lit(tool.radius), F.lit(float(tool.length)), F.lit(tool.ball)


def _listed(df: DataFrame, struct_array: Column) -> DataFrame:
    return df.select("job_id", "seq", F.inline(struct_array))


def primitives_3axis(segs: DataFrame, tool: Tool | None, res: float, field: bool = False) -> DataFrame:
    """What G1 segments take away: job_id, seq, part, shape, ax.. bz, r.

    The tip's path, the path of the shaft's top, and upright cylinders along the way.
    With ``field`` as for distance fields: rounded shapes, spheres at a ball's ends, and
    coarser steps.
    """
    r, n, ball = _tool_columns(tool)
    cut = segs.where(F.col("kind") == "G1")
    p, q = g.point(names=("x0", "y0", "z0")), g.point(names=("x1", "y1", "z1"))
    up = (F.lit(0.0), F.lit(0.0), n)
    way = g.distance(p, q)
    step = r * 0.5 if field else F.least(r * 0.5, F.lit(2.0 * res))
    count = F.when(way > 0, F.greatest(F.lit(2), F.ceil(way / step).cast("int"))).otherwise(0)
    flat = "capsule" if field else "cylinder"
    zero = F.lit(0)
    cut = cut.withColumn("_n", count)

    def upright(i: Column) -> Column:
        at = _stretched(p, q, F.when(F.col("_n") > 0, i / F.col("_n").cast("double")).otherwise(F.lit(0.0)))
        return _primitive(i + 10, flat, at, g.add(at, up), r)

    tip_flat, tip_ball = F.array(_primitive(zero, flat, p, q, r)), F.array(_primitive(zero, "capsule", p, q, r))
    if field:
        ends = F.array(_primitive(F.lit(1), "sphere", p, p, r), _primitive(F.lit(2), "sphere", q, q, r))
        tip_ball = F.concat(ends, tip_ball)
    top = F.array(_primitive(F.lit(3), flat, g.add(p, up), g.add(q, up), r))
    along = F.transform(F.sequence(F.lit(0), F.col("_n")), upright)
    return _listed(cut, F.concat(F.when(ball, tip_ball).otherwise(tip_flat), top, along))


def reach_3axis(tool: Tool | None) -> tuple[g.Point, g.Point]:
    """The least and the greatest point that primitives of a segment touch, for those of :func:`primitives_3axis`."""
    r, n, _ = _tool_columns(tool)
    ends = [(F.col(f"{a}0"), F.col(f"{a}1")) for a in "xyz"]
    lo, hi = ([f(*e) for e in ends] for f in (F.least, F.greatest))
    return tuple(c - r for c in lo), (hi[0] + r, hi[1] + r, hi[2] + n + r)


def primitives_5axis(segs: DataFrame, tool: Tool | None, res: float, field: bool = False) -> DataFrame:
    """What G1_5 segments take away: at samples along the way a sphere at the tip and the leaning shaft.

    Moves shorter than 0.001 only turn the tool and cut nothing.
    """
    r, n, ball = _tool_columns(tool)
    p, q = g.point(names=("x0", "y0", "z0")), g.point(names=("x1", "y1", "z1"))
    way = g.distance(p, q)
    count = F.greatest(F.lit(1), F.ceil(way / F.lit(2.5 * res if field else res)).cast("int"))
    cut = segs.where((F.col("kind") == "G1_5") & (way >= 0.001)).withColumn("_n", count)
    tip_r = F.when(ball, r).otherwise(r * 0.5)

    def sample(i: Column) -> Column:
        t = i / F.col("_n").cast("double")
        at = _stretched(p, q, t)
        a, b = g.lerp(F.col("a0"), F.col("a1"), t), g.lerp(F.col("b0"), F.col("b1"), t)
        top = g.subtract(at, g.scale(g.tool_direction(a, b), n))
        return F.array(_primitive(2 * i, "sphere", at, at, tip_r), _primitive(2 * i + 1, "capsule" if field else "cylinder", at, top, r))

    return _listed(cut, F.flatten(F.transform(F.sequence(F.lit(0), F.col("_n")), sample)))


def primitives_point(points: DataFrame, tool: Tool | None, field: bool = False) -> DataFrame:
    """What a tool takes away standing at x, y, z: a sphere and the shaft above."""
    r, n, _ = _tool_columns(tool)
    at = g.point()
    shaft = _primitive(F.lit(1), "capsule" if field else "cylinder", at, g.add(at, (F.lit(0.0), F.lit(0.0), n)), r)
    return _listed(points, F.array(_primitive(F.lit(0), "sphere", at, at, r), shaft))


#: Kinds of commands and what they take away. Register further kinds here.
KINDS = {"G1": primitives_3axis, "G1_5": primitives_5axis}


def primitives(segs: DataFrame, tool: Tool | None, res: float, field: bool = False) -> DataFrame:
    """Primitives of all segments; rapid moves have none."""
    out = None
    for make in KINDS.values():
        made = make(segs, tool, res, field)
        out = made if out is None else out.unionByName(made)
    return out


def polyline(segs: DataFrame) -> DataFrame:
    """Lines to draw: rapid moves and cuts of 3-axis commands."""
    return segs.where(F.col("kind").isin("G0", "G1")).select(
        "job_id", "seq", "x0", "y0", "z0", "x1", "y1", "z1", F.when(F.col("kind") == "G0", "rapid").otherwise("cut").alias("colour")
    )


def command_text(kind: Column) -> Column:
    """Text of a command row."""
    xyz = F.format_string("X%.3f Y%.3f Z%.3f", "x", "y", "z")
    abc = F.format_string(" A%.3f B%.3f C%.3f", *(F.coalesce(n, F.lit(0.0)) for n in "abc"))
    return F.concat(F.regexp_replace(kind, "_5", " 5-axis"), F.lit(" "), xyz, F.when(kind.endswith("_5"), abc).otherwise(F.lit("")))
