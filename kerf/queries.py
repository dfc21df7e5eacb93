"""One query for each operator over the driver's tables, and DuckDB SQL for its result.

Toolpaths, shapes and points are derived from the tables by whole-number arithmetic:
``events`` become commands of five jobs, ``part`` spheres, rods and tools, ``lineitem``
points. Every query takes all rows of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf import scenarios
from kerf.functions import gcode, geometry as g
from kerf.grid import Grid
from kerf.operators import adaptive, blocks, lattice, lookups, mesh, rounds, runs, sdf
from kerf.plans import toolpath
from kerf.plans.toolpath import Tool
from kerf.sources import stl
from kerf.sources.gcode import moves, read_lines, read_program
from kerf.storage import shared_folder
from kerf.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A cube of 64 cells for shapes, and a coarse one for toolpaths.
CUBE = Grid((0.0, 0.0, 0.0), (64.0, 64.0, 64.0), 1.0)
BED = Grid((-22.0, -22.0, -22.0), (22.0, 22.0, 22.0), 2.0)
TOOL = Tool(8.0, 4.0, False)
TOOL5 = Tool(4.0, 6.0, True)
BAND = 10


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


# Derived relations, with the same SQL for both engines

WORDS_SQL = """SELECT CAST(user_id % 5 AS BIGINT) AS job_id, CAST(event_id AS BIGINT) AS seq,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS INT) AS code,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST((event_id * 37) % 41 - 20 AS DOUBLE) END AS x,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id * 53) % 41 - 20 AS DOUBLE) END AS y,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 29) % 41 - 20 AS DOUBLE) END AS z,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(100 + event_id % 7 AS DOUBLE) END AS f, ts
FROM events"""
SPHERES_SQL = """SELECT CAST(0 AS BIGINT) AS job_id, CAST(p_partkey AS BIGINT) AS seq,
  CAST((p_partkey * 7) % 60 + 2 AS DOUBLE) AS cx,
  CAST((p_partkey * 13 + CAST(floor(p_partkey / 60) AS BIGINT) * 11) % 60 + 2 AS DOUBLE) AS cy,
  CAST((CAST(floor(p_partkey / 7) AS BIGINT) * 17) % 60 + 2 AS DOUBLE) AS cz,
  CAST(1.0 + 0.5 * (p_size % 3) AS DOUBLE) AS r
FROM part"""
#: Rods: from each sphere's centre, along x, y or z.
RODS_SQL = f"""SELECT job_id, seq, cx AS ax, cy AS ay, cz AS az,
  cx + CASE WHEN seq % 3 = 0 THEN 5.0 ELSE 0.0 END AS bx, cy + CASE WHEN seq % 3 = 1 THEN 4.0 ELSE 0.0 END AS bry,
  cz + CASE WHEN seq % 3 = 2 THEN 6.0 ELSE 0.0 END AS bz, r FROM ({SPHERES_SQL}) s""".replace("bry", "by_")
POINTS_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_returnflag AS flag,
  CAST(l_quantity AS DOUBLE) - 5.25 AS wx, CAST(l_partkey % 50 AS DOUBLE) - 1.5 AS wy, CAST(l_suppkey % 50 AS DOUBLE) + 0.75 AS wz FROM lineitem"""
TURNS_SQL = """SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id % 360 AS DOUBLE) AS a, CAST((event_id * 7) % 360 - 180 AS DOUBLE) AS b,
  CAST((event_id * 11) % 360 AS DOUBLE) AS c, CAST(event_id % 17 - 8 AS DOUBLE) AS x, CAST(event_id % 23 - 11 AS DOUBLE) AS y,
  CAST(event_id % 29 - 14 AS DOUBLE) AS z FROM events"""


def derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {source}", "FROM {t}"), t=table(spark, sf_dir, source))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, WORDS_SQL, "events")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, POINTS_SQL, "lineitem")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TURNS_SQL, "events")


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, SPHERES_SQL, "part")
    centre = [F.col(f"c{n}").alias(f"{e}{n}") for e in "ab" for n in "xyz"]
    return s.select("job_id", "seq", F.lit(0).alias("part"), F.lit("sphere").alias("shape"), *centre, "r")


def rods(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    s = derived(spark, sf_dir, RODS_SQL, "part").withColumnRenamed("by_", "by")
    return s.select("job_id", "seq", F.lit(0).alias("part"), F.lit(shape).alias("shape"), "ax", "ay", "az", "bx", "by", "bz", "r")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.modal(words(spark, sf_dir).drop("ts"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.modal_segments(words(spark, sf_dir).drop("ts"))


def five_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands as 5-axis ones, with angles."""
    angle = lambda k, m: (F.col("seq") * k % m).cast("double")
    return commands(spark, sf_dir).withColumns({"kind": F.concat("kind", F.lit("_5")), "a": angle(3, 60), "b": angle(5, 45), "c": angle(1, 30)})


def sphere_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.removed(spheres(spark, sf_dir), CUBE)


def sphere_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.union(runs.tested(spheres(spark, sf_dir), CUBE))


# SQL of the stages after them

MODAL_SQL = f"""SELECT job_id, seq, CASE WHEN code = 0 THEN 'G0' ELSE 'G1' END AS kind,
  {', '.join(f"coalesce(last_value({n} IGNORE NULLS) OVER w, 0.0) AS {n}" for n in 'xyz')},
  CASE WHEN code = 1 THEN coalesce(f, 0.0) ELSE 0.0 END AS feed
FROM ({WORDS_SQL}) WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""
SEGMENTS_SQL = f"""SELECT job_id, seq, kind, feed, {', '.join(f"lag({n}, 1, 0.0) OVER w AS {n}0, {n} AS {n}1" for n in 'xyz')}
FROM ({MODAL_SQL}) WINDOW w AS (PARTITION BY job_id ORDER BY seq)"""


def _prims3() -> str:
    r, n, res = TOOL.radius, TOOL.length, BED.res
    step = min(r * 0.5, 2 * res)
    lerp = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    base = f"""SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) AS way FROM ({SEGMENTS_SQL}) WHERE kind = 'G1'"""
    counted = f"SELECT *, CASE WHEN way > 0 THEN greatest(2, CAST(ceil(way / {step}) AS INT)) ELSE 0 END AS n FROM ({base})"
    cols = lambda part, a, b: f"SELECT job_id, seq, {part} AS part, 'cylinder' AS shape, {', '.join(f'{v} AS {c}' for v, c in zip((*a, *b), ('ax', 'ay', 'az', 'bx', 'by_', 'bz')))}, CAST({r} AS DOUBLE) AS r"
    t = "(CASE WHEN n > 0 THEN CAST(i AS DOUBLE) / n ELSE 0.0 END)"
    at = [lerp(f"{a}0", f"{a}1", t) for a in "xyz"]
    return f"""WITH s AS ({counted})
{cols(0, ('x0', 'y0', 'z0'), ('x1', 'y1', 'z1'))} FROM s
UNION ALL {cols(3, ('x0', 'y0', f'z0 + {n}'), ('x1', 'y1', f'z1 + {n}'))} FROM s
UNION ALL {cols('CAST(i + 10 AS INT)', at, (at[0], at[1], f'{at[2]} + {n}'))} FROM (SELECT s.*, unnest(range(0, n + 1)) AS i FROM s)"""


PRIMS3_SQL = _prims3()


def _prims5(res: float = BED.res, shaft: str = "cylinder") -> str:
    r, n = TOOL5.radius, TOOL5.length
    turn = "(seq * 3) % 60 AS a1, (seq * 5) % 45 AS b1"
    base = f"SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) AS way, {turn} FROM ({SEGMENTS_SQL})"
    lagged = f"SELECT *, coalesce(lag(a1) OVER w, 0) AS a0, coalesce(lag(b1) OVER w, 0) AS b0 FROM ({base}) WINDOW w AS (PARTITION BY job_id ORDER BY seq)"
    counted = f"SELECT *, greatest(1, CAST(ceil(way / {res}) AS INT)) AS n FROM ({lagged}) WHERE kind = 'G1' AND way >= 0.001"
    at = ", ".join(f"{v}0 + ({v}1 - {v}0) * (CAST(i AS DOUBLE) / n) AS {v}" for v in "xyz")
    turned = ", ".join(f"radians({v}0 + ({v}1 - {v}0) * (CAST(i AS DOUBLE) / n)) AS {v}" for v in "ab")
    each = f"SELECT job_id, seq, i, {at}, {turned} FROM (SELECT s.*, unnest(range(0, n + 1)) AS i FROM ({counted}) s)"
    return f"""WITH e AS ({each})
SELECT job_id, seq, CAST(2 * i AS INT) AS part, 'sphere' AS shape, x AS ax, y AS ay, z AS az, x AS bx, y AS by_, z AS bz, {r} AS r FROM e
UNION ALL SELECT job_id, seq, CAST(2 * i + 1 AS INT), '{shaft}', x, y, z, x + sin(b) * {n}, y - cos(b) * sin(a) * {n}, z + cos(b) * cos(a) * {n}, {r} FROM e"""


def _hits(prims: str, grid: Grid) -> str:
    """SQL for cells in primitives: job_id, seq, x, y, z."""
    n, (lo, res) = grid.dims, (grid.lo, grid.res)
    box = ", ".join(
        f"greatest(0, CAST(trunc((least(a{v}, b{c}) - r - ({lo[k]})) / {res}) AS INT)) AS l{v}, least({n[k] - 1}, CAST(trunc((greatest(a{v}, b{c}) + r - ({lo[k]})) / {res}) AS INT)) AS h{v}"
        for k, (v, c) in enumerate(zip("xyz", ("x", "y_", "z")))
    )
    cells = f"SELECT * FROM (SELECT *, {box} FROM ({prims}) p) q, LATERAL (SELECT unnest(range(lx, hx + 1)) AS x) ux, LATERAL (SELECT unnest(range(ly, hy + 1)) AS y) uy, LATERAL (SELECT unnest(range(lz, hz + 1)) AS z) uz"
    at = ", ".join(f"({lo[k]}) + ({v} + 0.5) * {res} AS p{v}" for k, v in enumerate("xyz"))
    axis = "sqrt((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)) AS n"
    one = f"SELECT *, {at}, {axis} FROM ({cells})"
    two = f"SELECT *, CASE WHEN n < 1e-6 THEN 0.0 ELSE (px-ax)*((bx-ax)/n) + (py-ay)*((by_-ay)/n) + (pz-az)*((bz-az)/n) END AS t FROM ({one})"
    sq = lambda a, b, c: f"((px-({a}))*(px-({a})) + (py-({b}))*(py-({b})) + (pz-({c}))*(pz-({c})))"
    foot = [f"a{v} + ((b{c} - a{v}) / n) * t" for v, c in zip("xyz", ("x", "y_", "z"))]
    inside = f"""CASE WHEN shape = 'sphere' OR n < 1e-6 THEN {sq('ax', 'ay', 'az')} <= r * r
      WHEN t >= -1e-5 AND t <= n + 1e-5 THEN {sq(*foot)} <= r * r
      ELSE shape = 'capsule' AND ({sq('ax', 'ay', 'az')} <= r * r OR {sq('bx', 'by_', 'bz')} <= r * r) END"""
    return f"SELECT job_id, seq, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM ({two}) WHERE {inside}"


def _first(prims: str, grid: Grid) -> str:
    return f"SELECT job_id, x, y, z, min(seq) AS first_cut FROM ({_hits(prims, grid)}) GROUP BY ALL"


SPHERE_PRIMS = f"SELECT job_id, seq, 'sphere' AS shape, cx AS ax, cy AS ay, cz AS az, cx AS bx, cy AS by_, cz AS bz, r FROM ({SPHERES_SQL})"
SPHERE_CUT = _first(SPHERE_PRIMS, CUBE)
FIRST_CUT = _first(f"SELECT * FROM ({PRIMS3_SQL})", BED)
CELLS_SQL = f"""SELECT l.x, l.y, l.z, r.x IS NULL AS material FROM (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z
  FROM range(64) a(i), range(64) b(i), range(64) c(i)) l LEFT JOIN ({SPHERE_CUT}) r ON l.x = r.x AND l.y = r.y AND l.z = r.z"""


def _surface_sql() -> str:
    df = f"SELECT x, y, z, material, CAST(material AS INT) AS lo, CAST(material AS INT) AS hi FROM ({CELLS_SQL})"
    for a in "xyz":
        o = ", ".join(n for n in "xyz" if n != a)
        df = f"SELECT x, y, z, material, CASE WHEN {a} IN (0, 63) THEN 0 ELSE min(lo) OVER w END AS lo, max(hi) OVER w AS hi FROM ({df}) WINDOW w AS (PARTITION BY {o} ORDER BY {a} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return f"SELECT x, y, z, material, CASE WHEN material THEN lo = 0 ELSE hi = 1 END AS surface FROM ({df})"


SURFACE_SQL = _surface_sql()


def _field_sql() -> str:
    df = f"SELECT *, CASE WHEN surface AND NOT material THEN 0.0 ELSE 999.0 END AS f FROM ({SURFACE_SQL})"
    for a in "xyz":
        o = ", ".join(n for n in "xyz" if n != a)
        up = f"min(f - {a}) OVER (PARTITION BY {o} ORDER BY {a} ROWS UNBOUNDED PRECEDING) + {a}"
        down = f"min(f + {a}) OVER (PARTITION BY {o} ORDER BY {a} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - {a}"
        df = f"SELECT x, y, z, material, surface, least({up}, {down}) AS f FROM ({df})"
    return f"SELECT x, y, z, CASE WHEN material THEN CASE WHEN surface THEN 0.1 ELSE 0.5 END ELSE -least(10.0, f + 0.1) END AS d FROM ({df})"


FIELD_SQL = _field_sql()
#: Written out, so that they don't follow the operator's own tables: each side's outward normal, and its corners in the order of winding.
SIDES_SQL = "SELECT * FROM (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) v(side, dx, dy, dz)"
FACES_SQL = f"""SELECT m.x, m.y, m.z, s.side FROM (SELECT * FROM ({CELLS_SQL}) WHERE material) m CROSS JOIN ({SIDES_SQL}) s
  LEFT JOIN (SELECT * FROM ({CELLS_SQL}) WHERE material) n ON n.x = m.x + s.dx AND n.y = m.y + s.dy AND n.z = m.z + s.dz WHERE n.x IS NULL"""
CORNERS_SQL = """SELECT * FROM (VALUES
  (0, 0, 0, 0, 0, -1, 0, 0), (0, 1, 0, 0, 1, -1, 0, 0), (0, 2, 0, 1, 1, -1, 0, 0), (0, 3, 0, 1, 0, -1, 0, 0),
  (1, 0, 1, 0, 0, 1, 0, 0), (1, 1, 1, 1, 0, 1, 0, 0), (1, 2, 1, 1, 1, 1, 0, 0), (1, 3, 1, 0, 1, 1, 0, 0),
  (2, 0, 0, 0, 0, 0, -1, 0), (2, 1, 1, 0, 0, 0, -1, 0), (2, 2, 1, 0, 1, 0, -1, 0), (2, 3, 0, 0, 1, 0, -1, 0),
  (3, 0, 0, 1, 0, 0, 1, 0), (3, 1, 0, 1, 1, 0, 1, 0), (3, 2, 1, 1, 1, 0, 1, 0), (3, 3, 1, 1, 0, 0, 1, 0),
  (4, 0, 0, 0, 0, 0, 0, -1), (4, 1, 0, 1, 0, 0, 0, -1), (4, 2, 1, 1, 0, 0, 0, -1), (4, 3, 1, 0, 0, 0, 0, -1),
  (5, 0, 0, 0, 1, 0, 0, 1), (5, 1, 1, 0, 1, 0, 0, 1), (5, 2, 1, 1, 1, 0, 0, 1), (5, 3, 0, 1, 1, 0, 0, 1)) v(side, corner, ox, oy, oz, nx, ny, nz)"""
#: A small lattice for dual contours: the field around the parts' spheres.
NODE_SQL = f"""SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z, CASE
  WHEN a.i BETWEEN 0 AND 63 AND b.i BETWEEN 0 AND 63 AND c.i BETWEEN 0 AND 63 THEN f.d
  ELSE -sqrt(pow(greatest(0, -0.5 - a.i, a.i - 63.5) + CASE WHEN a.i BETWEEN 0 AND 63 THEN 0 ELSE 0 END, 2) + pow(greatest(0, -0.5 - b.i, b.i - 63.5), 2) + pow(greatest(0, -0.5 - c.i, c.i - 63.5), 2)) END AS d
  FROM range(-1, 65) a(i) CROSS JOIN range(-1, 65) b(i) CROSS JOIN range(-1, 65) c(i) LEFT JOIN ({FIELD_SQL}) f ON f.x = a.i AND f.y = b.i AND f.z = c.i"""
DUAL_CELLS_SQL = f"""WITH v AS MATERIALIZED ({NODE_SQL}), o AS (SELECT k, k & 1 AS ox, (k >> 1) & 1 AS oy, (k >> 2) & 1 AS oz FROM (SELECT CAST(i AS INT) AS k FROM range(8) t(i)))
SELECT CAST(v.x - ox AS INT) AS x, CAST(v.y - oy AS INT) AS y, CAST(v.z - oz AS INT) AS z, {', '.join(f'max(CASE WHEN k = {k} THEN d END) AS c{k}' for k in range(8))}
FROM v CROSS JOIN o WHERE v.x - ox BETWEEN -1 AND 63 AND v.y - oy BETWEEN -1 AND 63 AND v.z - oz BETWEEN -1 AND 63
GROUP BY 1, 2, 3 HAVING sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) BETWEEN 1 AND 7"""


# Geometry


@query(f"""SELECT ok, ln, CAST(trunc(wx / 0.5) AS INT) AS x, CAST(trunc(wy / 0.5) AS INT) AS y, CAST(trunc(wz / 0.5) AS INT) AS z FROM ({POINTS_SQL})""")
def world_to_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Grid((0.0, 0.0, 0.0), (50.0, 50.0, 50.0), 0.5)
    return points(spark, sf_dir).select("ok", "ln", *(grid.index(F.col(f"w{n}"), k).alias(n) for k, n in enumerate("xyz")))


@query(f"""SELECT ok, ln, 0.25 + (floor(wx) + 0.5) * 0.5 AS x, (floor(wy) + 0.5) * 0.5 AS y, (floor(wz) + 0.5) * 0.5 - 1 AS z FROM ({POINTS_SQL})""")
def voxel_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Grid((0.25, 0.0, -1.0), (50.0, 50.0, 50.0), 0.5)
    return points(spark, sf_dir).select("ok", "ln", *(grid.world(F.floor(f"w{n}"), k).alias(n) for k, n in enumerate("xyz")))


@query(f"""SELECT ok, ln, CAST(trunc(wx) AS BIGINT) + CAST(trunc(wy) AS BIGINT) * 64 + CAST(trunc(wz) AS BIGINT) * 4096 AS id,
  wx >= 0 AND trunc(wx) < 64 AND trunc(wy) >= 0 AND trunc(wy) < 64 AND trunc(wz) < 64 AS inside FROM (SELECT ok, ln, CASE WHEN trunc(wx) = 0 THEN 0.0 ELSE wx END AS wx, wy, wz FROM ({POINTS_SQL}))""")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [CUBE.index(F.col(f"w{n}"), k) for k, n in enumerate("xyz")]
    return points(spark, sf_dir).select("ok", "ln", CUBE.linear(*at).alias("id"), CUBE.contains(*at).alias("inside"))


@query(f"""SELECT flag, {', '.join(f'{f}(w{n}) AS {f}_{n}' for f in ('min', 'max') for n in 'xyz')} FROM ({POINTS_SQL}) GROUP BY flag""")
def bbox_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("flag").agg(*g.bounds(g.point("w")))


@query(f"""SELECT ok, ln, wx, wy, wz FROM ({POINTS_SQL}) WHERE wx BETWEEN 5 AND 20.75 AND wy BETWEEN 1.5 AND 30 AND wz BETWEEN 0 AND 40""")
def contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = g.const(5, 1.5, 0), g.const(20.75, 30, 40)
    return points(spark, sf_dir).where(g.box_contains(*box, g.point("w"))).select("ok", "ln", "wx", "wy", "wz")


@query(f"""SELECT ok, ln, least(wx, 10.0) AS x0, greatest(wx, 20.0) AS x1, least(wy, 10.0) AS y0, greatest(wy, 20.0) AS y1, least(wz, 10.0) AS z0, greatest(wz, 20.0) AS z1,
  (least(wx, 10.0) + greatest(wx, 20.0)) / 2 AS cx, greatest(wy, 20.0) - least(wy, 10.0) AS sy FROM ({POINTS_SQL})""")
def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = g.box_expanded(g.const(10, 10, 10), g.const(20, 20, 20), g.point("w"))
    ends = [c.alias(f"{n}{k}") for k, box in enumerate((lo, hi)) for n, c in zip("xyz", box)]
    return points(spark, sf_dir).select("ok", "ln", *ends, g.box_centre(lo, hi)[0].alias("cx"), g.box_size(lo, hi)[1].alias("sy"))


@query(f"""SELECT ok, ln, wx - 3.5 AS mx, wy - 1.25 AS my, wz + 2 AS mz, wx + 3.5 AS wx, wy + 1.25 AS wy, wz - 2 AS wz FROM ({POINTS_SQL})""")
def machine_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, origin = g.point("w"), g.const(3.5, 1.25, -2)
    to, back = g.machine_to_work(p, origin), g.work_to_machine(p, origin)
    return points(spark, sf_dir).select("ok", "ln", *(c.alias(f"m{n}") for n, c in zip("xyz", to)), *(c.alias(f"w{n}") for n, c in zip("xyz", back)))


@query("""SELECT p_partkey AS id, CASE WHEN h > 50 THEN 0.0 WHEN p_partkey % 2 = 0 AND h < d / 2 THEN round(sqrt(d / 2 * (d / 2) - (d / 2 - h) * (d / 2 - h)), 6) ELSE d / 2 END AS radius
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey % 60 AS DOUBLE) AS h FROM part)""")
def tool_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    r = g.tool_radius(h, d, F.lit(50.0), F.col("p_partkey") % 2 == 0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tidy(r).alias("radius"))


DIRECTION_SQL = "-sin(radians(b)) AS dx, cos(radians(b)) * sin(radians(a)) AS dy, -cos(radians(b)) * cos(radians(a)) AS dz"


@query(f"""SELECT id, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(dz, 6) + 0.0 AS dz FROM (SELECT id, {DIRECTION_SQL} FROM ({TURNS_SQL}))""")
def orientation_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", *(tidy(c).alias(f"d{n}") for n, c in zip("xyz", g.tool_direction(F.col("a"), F.col("b")))))


@query(f"""WITH t AS (SELECT id, x - 1 AS x, y - 2 AS y, z - 3 AS z, radians(a) AS a, radians(b) AS b, radians(c) AS c FROM ({TURNS_SQL})),
u AS (SELECT *, x * cos(c) - y * sin(c) AS x1, x * sin(c) + y * cos(c) AS y1 FROM t), v AS (SELECT *, x1 * cos(b) + z * sin(b) AS x2, -x1 * sin(b) + z * cos(b) AS z2 FROM u)
SELECT id, round(x2 + 1, 6) + 0.0 AS rx, round(y1 * cos(a) - z2 * sin(a) + 2, 6) + 0.0 AS ry, round(y1 * sin(a) + z2 * cos(a) + 3, 6) + 0.0 AS rz FROM v""")
def rotate_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = g.transformed(g.point(), F.col("a"), F.col("b"), F.col("c"), g.const(1, 2, 3))
    return turns(spark, sf_dir).select("id", *(tidy(c).alias(f"r{n}") for n, c in zip("xyz", turned)))


@query(f"""SELECT id, round(x - dx * 50, 6) + 0.0 AS sx, round(y - dy * 50, 6) + 0.0 AS sy, round(z - dz * 50, 6) + 0.0 AS sz FROM (SELECT *, {DIRECTION_SQL} FROM ({TURNS_SQL}))""")
def spindle_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = g.spindle_position(g.point(), F.col("a"), F.col("b"), F.lit(50.0))
    return turns(spark, sf_dir).select("id", *(tidy(c).alias(f"s{n}") for n, c in zip("xyz", at)))


@query(f"""SELECT id, round(a + (x - a) * t, 6) + 0.0 AS a, round(b + (y - b) * t, 6) + 0.0 AS b, round(c + (z - c) * t, 6) + 0.0 AS c FROM (SELECT *, greatest(0.0, least(1.0, (id % 13) / 10.0 - 0.1)) AS t FROM ({TURNS_SQL}))""")
def lerp_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = g.interpolated(g.point(names="abc"), g.point(), (F.col("id") % 13) / 10.0 - 0.1)
    return turns(spark, sf_dir).select("id", *(tidy(c).alias(n) for n, c in zip("abc", between)))


@query(f"""SELECT id, CASE WHEN abs(x - y) < 1e-8 THEN 1.0 ELSE round(1 + 2 * (x / (x - y)), 6) + 0.0 END AS px FROM ({TURNS_SQL})""")
def edge_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = g.zero_crossing(g.const(1, 0, 0), g.const(3, 0, 0), F.col("x"), F.col("y"))
    return turns(spark, sf_dir).select("id", tidy(at[0]).alias("px"))


@query(f"""SELECT id, CAST({' + '.join(f'(((id % 64) >> {k}) & 1) * {8**k} + (((id * 7 % 64) >> {k}) & 1) * {2 * 8**k} + (((id * 13 % 64) >> {k}) & 1) * {4 * 8**k}' for k in range(6))} AS BIGINT) AS path FROM ({TURNS_SQL})""")
def morton_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return turns(spark, sf_dir).select("id", g.morton(i % 64, i * 7 % 64, i * 13 % 64, 6).alias("path"))


# G-code


TEXT_SQL = """CASE WHEN seq % 11 = 0 THEN 'N' || CAST(seq AS {s}) || ' ' ELSE '' END || 'G' || CAST(code AS {s})
  || coalesce(' X' || CAST(CAST(x AS INT) AS {s}) || '.5', '') || coalesce(' Y' || CAST(CAST(y AS INT) AS {s}), '') || coalesce(' Z=' || CAST(CAST(z AS INT) AS {s}), '')
  || CASE WHEN seq % 6 = 0 THEN ' ; cut' WHEN seq % 7 = 0 THEN ' (note)' ELSE '' END"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("job_id", "seq", F.expr(TEXT_SQL.format(s="STRING")).alias("text"))


TEXT_DUCK = f"SELECT job_id, seq, code, {TEXT_SQL.format(s='VARCHAR')} AS text FROM ({WORDS_SQL})"


@query(f"""SELECT job_id, seq, 'GCode' AS type, code, CASE WHEN seq % 11 = 0 THEN CAST(seq AS INT) ELSE code END AS n,
  CAST(len(regexp_extract_all(text, ' [XYZ]')) AS INT) AS params, CAST(nullif(regexp_extract(text, ' X(-?[0-9.]+)', 1), '') AS DOUBLE) AS x,
  CAST(nullif(regexp_extract(text, ' Z=(-?[0-9]+)', 1), '') AS DOUBLE) AS z, nullif(regexp_extract(text, '[;(].*$'), '') AS comment FROM ({TEXT_DUCK})""")
def gcode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("params")
    return gcode.parsed(text_lines(spark, sf_dir)).select(
        "job_id", "seq", "type", "code", "n", F.size(p).alias("params"), gcode.find_number(p, "X").alias("x"), gcode.find_number(p, "Z").alias("z"), "comment"
    )


NUMBERS = "CASE CAST(id % 9 AS INT) WHEN 0 THEN {i} WHEN 1 THEN concat('-', {i}) WHEN 2 THEN concat({i}, '.') WHEN 3 THEN concat('.', {i}) WHEN 4 THEN concat('-', {i}, '.25') WHEN 5 THEN concat('+', {i}) WHEN 6 THEN concat({i}, 'e3') WHEN 7 THEN '-' ELSE concat({i}, '-') END"


@query(f"""SELECT id, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN 'Integer' WHEN regexp_full_match(s, '-?([0-9]+\\.[0-9]*|\\.[0-9]+)') THEN 'Decimal' ELSE 'NaN' END AS type
FROM (SELECT id, {NUMBERS.format(i='CAST(id AS VARCHAR)')} AS s FROM ({TURNS_SQL}))""")
def gcode_numtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", gcode.number_type(F.expr(NUMBERS.format(i="CAST(id AS STRING)"))).alias("type"))


@query(MODAL_SQL)
def gcode_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select("job_id", "seq", "kind", "x", "y", "z", "feed")


@query(f"""SELECT job_id, seq, CASE WHEN code = 0 THEN 'G0' ELSE 'G1' END AS kind, coalesce(last_value(tx IGNORE NULLS) OVER w, 0.0) AS x, coalesce(last_value(tz IGNORE NULLS) OVER w, 0.0) AS z
FROM (SELECT *, CAST(nullif(regexp_extract(text, ' X(-?[0-9.]+)', 1), '') AS DOUBLE) AS tx, CAST(nullif(regexp_extract(text, ' Z=(-?[0-9]+)', 1), '') AS DOUBLE) AS tz FROM ({TEXT_DUCK}))
WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def gcode_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to commands."""
    return toolpath.modal(moves(text_lines(spark, sf_dir), "job_id", "seq")).select("job_id", "seq", "kind", "x", "z")


def program_folder(spark: SparkSession, sf_dir: str) -> str:
    """The lines of each job as a file in shared storage, in order."""
    folder = shared_folder(spark, "programs")
    text_lines(spark, sf_dir).repartition("job_id").sortWithinPartitions("job_id", "seq").select("job_id", "text").write.partitionBy("job_id").text(folder)
    return folder


_JOB_OF = "CAST(regexp_extract({file}, 'job_id=(-?[0-9]+)', 1) AS BIGINT) AS job_id"
LINES_DUCK = f"SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS line_no FROM ({TEXT_DUCK})"


@query(f"SELECT job_id, CAST(line_no AS INT) AS line_no, text FROM ({LINES_DUCK})")
def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to numbered lines; each file is read by as many tasks as it has parts."""
    return read_lines(spark, program_folder(spark, sf_dir)).selectExpr(_JOB_OF.format(file="file"), "CAST(line_no AS INT) AS line_no", "text")


@query(f"""SELECT job_id, CAST(line_no AS INT) AS line_no, CASE WHEN code = 0 THEN 'G0' ELSE 'G1' END AS kind, {', '.join(f"coalesce(last_value(t{n} IGNORE NULLS) OVER w, 0.0) AS {n}" for n in 'xyz')}
FROM (SELECT *, {', '.join(f"CAST(nullif(regexp_extract(text, ' {n.upper()}=?(-?[0-9.]+)', 1), '') AS DOUBLE) AS t{n}" for n in 'xyz')} FROM ({LINES_DUCK}))
WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def program_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to commands: read, parsed, numbered and made modal with one exchange of rows."""
    got = read_program(spark, program_folder(spark, sf_dir))
    return got.selectExpr(_JOB_OF.format(file="job_id"), "CAST(seq AS INT) AS line_no", "kind", "x", "y", "z")


@query(SEGMENTS_SQL)
def segments_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("job_id", "seq", "kind", "feed", *(f"{n}{k}" for n in "xyz" for k in (0, 1)))


@query(f"""SELECT job_id, seq, kind, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM ({MODAL_SQL})) WHERE k > 10 AND k <= 35""")
def step_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.steps(commands(spark, sf_dir), 10, 25).select("job_id", "seq", "kind", "x", "y", "z")


@query(f"""SELECT job_id, count(*) AS total, least(25, count(*)) - 1 AS current, least(25, count(*)) - 1 >= count(*) - 1 AS completed FROM ({MODAL_SQL}) GROUP BY job_id""")
def step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.progress(commands(spark, sf_dir), 25)


def _rounded(prims: DataFrame) -> DataFrame:
    return prims.select("job_id", "seq", "part", "shape", *(tidy(F.col(f"{e}{n}")).alias(f"{e}{n}") for e in "ab" for n in "xyz"), "r")


_ROUNDED_SQL = "SELECT job_id, seq, part, shape, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay, round(az, 6) + 0.0 AS az, round(bx, 6) + 0.0 AS bx, round(by_, 6) + 0.0 AS by, round(bz, 6) + 0.0 AS bz, CAST(r AS DOUBLE) AS r FROM"


@query(f"{_ROUNDED_SQL} ({PRIMS3_SQL})")
def primitives_3axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(toolpath.primitives_3axis(segments(spark, sf_dir), TOOL, BED.res))


@query(f"{_ROUNDED_SQL} ({_prims5()})")
def primitives_5axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(toolpath.primitives_5axis(toolpath.segments(five_axis(spark, sf_dir)), TOOL5, BED.res))


# Removal


@query(SPHERE_CUT)
def sphere_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_cells(spark, sf_dir)


@query(_first(f"SELECT *, 'cylinder' AS shape FROM ({RODS_SQL})", CUBE))
def cylinder_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.removed(rods(spark, sf_dir, "cylinder"), CUBE)


@query(_first(f"SELECT *, 'capsule' AS shape FROM ({RODS_SQL})", CUBE))
def capsule_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.removed(rods(spark, sf_dir, "capsule"), CUBE)


def _bed_primitives(segs: DataFrame) -> DataFrame:
    return toolpath.primitives_3axis(segs, TOOL, BED.res)


def toolpath_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bed_primitives(segments(spark, sf_dir))


def toolpath_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.first_cuts(segments(spark, sf_dir), _bed_primitives, BED, reach=toolpath.reach_3axis(TOOL))


@query(FIRST_CUT)
def first_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.removed(toolpath_primitives(spark, sf_dir), BED)


@query(f"SELECT job_id, count(*) AS removed, {BED.cells} - count(*) AS remaining FROM ({FIRST_CUT}) GROUP BY job_id")
def material_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.material_count(runs.union(runs.tested(toolpath_primitives(spark, sf_dir), BED)), BED)


@query(f"SELECT job_id, first_cut AS seq, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) AS cells FROM ({FIRST_CUT}) GROUP BY ALL")
def changed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.changed_region(toolpath_cuts(spark, sf_dir))


@query(_first(f"SELECT *, 'capsule' AS shape FROM ({RODS_SQL})", CUBE))
def capsule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs along lines instead of tests of cells, and cells from their words."""
    return runs.cells(runs.first_cuts(runs.words(rods(spark, sf_dir, "capsule"), CUBE)))


@query(FIRST_CUT)
def toolpath_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cells(rounds.first_cuts(segments(spark, sf_dir), _bed_primitives, BED, runs.words, reach=toolpath.reach_3axis(TOOL)))


@query(f"SELECT job_id, count(*) AS cells FROM ({FIRST_CUT}) WHERE first_cut <= 500 GROUP BY job_id")
def state_after_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.count(runs.after(toolpath_cuts(spark, sf_dir), 500))


@query(f"SELECT x, y, z FROM ({CELLS_SQL}) WHERE material")
def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.occupied(spark, sphere_cells(spark, sf_dir), CUBE)


@query(CELLS_SQL)
def dense_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.dense(spark, sphere_cells(spark, sf_dir), CUBE)


@query(f"""SELECT p.ok, p.ln, p.wx, p.wy, p.wz, coalesce(c.material, false) AS material FROM ({POINTS_SQL}) p LEFT JOIN ({CELLS_SQL}) c
  ON c.x = CAST(trunc(p.wx) AS INT) AND c.y = CAST(trunc(p.wy) AS INT) AND c.z = CAST(trunc(p.wz) AS INT)""")
def voxel_at_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lattice.look_up_world(points(spark, sf_dir), sphere_cells(spark, sf_dir), CUBE)
    return got.select("ok", "ln", "wx", "wy", "wz", "material")


@query(f"""WITH e AS (SELECT x, y, z, first_cut AS seq, false AS material FROM ({SPHERE_CUT}) UNION ALL
  SELECT CAST(c_custkey % 70 AS INT), CAST(c_custkey * 3 % 64 AS INT), CAST(c_custkey * 5 % 64 AS INT), c_custkey + 1000000, c_custkey % 2 = 0 FROM customer WHERE c_custkey % 70 < 64)
SELECT x, y, z, max(seq) AS first_cut FROM e GROUP BY x, y, z HAVING NOT arg_max(material, seq)""")
def edited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    edits = table(spark, sf_dir, "customer").select(
        F.lit(0).cast("long").alias("job_id"), (k + 1_000_000).alias("seq"), (k % 70).cast("int").alias("x"), (k * 3 % 64).cast("int").alias("y"), (k * 5 % 64).cast("int").alias("z"), (k % 2 == 0).alias("material")
    )
    return lattice.edited(sphere_cells(spark, sf_dir), edits, CUBE).select("x", "y", "z", "first_cut")


@query(f"""WITH c AS (SELECT x, y, z FROM ({SPHERE_CUT})), l AS (SELECT CAST(i AS INT) AS level FROM range(7) t(i))
SELECT level, {'(' + ' + '.join(f'((((x >> (6 - level)) >> {k}) & 1) + (((y >> (6 - level)) >> {k}) & 1) * 2 + (((z >> (6 - level)) >> {k}) & 1) * 4) * {8**k}' for k in range(6)) + ')::BIGINT'} AS node, count(*) AS empty FROM c CROSS JOIN l GROUP BY 1, 2""")
def octree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.octree_counts(sphere_cells(spark, sf_dir), 6).select("level", "node", "empty")


# Distance fields


@query(SURFACE_SQL)
def surface26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.surface(lattice.dense(spark, sphere_cells(spark, sf_dir), CUBE), CUBE)


def field_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.field(sphere_words(spark, sf_dir), CUBE, BAND)


@query(f"SELECT x, y, z, round(d, 6) + 0.0 AS d FROM ({FIELD_SQL})")
def sdf_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_of(spark, sf_dir).select("x", "y", "z", tidy(F.col("d")).alias("d"))


def _near_sql() -> str:
    box = ", ".join(f"greatest(0, CAST(trunc(c{v}) AS INT) - CAST(ceil(r) AS INT)) AS l{v}, least(63, CAST(trunc(c{v}) AS INT) + CAST(ceil(r) AS INT)) AS h{v}" for v in "xyz")
    cells = f"SELECT * FROM (SELECT *, {box} FROM ({SPHERES_SQL}) p) q, LATERAL (SELECT unnest(range(lx, hx + 1)) AS x) ux, LATERAL (SELECT unnest(range(ly, hy + 1)) AS y) uy, LATERAL (SELECT unnest(range(lz, hz + 1)) AS z) uz"
    d = "sqrt((x + 0.5 - cx) * (x + 0.5 - cx) + (y + 0.5 - cy) * (y + 0.5 - cy) + (z + 0.5 - cz) * (z + 0.5 - cz)) - r"
    return f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, min({d}) AS d FROM ({cells}) WHERE {d} < 10 GROUP BY 1, 2, 3"


@query(f"SELECT x, y, z, round(d, 6) + 0.0 AS d FROM ({_near_sql()})")
def sdf_sphere_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.from_primitives(spheres(spark, sf_dir), CUBE, BAND).select("x", "y", "z", tidy(F.col("d")).alias("d"))


def _node_value(v: str) -> str:
    return f"CASE WHEN {v}x BETWEEN 0 AND 63 AND {v}y BETWEEN 0 AND 63 AND {v}z BETWEEN 0 AND 63 THEN f.d ELSE -least(10.0, sqrt(" + " + ".join(f"pow(greatest(0.0, -0.5 - {v}{n}, {v}{n} - 63.5), 2)" for n in "xyz") + ")) END"


def _trilinear_sql(points_: str, keys: str) -> str:
    """SQL for the value at wx, wy, wz of each row of ``points_``."""
    based = f"SELECT *, {', '.join(f'CAST(floor(w{n}) AS INT) AS i{n}, w{n} - floor(w{n}) AS t{n}' for n in 'xyz')} FROM ({points_})"
    weight = " * ".join(f"(CASE WHEN o{n} = 1 THEN t{n} ELSE 1 - t{n} END)" for n in "xyz")
    nodes = f"SELECT {keys}, {', '.join(f'i{n} + o{n} AS q{n}' for n in 'xyz')}, {weight} AS w FROM ({based}) CROSS JOIN (SELECT a.i AS ox, b.i AS oy, c.i AS oz FROM range(2) a(i), range(2) b(i), range(2) c(i))"
    return f"SELECT {keys}, sum(w * {_node_value('q')}) AS d FROM ({nodes}) LEFT JOIN field f ON f.x = qx AND f.y = qy AND f.z = qz WHERE w <> 0 GROUP BY {keys}"


#: The places that rows of lineitem stand at; many share one. ``trilinear`` and ``gradient``
#: give one row for each place, ``trilinear_points`` and ``gradient_points`` one for each row.
PLACES_SQL = f"SELECT DISTINCT wx, wy, wz FROM ({POINTS_SQL})"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("wx", "wy", "wz").distinct()


@query(f"WITH field AS MATERIALIZED ({FIELD_SQL}) SELECT px, py, pz, round(d, 6) + 0.0 AS d FROM ({_trilinear_sql(f'SELECT wx AS px, wy AS py, wz AS pz, wx, wy, wz FROM ({PLACES_SQL})', 'px, py, pz')})")
def trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(spark, sf_dir).select("*", *(F.col(f"w{n}").alias(f"p{n}") for n in "xyz"))
    return lookups.sample(at, sphere_words(spark, sf_dir), CUBE, BAND, ("px", "py", "pz")).withColumn("d", tidy(F.col("d")))


_MOVED = " UNION ALL ".join(
    f"SELECT wx AS px, wy AS py, wz AS pz, {k} AS axis, {s} AS sign, " + ", ".join(f"w{m} + {s if m == n else 0} AS w{m}" for m in "xyz") + f" FROM ({PLACES_SQL})" for k, n in enumerate("xyz") for s in (1, -1)
)


@query(f"""WITH field AS MATERIALIZED ({FIELD_SQL}), v AS ({_trilinear_sql(_MOVED, 'px, py, pz, axis, sign')}),
s AS (SELECT px, py, pz, {', '.join(f'sum(CASE WHEN axis = {k} THEN sign * d ELSE 0 END) / 2 AS g{n}' for k, n in enumerate('xyz'))} FROM v GROUP BY px, py, pz),
u AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS n FROM s)
SELECT px, py, pz, CASE WHEN n > 1e-6 THEN round(gx / n, 5) + 0.0 ELSE 0.0 END AS gx, CASE WHEN n > 1e-6 THEN round(gy / n, 5) + 0.0 ELSE 1.0 END AS gy, CASE WHEN n > 1e-6 THEN round(gz / n, 5) + 0.0 ELSE 0.0 END AS gz FROM u""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(spark, sf_dir).select("*", *(F.col(f"w{n}").alias(f"p{n}") for n in "xyz"))
    got = lookups.gradient(at, sphere_words(spark, sf_dir), CUBE, BAND, ("px", "py", "pz"))
    return got.select("px", "py", "pz", *(tidy(F.col(f"g{n}"), 5).alias(f"g{n}") for n in "xyz"))


def _at_points_sql(name: str, values: str) -> str:
    return f"SELECT p.ok, p.ln, p.wx, p.wy, p.wz, {values} FROM ({POINTS_SQL}) p LEFT JOIN ({ORACLES[name]}) v ON v.px = p.wx AND v.py = p.wy AND v.pz = p.wz"


def at_points(spark: SparkSession, sf_dir: str, values: DataFrame) -> DataFrame:
    """Every row of lineitem with the values of its place; a place is computed once."""
    every = points(spark, sf_dir).select("ok", "ln", "wx", "wy", "wz")
    return every.join(values.withColumnsRenamed({f"p{n}": f"w{n}" for n in "xyz"}), ["wx", "wy", "wz"], "left")


@query(_at_points_sql("trilinear", "v.d"))
def trilinear_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(spark, sf_dir, trilinear(spark, sf_dir)).select("ok", "ln", "wx", "wy", "wz", "d")


@query(_at_points_sql("gradient", "v.gx, v.gy, v.gz"))
def gradient_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(spark, sf_dir, gradient(spark, sf_dir)).select("ok", "ln", "wx", "wy", "wz", "gx", "gy", "gz")


@query(f"""SELECT x >> 2 AS cx, y >> 2 AS cy, z >> 2 AS cz, round(min(d), 6) AS least, round(max(d), 6) AS greatest, sign(min(d)) = sign(max(d)) AND max(d) - min(d) < 1 AS leaf FROM ({FIELD_SQL}) GROUP BY 1, 2, 3""")
def octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sdf.octree_leaves(field_of(spark, sf_dir), CUBE, 2)
    return got.select("cx", "cy", "cz", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), "leaf")


# Meshes


def face_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.faces(spark, sphere_cells(spark, sf_dir), CUBE)


@query(FACES_SQL)
def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face_table(spark, sf_dir)


CORNER_ROWS = f"""SELECT f.x, f.y, f.z, f.side, c.corner, CAST((f.x + ox) + (f.y + oy) * 65 + (f.z + oz) * 4225 AS BIGINT) AS vid, f.x + ox AS vx, f.y + oy AS vy, f.z + oz AS vz, nx, ny, nz FROM ({FACES_SQL}) f JOIN ({CORNERS_SQL}) c ON c.side = f.side"""


@query(f"""SELECT vid, CAST(vx AS DOUBLE) AS x, CAST(vy AS DOUBLE) AS y, CAST(vz AS DOUBLE) AS z, uses, {', '.join(f'CASE WHEN n > 0 THEN round(s{a} / n, 6) + 0.0 END AS n{a}' for a in 'xyz')}
FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM (SELECT vid, vx, vy, vz, count(*) AS uses, CAST(sum(nx) AS DOUBLE) AS sx, CAST(sum(ny) AS DOUBLE) AS sy, CAST(sum(nz) AS DOUBLE) AS sz FROM ({CORNER_ROWS}) GROUP BY 1, 2, 3, 4))""")
def weld_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mesh.vertices(mesh.quads(face_table(spark, sf_dir), CUBE), CUBE)
    return got.select("vid", "x", "y", "z", "uses", *(tidy(F.col(f"n{n}")).alias(f"n{n}") for n in "xyz"))


QUAD_ROWS = f"SELECT x, y, z, side, {', '.join(f'max(CASE WHEN corner = {i} THEN vid END) AS v{i}' for i in range(4))} FROM ({CORNER_ROWS}) GROUP BY 1, 2, 3, 4"
_TID = "(((CAST(z AS BIGINT) * 1048576 + y) * 1048576) + x) * 12 + side * 2"


@query(f"SELECT {_TID} AS tid, v0 AS i0, v1 AS i1, v2 AS i2 FROM ({QUAD_ROWS}) UNION ALL SELECT {_TID} + 1, v0, v2, v3 FROM ({QUAD_ROWS})")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangles(mesh.quads(face_table(spark, sf_dir), CUBE))


@query(f"""SELECT {_TID} + h AS tid, CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny, CAST(nz AS DOUBLE) AS nz FROM (SELECT DISTINCT x, y, z, side, nx, ny, nz FROM ({CORNER_ROWS})), (SELECT CAST(i AS INT) AS h FROM range(2) t(i))""")
def facet_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = mesh.quads(face_table(spark, sf_dir), CUBE)
    got = mesh.facets(mesh.triangles(quads), CUBE)
    return got.select("tid", *(tidy(F.col(f"n{n}")).alias(f"n{n}") for n in "xyz"))


_HALF = ", ".join(f"CAST(max(CASE WHEN corner = CASE h WHEN 0 THEN {a} ELSE {b} END THEN v{n} END) AS DOUBLE) AS v{i}{n}" for i, (a, b) in enumerate(((0, 0), (1, 2), (2, 3)), 1) for n in "xyz")


@query(f"""SELECT CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny, CAST(nz AS DOUBLE) AS nz, {_HALF} FROM ({CORNER_ROWS}), (SELECT CAST(i AS INT) AS h FROM range(2) t(i)) GROUP BY x, y, z, side, h, nx, ny, nz""")
def stl_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface written in parts with one commit, and its records read back."""
    folder = shared_folder(spark, "stl")
    stl.write_parts(mesh.facets(mesh.triangles(mesh.quads(face_table(spark, sf_dir), CUBE)), CUBE), folder)
    return stl.read(spark, folder).select(*((F.col(c).cast("double") + 0.0).alias(c) for c in stl.FIELDS))


@query(f"SELECT x, y, z, {', '.join(f'round(c{k}, 6) + 0.0 AS c{k}' for k in range(8))} FROM ({DUAL_CELLS_SQL})")
def dc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mesh.dual_cells(field_of(spark, sf_dir), CUBE, BAND)
    return got.select("x", "y", "z", *(tidy(F.col(f"c{k}")).alias(f"c{k}") for k in range(8)))


def _dual_vertex_sql() -> str:
    """Mean of crossings over the twelve edges, by coordinates."""
    parts = []
    for a, b in ((0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)):
        t = f"(c{a} / (c{a} - c{b}))"
        at = ", ".join(f"{n} + {a >> k & 1} + {t} * {(b >> k & 1) - (a >> k & 1)} AS w{n}" for k, n in enumerate("xyz"))
        parts.append(f"SELECT x, y, z, {at} FROM cells WHERE (c{a} > 0) <> (c{b} > 0)")
    return f"WITH cells AS MATERIALIZED ({DUAL_CELLS_SQL}) SELECT x, y, z, avg(wx) AS px, avg(wy) AS py, avg(wz) AS pz FROM ({' UNION ALL '.join(parts)}) GROUP BY x, y, z"


@query(f"SELECT x, y, z, round(px, 5) + 0.0 AS px, round(py, 5) + 0.0 AS py, round(pz, 5) + 0.0 AS pz FROM ({_dual_vertex_sql()})")
def dc_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mesh.dual_vertices(field_of(spark, sf_dir), CUBE, BAND, normals=False)
    return got.select("x", "y", "z", *(tidy(F.col(f"p{n}"), 5).alias(f"p{n}") for n in "xyz"))


def _dual_normals_sql() -> str:
    """With tables: cells, their crossings, the gradient at each, and ``dv``: vertices with the mean of these gradients."""
    parts, n = [], "sqrt(gx * gx + gy * gy + gz * gz)"
    for e, (a, b) in enumerate(((0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7))):
        at = ", ".join(f"{c} + {a >> k & 1} + (c{a} / (c{a} - c{b})) * {(b >> k & 1) - (a >> k & 1)} AS w{c}" for k, c in enumerate("xyz"))
        parts.append(f"SELECT x, y, z, {e} AS edge, {at} FROM cells WHERE (c{a} > 0) <> (c{b} > 0)")
    moved = " UNION ALL ".join(
        f"SELECT x AS cx, y AS cy, z AS cz, edge, {k} AS axis, {s} AS sign, " + ", ".join(f"w{m} + {s if m == c else 0} AS w{m}" for m in "xyz") + " FROM crossings" for k, c in enumerate("xyz") for s in (1, -1)
    )
    unit = lambda v, other: f"CASE WHEN n > 1e-6 THEN {v} / n ELSE {other} END"
    final = lambda v, other: f"CASE WHEN m > 1e-4 THEN s{v} / m WHEN o > 1e-4 THEN o{v} / o ELSE {other} END AS n{v}"
    return f"""WITH field AS MATERIALIZED ({FIELD_SQL}), cells AS MATERIALIZED ({DUAL_CELLS_SQL}), crossings AS MATERIALIZED ({' UNION ALL '.join(parts)}),
v AS ({_trilinear_sql(moved, 'cx, cy, cz, edge, axis, sign')}),
g AS (SELECT *, {n} AS n FROM (SELECT cx, cy, cz, edge, {', '.join(f'sum(CASE WHEN axis = {k} THEN sign * d ELSE 0 END) / 2 AS g{c}' for k, c in enumerate('xyz'))} FROM v GROUP BY ALL)),
s AS (SELECT cx AS x, cy AS y, cz AS z, sum({unit('gx', 0.0)}) AS sx, sum({unit('gy', 1.0)}) AS sy, sum({unit('gz', 0.0)}) AS sz FROM g GROUP BY ALL),
p AS (SELECT x, y, z, avg(wx) AS px, avg(wy) AS py, avg(wz) AS pz FROM crossings GROUP BY ALL),
q AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS m, sqrt(ox * ox + oy * oy + oz * oz) AS o FROM (SELECT *, px - (x + 0.5) AS ox, py - (y + 0.5) AS oy, pz - (z + 0.5) AS oz FROM p JOIN s USING (x, y, z))),
dv AS MATERIALIZED (SELECT x, y, z, px, py, pz, {final('x', 0.0)}, {final('y', 1.0)}, {final('z', 0.0)} FROM q)"""


@query(f"{_dual_normals_sql()} SELECT x, y, z, {', '.join(f'round(p{n}, 5) + 0.0 AS p{n}, round(n{n}, 4) + 0.0 AS n{n}' for n in 'xyz')} FROM dv")
def dc_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the dual contour with the mean of the gradients at their crossings."""
    got = mesh.dual_vertices(field_of(spark, sf_dir), CUBE, BAND)
    return got.select("x", "y", "z", *(tidy(F.col(f"p{n}"), 5).alias(f"p{n}") for n in "xyz"), *(tidy(F.col(f"n{n}"), 4).alias(f"n{n}") for n in "xyz"))


def _dual_triangles_sql() -> str:
    rings = []
    for axis, ring in enumerate((((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)))):
        joins = " ".join(f"JOIN dv c{i} ON c{i}.x = c0.x + {o[0]} AND c{i}.y = c0.y + {o[1]} AND c{i}.z = c0.z + {o[2]}" for i, o in enumerate(ring) if i)
        cols = ", ".join(f"c{i}.p{n} AS p{i}{n}" for i in range(4) for n in "xyz")
        mean = ", ".join(f"(c0.n{n} + c1.n{n} + c2.n{n} + c3.n{n}) / 4 AS m{n}" for n in "xyz")
        rings.append(f"SELECT c0.x, c0.y, c0.z, {axis} AS axis, {cols}, {mean} FROM dv c0 {joins} WHERE c0.x < 64 AND c0.y < 64 AND c0.z < 64")
    cross = ", ".join(
        f"(p1{a} - p0{a}) * (p2{b} - p0{b}) - (p1{b} - p0{b}) * (p2{a} - p0{a}) AS f{n}" for n, a, b in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))
    )
    corner = ", ".join(
        f"round(CASE WHEN flip THEN CASE h WHEN 0 THEN p{(0, 2, 1)[j]}{n} ELSE p{(0, 3, 2)[j]}{n} END ELSE CASE h WHEN 0 THEN p{(0, 1, 2)[j]}{n} ELSE p{(0, 2, 3)[j]}{n} END END, 5) + 0.0 AS v{j + 1}{n}"
        for j in range(3) for n in "xyz"
    )
    return f"""{_dual_normals_sql()}, r AS ({' UNION ALL '.join(rings)}), f AS (SELECT *, {cross} FROM r),
k AS (SELECT *, fx * mx + fy * my + fz * mz < -1e-9 AS flip FROM f WHERE fx * fx + fy * fy + fz * fz >= 1e-8 AND mx * mx + my * my + mz * mz >= 1e-8)
SELECT (((CAST(z AS BIGINT) + 1) * 1048576 + y + 1) * 1048576 + x + 1) * 6 + axis * 2 + h AS tid, {corner} FROM k, (SELECT CAST(i AS INT) AS h FROM range(2) t(i))"""


@query(_dual_triangles_sql())
def dc_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of the dual contour, wound to agree with the normals of their vertices."""
    quads = mesh.dual_quads(mesh.dual_vertices(field_of(spark, sf_dir), CUBE, BAND), CUBE)
    return mesh.dual_triangles(quads).select("tid", *(tidy(F.col(f"v{i}{n}"), 5).alias(f"v{i}{n}") for i in (1, 2, 3) for n in "xyz"))


def _dual_quads_sql() -> str:
    rings = []
    yz, zx, xy = ((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))
    for axis, ring in enumerate((yz, zx, xy)):
        joins = " ".join(f"JOIN c c{i} ON c{i}.x = c0.x + {o[0]} AND c{i}.y = c0.y + {o[1]} AND c{i}.z = c0.z + {o[2]}" for i, o in enumerate(ring) if i)
        rings.append(f"SELECT c0.x, c0.y, c0.z, {axis} AS axis FROM c c0 {joins} WHERE c0.x < 64 AND c0.y < 64 AND c0.z < 64")
    return f"WITH c AS MATERIALIZED (SELECT x, y, z FROM ({DUAL_CELLS_SQL})) {' UNION ALL '.join(rings)}"


@query(_dual_quads_sql())
def dc_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = mesh.dual_vertices(field_of(spark, sf_dir), CUBE, BAND, normals=False)
    flat = vertices.withColumns({f"n{n}": F.lit(0.0) for n in "xyz"})
    return mesh.dual_quads(flat, CUBE).select("x", "y", "z", "axis")


# Further forms of the operators above

@query(f"""SELECT ok, ln, wx + 1.5 AS x0, wy - 2 AS y0, wz + 0.25 AS z0, wx + 4.5 AS x1, wy AS y1, wz + 2.25 AS z1 FROM ({POINTS_SQL})""")
def box_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.point("w")
    lo, hi = g.box_moved(p, g.add(p, g.const(3, 2, 2)), g.const(1.5, -2, 0.25))
    return points(spark, sf_dir).select("ok", "ln", *(c.alias(f"{n}{k}") for k, box in enumerate((lo, hi)) for n, c in zip("xyz", box)))


@query(f"""WITH e AS (SELECT x, y, z, first_cut AS seq, false AS material FROM ({SPHERE_CUT}) UNION ALL
  SELECT CAST(trunc(wx) AS INT), CAST(trunc(wy) AS INT), CAST(trunc(wz) AS INT), ok * 10 + ln + 1000000, (ok + ln) % 2 = 0 FROM ({POINTS_SQL}) WHERE trunc(wx) BETWEEN 0 AND 63 AND trunc(wy) BETWEEN 0 AND 63 AND trunc(wz) BETWEEN 0 AND 63)
SELECT x, y, z, max(seq) AS first_cut FROM e GROUP BY x, y, z HAVING NOT arg_max(material, seq)""")
def edited_at_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("ok") * 10 + F.col("ln") + 1_000_000
    edits = points(spark, sf_dir).select(F.lit(0).cast("long").alias("job_id"), seq.alias("seq"), "wx", "wy", "wz", ((F.col("ok") + F.col("ln")) % 2 == 0).alias("material"))
    return lattice.edited(sphere_cells(spark, sf_dir), lattice.edits_at(edits, CUBE), CUBE).select("x", "y", "z", "first_cut")


#: A tool that stands at each sphere's centre: a ball, and a shaft of 8 above it.
STANDING = Tool(6.0, 8.0, True)


def _standing_sql(shaft: str) -> str:
    ball = f"SELECT job_id, seq, 'sphere' AS shape, cx AS ax, cy AS ay, cz AS az, cx AS bx, cy AS by_, cz AS bz, 3.0::DOUBLE AS r FROM ({SPHERES_SQL})"
    return f"{ball} UNION ALL SELECT job_id, seq, '{shaft}', cx, cy, cz, cx, cy, cz + 8, 3.0::DOUBLE FROM ({SPHERES_SQL})"


def standing(spark: SparkSession, sf_dir: str, field: bool) -> DataFrame:
    at = derived(spark, sf_dir, SPHERES_SQL, "part").select("job_id", "seq", *(F.col(f"c{n}").alias(n) for n in "xyz"))
    return toolpath.primitives_point(at, STANDING, field)


@query(_first(_standing_sql("cylinder"), CUBE))
def point_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.removed(standing(spark, sf_dir, False), CUBE)


def _below_band(prims: str, grid: Grid, band: float) -> str:
    """SQL for the least signed distance of spheres and capsules, over the cells of each one's index box."""
    n, lo, res = grid.dims, grid.lo, grid.res
    cell = lambda v, k: f"CAST(trunc(({v} - ({lo[k]})) / {res}) AS INT)"
    box = ", ".join(
        f"greatest(0, CASE WHEN shape = 'sphere' THEN {cell(f'a{v}', k)} - CAST(ceil(r / {res}) AS INT) ELSE {cell(f'(least(a{v}, b{c}) - r)', k)} END) AS l{v}, "
        f"least({n[k] - 1}, CASE WHEN shape = 'sphere' THEN {cell(f'a{v}', k)} + CAST(ceil(r / {res}) AS INT) ELSE {cell(f'(greatest(a{v}, b{c}) + r)', k)} END) AS h{v}"
        for k, (v, c) in enumerate(zip("xyz", ("x", "y_", "z")))
    )
    cells = f"SELECT * FROM (SELECT *, {box} FROM ({prims}) p) q, LATERAL (SELECT unnest(range(lx, hx + 1)) AS x) ux, LATERAL (SELECT unnest(range(ly, hy + 1)) AS y) uy, LATERAL (SELECT unnest(range(lz, hz + 1)) AS z) uz"
    at = ", ".join(f"({lo[k]}) + ({v} + 0.5) * {res} AS p{v}" for k, v in enumerate("xyz"))
    along = "((px-ax)*(bx-ax) + (py-ay)*(by_-ay) + (pz-az)*(bz-az))"
    t = f"SELECT *, CASE WHEN shape = 'sphere' THEN 0.0 ELSE greatest(0.0, least(1.0, {along} / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)))) END AS t FROM (SELECT *, {at} FROM ({cells}))"
    off = " + ".join(f"pow(p{v} - (a{v} + t * (b{c} - a{v})), 2)" for v, c in zip("xyz", ("x", "y_", "z")))
    d = f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, sqrt({off}) - r AS d FROM ({t})"
    return f"SELECT x, y, z, round(min(d), 6) + 0.0 AS d FROM ({d}) WHERE d < {band} GROUP BY x, y, z"


@query(_below_band(_standing_sql("capsule"), CUBE, BAND))
def point_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.from_primitives(standing(spark, sf_dir, True), CUBE, BAND).select("x", "y", "z", tidy(F.col("d")).alias("d"))


@query(_below_band(f"SELECT *, 'capsule' AS shape FROM ({RODS_SQL})", CUBE, BAND))
def sdf_capsule_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.from_primitives(rods(spark, sf_dir, "capsule"), CUBE, BAND).select("x", "y", "z", tidy(F.col("d")).alias("d"))


@query(f"{_ROUNDED_SQL} ({PRIMS3_SQL.replace(chr(39) + 'cylinder' + chr(39), chr(39) + 'capsule' + chr(39))})")
def primitives_3axis_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As distance fields take them: shapes are rounded and steps half a radius, which is the same here."""
    return _rounded(toolpath.primitives_3axis(segments(spark, sf_dir), TOOL, BED.res, field=True))


@query(f"{_ROUNDED_SQL} ({_prims5(2.5 * BED.res, 'capsule')})")
def primitives_5axis_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(toolpath.primitives_5axis(toolpath.segments(five_axis(spark, sf_dir)), TOOL5, BED.res, field=True))


@query(f"SELECT x, y, z, x + 0.5 AS wx, y + 0.5 AS wy, z + 0.5 AS wz, (z + 0.5) / 64 AS red, 0.0 AS green, 1 - (z + 0.5) / 64 AS blue FROM ({CELLS_SQL}) WHERE material")
def coloured_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.coloured(lattice.occupied(spark, sphere_cells(spark, sf_dir), CUBE), CUBE)


def _nearest_sql() -> str:
    around = " OR ".join(f"coalesce(lag(material) OVER w{n} <> material, true) OR coalesce(lead(material) OVER w{n} <> material, true)" for n in "xyz")
    windows = ", ".join(f"w{n} AS (PARTITION BY {', '.join(m for m in 'xyz' if m != n)} ORDER BY {n})" for n in "xyz")
    return f"""WITH s AS MATERIALIZED (SELECT x, y, z, material, ({around}) AS surface FROM ({CELLS_SQL}) WINDOW {windows}),
o AS (SELECT CAST(a.i AS INT) AS ox, CAST(b.i AS INT) AS oy, CAST(c.i AS INT) AS oz, CAST(a.i*a.i + b.i*b.i + c.i*c.i AS INT) AS d2 FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i)),
n AS (SELECT x + ox AS x, y + oy AS y, z + oz AS z, min(d2) AS d2, min(struct_pack(d := d2, z := z, y := y, x := x)) AS m FROM s, o WHERE surface GROUP BY 1, 2, 3)
SELECT s.x, s.y, s.z, round(least(10.0, coalesce(sqrt(n.d2), 10.0)) * CASE WHEN material THEN 1 ELSE -1 END, 6) + 0.0 AS d, coalesce(n.m.x, -1) AS sx, coalesce(n.m.y, -1) AS sy, coalesce(n.m.z, -1) AS sz
FROM s LEFT JOIN n ON n.x = s.x AND n.y = s.y AND n.z = s.z"""


@query(_nearest_sql())
def nearest_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sdf.nearest_to_removed(sphere_cells(spark, sf_dir), CUBE, 2, BAND)
    return got.select("x", "y", "z", tidy(F.col("d")).alias("d"), *(F.coalesce(f"s{n}", F.lit(-1)).alias(f"s{n}") for n in "xyz"))


def _nearest_far_sql(radius: int) -> str:
    """The nearest of the surface along x, of these along y, and of these along z."""
    flagged = _nearest_sql().split("),\no AS (")[0] + ")"
    along = lambda src, n: f"SELECT {', '.join(f'{m} + o.i AS {m}' if m == n else m for m in 'xyz')}, min(struct_pack(d := m.d + o.i * o.i, z := m.z, y := m.y, x := m.x)) AS m FROM {src}, range(-{radius}, {radius + 1}) o(i) GROUP BY 1, 2, 3"
    return f"""{flagged}, s0 AS (SELECT x, y, z, struct_pack(d := 0, z := z, y := y, x := x) AS m FROM s WHERE surface),
sx AS MATERIALIZED ({along('s0', 'x')}), sy AS MATERIALIZED ({along('sx', 'y')}), n AS MATERIALIZED ({along('sy', 'z')})
SELECT s.x, s.y, s.z, round(least(10.0, coalesce(sqrt(n.m.d), 10.0)) * CASE WHEN material THEN 1 ELSE -1 END, 6) + 0.0 AS d, CAST(coalesce(n.m.x, -1) AS INT) AS sx, CAST(coalesce(n.m.y, -1) AS INT) AS sy, CAST(coalesce(n.m.z, -1) AS INT) AS sz
FROM s LEFT JOIN n ON n.x = s.x AND n.y = s.y AND n.z = s.z"""


@query(_nearest_far_sql(8))
def nearest_surface_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As nearest_surface, within eight cells along each axis."""
    got = sdf.nearest_to_removed(sphere_cells(spark, sf_dir), CUBE, 8, BAND)
    return got.select("x", "y", "z", tidy(F.col("d")).alias("d"), *(F.coalesce(f"s{n}", F.lit(-1)).alias(f"s{n}") for n in "xyz"))


def _octree_sql() -> str:
    """Leaves by what holds for whole cubes: a cube merges where it is even; a leaf is one that merges and whose parent doesn't."""
    cube = lambda k: f"SELECT x >> {k} AS cx, y >> {k} AS cy, z >> {k} AS cz, min(d) AS lo, max(d) AS hi, {'true' if k == 0 else 'sign(min(d)) = sign(max(d)) AND max(d) - min(d) < 1'} AS even FROM f GROUP BY 1, 2, 3"
    leaves = [f"SELECT {k} AS level, a.cx, a.cy, a.cz, round((a.lo + a.hi) / 2, 6) + 0.0 AS value FROM n{k} a JOIN n{k + 1} b ON b.cx = a.cx >> 1 AND b.cy = a.cy >> 1 AND b.cz = a.cz >> 1 WHERE a.even AND NOT b.even" for k in range(3)]
    leaves.append("SELECT 3 AS level, cx, cy, cz, round((lo + hi) / 2, 6) + 0.0 AS value FROM n3 WHERE even")
    return f"WITH f AS MATERIALIZED ({FIELD_SQL}), {', '.join(f'n{k} AS MATERIALIZED ({cube(k)})' for k in range(4))} {' UNION ALL '.join(leaves)}"


@query(_octree_sql())
def octree_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.octree(field_of(spark, sf_dir), CUBE, 3).withColumn("value", tidy(F.col("value")))


def _octree_samples_sql() -> str:
    """Level by level from the root: nodes of open parents, with the least and greatest of nine cells of the field."""
    parts = [f"f AS MATERIALIZED ({ORACLES['sdf_sphere_min']})", f"""d AS MATERIALIZED (SELECT l.x, l.y, l.z, least(coalesce(f.d, {BAND}.0), {BAND}.0) AS d FROM (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z
  FROM range(64) a(i), range(64) b(i), range(64) c(i)) l LEFT JOIN f ON l.x = f.x AND l.y = f.y AND l.z = f.z)"""]
    cube, leaves = lambda k: ", ".join(f"{n} >> {k} AS c{n}" for n in "xyz"), []
    for k in range(6, -1, -1):
        size = 1 << k
        corner = " AND ".join(f"{n} & {size - 1} IN (0, {size - 1})" for n in "xyz")
        middle = " AND ".join(f"{n} & {size - 1} = {size // 2}" for n in "xyz")
        parts.append(f"s{k} AS (SELECT {cube(k)}, min(d) AS lo, max(d) AS hi FROM d WHERE ({corner}) OR ({middle}) GROUP BY 1, 2, 3)")
        here = f"s{k} s" if k == 6 else f"s{k} s JOIN n{k + 1} p ON p.cx = s.cx >> 1 AND p.cy = s.cy >> 1 AND p.cz = s.cz >> 1 AND NOT p.even"
        parts.append(f"n{k} AS MATERIALIZED (SELECT s.cx, s.cy, s.cz, s.lo, s.hi, {'true' if k == 0 else '(s.lo > 0 OR s.hi <= 0) AND s.hi - s.lo < 1'} AS even FROM {here})")
        leaves.append(f"SELECT {k} AS level, cx, cy, cz, round((lo + hi) / 2, 6) + 0.0 AS value FROM n{k} WHERE even")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(leaves)}"


@query(_octree_samples_sql())
def octree_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves from the root down, by samples of the field of primitives; no dense lattice."""
    return adaptive.octree(sdf_sphere_min(spark, sf_dir), CUBE, BAND).withColumn("value", tidy(F.col("value")))


@query(
    _below_band(
        """SELECT 'sphere' AS shape, 0.0 AS ax, 0.0 AS ay, 0.0 AS az, 0.0 AS bx, 0.0 AS by_, 0.0 AS bz, 50.0::DOUBLE AS r UNION ALL SELECT 'capsule', -40, 0, 50, 40, 0, 50, 10
UNION ALL SELECT 'capsule', 50, -40, 0, 50, 40, 0, 10 UNION ALL SELECT 'capsule', 0, 50, -40, 0, 50, 40, 10""",
        Grid.centred((100, 100, 100), 1.0), 2.0,
    )
)
def demo_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads no table: a fixed scene."""
    return scenarios.demo_scene(spark).select("x", "y", "z", tidy(F.col("d")).alias("d"))


# Over time


@query(f"""SELECT date_trunc('hour', e.ts) AS start, CAST(sum(c.n) AS BIGINT) AS cells, CAST(sum(c.n) * {BED.res**3} AS DOUBLE) AS volume
FROM (SELECT job_id, first_cut, count(*) AS n FROM ({FIRST_CUT}) GROUP BY ALL) c JOIN ({WORDS_SQL}) e ON e.job_id = c.job_id AND e.seq = c.first_cut GROUP BY 1""")
def volume_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = first_cut(spark, sf_dir).groupBy("job_id", F.col("first_cut").alias("seq")).agg(F.count("*").alias("cells"))
    when = words(spark, sf_dir).select("job_id", "seq", "ts")
    return incremental.volume_by_window(when.join(cut, ["job_id", "seq"]).select("ts", "cells"), BED)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job: cells removed and left, and the first and last command that cut anything."""
    cut = first_cut(spark, sf_dir)
    ends = cut.groupBy("job_id").agg(F.min("first_cut").alias("first"), F.max("first_cut").alias("last"))
    return lattice.material_count(cut, BED).join(ends, "job_id")
