"""G-code, toolpaths, configuration, geometry functions, the facade and streams."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from kerf.functions import gcode
from kerf.functions import geometry as g
from kerf.grid import Grid
from kerf.operators import lattice
from kerf.plans import toolpath as T
from kerf.plans.toolpath import Tool
from kerf.simulation import Simulation
from kerf.sources import config
from kerf.sources import gcode as files
from kerf.streaming import incremental

PROGRAM = "% slot\nN1 G0 X-2.5 Z4\nG1 Z=-1.25 F80 ; down\n\nG1 X7.5\nM5\nG2 X1\nG0 Z4 Y3\n"


def values(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_program(spark, tmp_path):
    (tmp_path / "a.nc").write_text(PROGRAM)
    got = [tuple(r)[1:6] + (r["feed"],) for r in files.read_program(spark, str(tmp_path / "a.nc"), start=(0, 9, 0)).orderBy("seq").collect()]
    assert got == [(1, "G0", -2.5, 9, 4, 0), (2, "G1", -2.5, 9, -1.25, 80), (4, "G1", 7.5, 9, -1.25, 0), (7, "G0", 7.5, 3, 4, 0)]
    assert files.read_lines(spark, str(tmp_path / "a.nc")).count() == 8


LINES = {
    "": ("Blank", None, None, []),
    "   ": ("Blank", None, None, []),
    "; all": ("Comment", None, None, []),
    "G1 X1.5 Y-2 F=100 ; x": ("GCode", 1, 1, [("DoubleValue", "X", 1.5), ("IntegerValue", "Y", -2.0), ("IntegerValue", "F", 100.0)]),
    "N10 G0 X.5": ("GCode", 10, 0, [("DoubleValue", "X", 0.5)]),
    "M3 S (on)": ("MCode", 3, 3, [("NoValue", "S", None)]),
    "N10": ("UnknownString", None, None, []),
    "G38.2": ("UnknownString", None, None, []),
    "G0X1": ("UnknownString", None, None, []),
    "X10": ("UnknownString", None, None, []),
    "(note)": ("UnknownString", None, None, []),
    ":endif": ("EndIf", None, None, []),
    ":x a": ("UnknownControl", None, None, [("NoValue", "a", None)]),
    "G1 X+5": ("GCode", 1, 1, [("IntegerValue", "X+", 5.0)]),
    "G1 name=9999999999 M5 word": ("GCode", 1, 1, [("TextValue", "name", None), ("Code", "M", None), ("TextValue", None, None)]),
    "N5 T1": ("UnknownCode", 5, None, [("IntegerValue", "T", 1.0)]),
}


def test_lines(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "line_no int, text string").unionByName(spark.createDataFrame([(99, None)], "line_no int, text string"))
    got = {r["text"]: r for r in gcode.parsed(df).collect()}
    for text, (kind, n, code, params) in LINES.items():
        r = got[text]
        assert (r["type"], r["n"], r["code"]) == (kind, n, code), text
        assert [(p["type"], p["identifier"], p["dval"]) for p in r["params"]] == params, text
    assert got[None]["type"] == "Blank"
    assert got["M3 S (on)"]["comment"] == "(on)"
    assert gcode.lines_of_type(gcode.parsed(df), "GCode").count() == 4


def test_dialect(spark):
    lines = ["G1 X1 % slow", "% all", "L5 G1 Y2", "H7 A1", "#else", "N5 G1", "M3"]
    other = gcode.Dialect(codes=(("G", "GCode"), ("H", "Head")), comment="%", number="L", control="#")
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")
    got = {r["text"]: (r["type"], r["n"], r["code"], len(r["params"]), r["comment"]) for r in gcode.parsed(df, dialect=other).collect()}
    assert got == {
        "G1 X1 % slow": ("GCode", 1, 1, 1, "% slow"), "% all": ("Comment", None, None, 0, "% all"), "L5 G1 Y2": ("GCode", 5, 1, 1, None),
        "H7 A1": ("Head", 7, 7, 1, None), "#else": ("Else", None, None, 0, None), "N5 G1": ("UnknownString", None, None, 0, None),
        "M3": ("UnknownString", None, None, 0, None),
    }
    read = files.moves(df.withColumn("file", F.lit("a")), dialect=other).orderBy("seq").collect()
    assert [(r["seq"], r["x"], r["y"]) for r in read] == [(0, 1, None), (2, None, 2)]


def test_configuration(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        "<machine><name>five</name><axes>"
        + "".join(f"<axis><name>{n}</name><type>Linear</type><min>{i}</min><max>{100 + i}</max></axis>" for i, n in enumerate("XYZ"))
        + "<axis><name>A</name><type>Rotary</type><rotationAxis>X</rotationAxis><min>-120</min><max>120</max></axis></axes></machine>"
    )
    axes = config.read_machine(spark, str(tmp_path / "m.xml"))
    assert axes.count() == 4
    box = config.work_volume(axes).first()
    assert (box["min_y"], box["max_z"]) == (1, 102)
    with pytest.raises(Exception, match="missing"):
        config.work_volume(axes.where("name <> 'Z'")).collect()
    (tmp_path / "s.xml").write_text("<stock><WorkOrigin><X>1</X><Y>2</Y><Z>3</Z></WorkOrigin><WorkSize><X>10</X><Y>10</Y><Z>10</Z></WorkSize></stock>")
    (tmp_path / "t.xml").write_text("<tool><diameter>2</diameter><length>10</length><isBallEnd>false</isBallEnd></tool>")
    assert config.grid_of(config.read_stock(spark, str(tmp_path / "s.xml"))).hi == (11, 12, 13)
    centred = config.read_stock(spark, str(tmp_path / "s.xml")).withColumn("origin_type", F.lit("Center"))
    assert config.grid_of(centred).lo == (-4, -3, -2)
    sim = Simulation.from_files(spark, str(tmp_path / "s.xml"), str(tmp_path / "t.xml"))
    assert sim.tool == Tool(2, 10, False) and sim.material_count() == 1000
    with pytest.raises(Exception):
        config.read_tool(spark, str(tmp_path / "none.xml")).collect()
    with pytest.raises(ValueError):
        config.read_tool(spark)


def test_facade(spark, tmp_path):
    sim = Simulation(spark, Grid.from_corner((0, 0, 0), (10, 10, 10), 1.0), Tool(2, 10))
    first = files.commands(spark, [("G0", -3, 0, 0), ("G1", 3, 0, 0)])
    sim.execute(first)
    assert sim.material_count() == 960 and sim.position == (3, 0, 0)
    sim.change_tool(Tool(4, 10)).execute(files.commands(spark, [("G1", 3, 5, 5)]))
    assert sim.material_count() < 960 and sim.material_count(until=1) == 960
    n = sim.export_stl(str(tmp_path / "p.stl"))
    assert (tmp_path / "p.stl").stat().st_size == 84 + 50 * n > 84
    assert sim.reset().material_count() == 1000
    with pytest.raises(ValueError):
        sim.execute(None)
    with pytest.raises(ValueError):
        files.command("G2", 0, 0, 0)


def test_tool_profile(spark):
    r = lambda h, ball: values(spark, g.tool_radius(F.lit(float(h)), F.lit(10.0), F.lit(50.0), F.lit(ball)))[0]
    assert [r(h, False) for h in (0, 2.5, 10, -1, 51)] == [5, 5, 5, 0, 0]
    assert [r(h, True) for h in (0, 10, 51)] == [0, 5, 0] and math.isclose(r(2.5, True), math.sqrt(18.75))
    with pytest.raises(Exception, match="positive"):
        values(spark, g.valid_tool(F.lit(0.0), F.lit(1.0)))


def test_orientation(spark):
    d = lambda a, b: tuple(round(v, 9) + 0.0 for v in values(spark, *g.tool_direction(F.lit(float(a)), F.lit(float(b)))))
    assert (d(0, 0), d(90, 0), d(0, 90)) == ((0, 0, -1), (0, 1, 0), (-1, 0, 0))
    a, b = values(spark, *g.angles_of(g.tool_direction(F.lit(30.0), F.lit(-40.0))))
    assert (round(a, 9), round(b, 9)) == (30, -40)
    m = values(spark, g.pose(g.const(7, 8, 9), F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0]
    assert m[3] == [7, 8, 9, 1] and m[0] == [1, 0, 0, 0]
    assert values(spark, g.is_default_orientation(F.lit(0.0), F.lit(0.0), F.lit(0.0)))[0]


def test_boxes(spark):
    lo, hi = g.box_from_centre(g.const(1, 2, 3), g.const(2, 4, 6))
    assert tuple(values(spark, *lo, *hi)) == (0, 0, 0, 2, 4, 6)
    with pytest.raises(Exception, match="negative"):
        values(spark, *g.box_from_centre(g.const(0, 0, 0), g.const(-1, 1, 1))[0])


def test_generators(spark):
    circle = files.circle(spark, 25, 55)
    assert circle.count() == 38 and circle.where("kind = 'G0'").count() == 1
    dome = files.dome_spiral(spark, 35, 3, 10, 70, 30)
    assert dome.count() == 31 and dome.orderBy(F.desc("seq")).first()["z"] == 40
    assert T.polyline(T.segments(circle)).count() == 38


def test_modal_stream(spark, tmp_path):
    source, rows = tmp_path / "in", [(1, i, i % 2, float(i) if i % 3 else None, None, float(-i), None) for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], incremental.WORDS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(incremental.WORDS).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental.modal_stream(stream).writeStream.format("memory").queryName("modal").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {r["seq"]: (r["x0"], r["x1"]) for r in spark.table("modal").collect()}
    finally:
        q.stop()
    batch = T.segments(T.modal(spark.createDataFrame(rows, incremental.WORDS)))
    assert got == {r["seq"]: (r["x0"], r["x1"]) for r in batch.collect()}


def test_removed_table(spark, tmp_path):
    from kerf.scenarios import shapes

    grid = Grid.centred((12, 12, 12), 1.0)
    table = incremental.RemovedTable(spark, str(tmp_path / "removed"))
    parts = [shapes(spark, ("sphere", (x, 0, 0), (0, 0, 0), 2)) for x in (-2, 0, 2)]
    for k, p in enumerate(parts):
        dirty = table.add(lattice.removed(p, grid), k).first()
        assert dirty["max_x"] - dirty["min_x"] == 3
    table.add(lattice.removed(parts[2], grid), 2)  # a batch that runs again changes nothing
    whole = shapes(spark, *(("sphere", (x, 0, 0), (0, 0, 0), 2) for x in (-2, 0, 2)))
    assert table.read().count() == lattice.removed(whole, grid).count()


def test_removed_table_restarts(spark, tmp_path, monkeypatch):
    """An object made anew on the folder goes on; replays, of old batches too, change nothing; parts are put together."""
    from kerf.scenarios import shapes

    monkeypatch.setattr(incremental.RemovedTable, "FIRST_WHOLE", 2)
    grid = Grid.centred((30, 12, 12), 1.0)
    spheres = [("sphere", (x, 0, 0), (0, 0, 0), 2) for x in (-12, -9, -4, 1, 5, 9)]
    cut = lambda some: lattice.removed(shapes(spark, *some), grid)
    for k, sphere in enumerate(spheres):
        incremental.RemovedTable(spark, str(tmp_path / "t")).add(cut([sphere]), k)
        table = incremental.RemovedTable(spark, str(tmp_path / "t"))
        assert table.version == k and table.read().count() == cut(spheres[: k + 1]).count()
    for k in (5, 4):
        incremental.RemovedTable(spark, str(tmp_path / "t")).add(cut([spheres[k]]), k)
    # A part that was never finished isn't read.
    (tmp_path / "t" / "cuts" / "batch=9").mkdir()
    table = incremental.RemovedTable(spark, str(tmp_path / "t"))
    assert table.version == 5 and table.read().count() == cut(spheres).count()
    assert table._written("whole") == [1, 3] and table.read(2).count() == cut(spheres[:3]).count()
    assert incremental.RemovedTable(spark, str(tmp_path / "none")).read() is None


def test_bound_field(spark, tmp_path):
    """A stream of primitives, stopped and started again, keeps the bound field as one computed from all cells."""
    from kerf.operators import sdf
    from kerf.scenarios import PRIMITIVE, shapes

    grid, source = Grid.centred((16, 12, 12), 1.0), tmp_path / "in"
    spheres = [("sphere", (x, 0, 0), (0, 0, 0), 2) for x in (-5, 0, 4)]
    for k, part in enumerate((spheres[:1], spheres[1:2], spheres[2:])):
        shapes(spark, *part).coalesce(1).write.mode("append").parquet(str(source))
        table = incremental.RemovedTable(spark, str(tmp_path / "cells"))
        field = incremental.BoundField(table, grid, str(tmp_path / "field"), 3)
        seen = []

        def on_change(dirty, number, field=field, seen=seen):  # noqa: ANN001, ANN202
            seen.append(dirty.first()["job_id"])
            field.update(dirty, number)

        stream = spark.readStream.schema(PRIMITIVE).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = incremental.listen(stream, grid, table, on_change).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert seen == [0]
        cut = lattice.removed(shapes(spark, *spheres[: k + 1]), grid)
        assert table.read().count() == cut.count()
        want = sdf.from_cells(lattice.dense(spark, cut, grid), grid, 3).withColumnRenamed("d", "e")
        got = field.read()
        assert got.count() == grid.cells and got.join(want, ["x", "y", "z"]).where("abs(d - e) > 1e-9").count() == 0
    assert incremental.BoundField(incremental.RemovedTable(spark, str(tmp_path / "x")), grid, str(tmp_path / "y"), 3).read().count() == grid.cells


def test_updated_field(spark):
    from kerf.operators import sdf
    from kerf.scenarios import shapes

    grid = Grid.centred((24, 24, 24), 1.0)
    before = lattice.dense(spark, lattice.removed(shapes(spark, ("sphere", (-8, -8, -8), (0, 0, 0), 3)), grid), grid)
    cut = lattice.removed(shapes(spark, ("sphere", (-8, -8, -8), (0, 0, 0), 3), ("sphere", (6, 6, 6), (0, 0, 0), 2)), grid)
    after = lattice.dense(spark, cut, grid)
    got = incremental.updated_field(sdf.from_cells(before, grid, 3), after, grid, ((16, 16, 16), (19, 19, 19)), 3)
    want = sdf.from_cells(after, grid, 3)
    assert got.count() == 24**3 and got.join(want.withColumnRenamed("d", "e"), ["x", "y", "z"]).where("abs(d - e) > 1e-9").count() == 0
