"""Toolpaths and programs read once, in ranges and parts of files."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kerf.functions import gcode
from kerf.plans import toolpath as T
from kerf.sources import gcode as files

TOKENS = ["X", "Y", "X=", "X=abc", "X=5", "X=-.5", "X5", "X-5", "X+5", "X5.", "X9999999999", "XX5", "X1e5", "Y=1=2", "G1", "M5", "N4", "F100", "F=1.0", "x5", "X5X6", "X=.", "Z-0"]


def random_words(n: int, jobs: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    some = lambda: None if rng.random() < 0.6 else float(rng.randint(-9, 9))
    return [(rng.randrange(jobs), 3 * k, rng.randint(0, 1), some(), some(), some(), some()) for k in range(n)]


def threaded(words: list[tuple]) -> dict[tuple, tuple]:
    """(kind, feed, where it begins, where it ends) by job and seq."""
    out, at = {}, {}
    for job, seq, code, x, y, z, f in sorted(words, key=lambda r: (r[0], r[1])):
        old = at.get(job, (1.0, 2.0, 3.0))
        at[job] = tuple(o if v is None else v for o, v in zip(old, (x, y, z)))
        out[job, seq] = ("G1" if code else "G0", (f or 0.0) if code else 0.0, old, at[job])
    return out


def shown(df) -> dict[tuple, tuple]:  # noqa: ANN001
    return {(r["job_id"], r["seq"]): (r["kind"], r["feed"], (r["x0"], r["y0"], r["z0"]), (r["x1"], r["y1"], r["z1"])) for r in df.collect()}


@pytest.mark.parametrize("bits", [2, 6, 20])
def test_ranges(spark, monkeypatch, bits):
    """Jobs of many ranges give what a walk over them gives, in one step or in two."""
    monkeypatch.setattr(T, "RANGE_BITS", bits)
    words = random_words(300, 3, bits)
    df = spark.createDataFrame(words, "job_id long, seq long, code int, x double, y double, z double, f double").repartition(4)
    want = threaded(words)
    assert shown(T.modal_segments(df, (1, 2, 3))) == want
    assert shown(T.segments(T.modal(df, (1, 2, 3)), (1, 2, 3))) == want
    rank = {}
    for job, seq in sorted(want):
        rank[job, seq] = sum(1 for j, s in want if j == job and s < seq)
    got = T.steps(T.modal(df), 40, 25).collect()
    assert sorted((r["job_id"], r["seq"]) for r in got) == sorted(k for k, v in rank.items() if 40 <= v < 65)


def test_turns_over_ranges(spark, monkeypatch):
    """Orientation is carried over ranges without a 5-axis command, and positions over all."""
    monkeypatch.setattr(T, "RANGE_BITS", 1)
    rng = random.Random(8)
    rows, turn, at, want = [], (0.0, 0.0, 7.0), (0.0, 0.0, 0.0), []
    for seq in range(60):
        five = rng.random() < 0.15
        to = tuple(float(rng.randint(0, 9)) if rng.random() < 0.9 else None for _ in range(3))
        own = tuple(float(rng.randint(0, 90)) if rng.random() < 0.7 else None for _ in range(3)) if five else (None,) * 3
        after = tuple(v or 0.0 for v in own) if five else turn
        rows.append((1, seq, "G1_5" if five else "G1", *to, *own, 0.0))
        want.append((tuple(0.0 if v is None else v for v in at), to, turn, after))
        turn, at = after, to
    got = T.segments(spark.createDataFrame(rows, T.COMMANDS).repartition(3), orientation=(0, 0, 7)).orderBy("seq").collect()
    assert [tuple(tuple(r[f"{n}{e}"] for n in axes) for axes, e in (("xyz", 0), ("xyz", 1), ("abc", 0), ("abc", 1))) for r in got] == want


def executed(df) -> str:  # noqa: ANN001
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.toString().split("== Initial Plan ==")[0]


def test_one_read(spark, tmp_path):
    """A program is read and parsed once, whatever columns are asked for; rows move once before they are cut into tiles."""
    path = str(tmp_path / "lines.parquet")
    spark.range(1000).select(F.lit(1).alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("G1 X"), F.col("id") % 9, F.lit(" Y2")).alias("text")).write.parquet(path)
    lines = spark.read.parquet(path)
    moves = files.moves(lines, "job_id", "seq")
    for df, rows_moved in ((T.modal(moves).select("seq", "x"), 1), (T.modal_segments(moves).where("kind = 'G1'"), 1), (T.segments(T.modal(moves)).select("seq", "x0"), 2)):
        plan = executed(df)
        assert plan.count("FileScan") == 1
        assert len(re.findall(r"- Exchange hashpartitioning\([^)]*\), REPARTITION_BY_COL", plan)) == rows_moved


def test_words_of_lines(spark):
    """The words of code lines as the parser of whole lines has them."""
    rng = random.Random(5)
    heads = [["G1"], ["N5", "G1"], ["G1", "N7"], ["G0"], ["M1"], ["N1"], ["X4"], ["; G1"]]
    lines = [" ".join(rng.choice(heads) + rng.choices(TOKENS, k=rng.randint(0, 6))) for _ in range(1500)] + ["", None, "G1", "G1 X1 ; X2", "G1 (X3) X4"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, text string")
    got = {r["i"]: (r["code"], *(r[n] for n in "xyzf")) for r in gcode.code_words(df, "XYZF").collect()}
    whole = gcode.bound(gcode.parsed(df), **{f"q{n}": gcode.find_number(F.col("params"), n) for n in "XYZF"}).where("type = 'GCode'")
    assert got == {r["i"]: (r["code"], *(r[f"q{n}"] for n in "XYZF")) for r in whole.collect()}
    every = gcode.code_words(df, "XYZF", others=True).collect()
    assert len(every) == len(lines) and {r["i"]: (r["code"], *(r[n] for n in "xyzf")) for r in every if r["type"] == "GCode"} == got
    assert all(r["code"] is r["x"] is r["f"] is None for r in every if r["type"] != "GCode")


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "mixed"])
def test_parts_of_a_file(spark, tmp_path, small_parts, end):
    """One file, read by many tasks: the same numbers as when it is split at once."""
    rng = random.Random(end)
    lines = [rng.choice(["", "; note", "M3", "(x)", f"G1 X{k}", f"G0 Y{k} Z-1", f"G1 Z{k % 7} F{k}", "G2 X1 Y1", "é" * 9]) for k in range(3000)]
    ends = [end if end != "mixed" else rng.choice(["\n", "\r\n"]) for _ in lines]
    (tmp_path / "one.nc").write_bytes("".join(a + b for a, b in zip(lines, ends)).encode())
    (tmp_path / "two.nc").write_bytes(b"G1 X1\nG1 Y2")
    (tmp_path / "none.nc").write_bytes(b"")
    (tmp_path / "blank.nc").write_bytes(b"\n")
    df = files._split(spark, str(tmp_path))
    assert df.where(F.col("file").endswith("one.nc")).select("block").distinct().count() > 10
    got = {(r["file"].rpartition("/")[2], r["line_no"]): r["text"] for r in files.read_lines(spark, str(tmp_path)).collect()}
    assert got == {("one.nc", k): t for k, t in enumerate(lines)} | {("two.nc", 0): "G1 X1", ("two.nc", 1): "G1 Y2", ("blank.nc", 0): ""}
    words = []
    for k, t in enumerate(lines):
        m = re.match(r"G([01])((?: [XYZF]-?\d+)*)$", t)
        if m:
            by = {w[0]: float(w[1:]) for w in m[2].split()}
            words.append(("one", k, int(m[1]), *(by.get(n) for n in "XYZF")))
    want = threaded(words)
    got = files.read_program(spark, str(tmp_path / "one.nc"), start=(1, 2, 3)).collect()
    assert {("one", r["seq"]): (r["kind"], r["feed"], (r["x"], r["y"], r["z"])) for r in got} == {k: (a, b, d) for k, (a, b, _, d) in want.items()}
    assert executed(files.read_program(spark, str(tmp_path / "one.nc")).select("seq", "x")).count("FileScan") == 1
