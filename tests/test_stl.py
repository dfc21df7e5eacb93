"""Surfaces written in parts and read in ranges."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerf.sources import stl


def facets(spark, n: int):  # noqa: ANN001, ANN201
    return spark.range(n - 1, -1, -1).repartition(5).select(
        F.col("id").alias("tid"), *(((F.col("id") * (k + 3)) % 1000 / 8.0 - 7).alias(c) for k, c in enumerate(stl.FIELDS)), F.lit("x").alias("name")
    )


def plain(n: int) -> bytes:
    rows = np.zeros(n, stl.RECORD)
    for k in range(12):
        rows["f"][:, k] = (np.arange(n) * (k + 3)) % 1000 / 8 - 7
    return b"kerf surface".ljust(80, b"\0") + struct.pack("<I", n) + rows.tobytes()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_parts_are_one_file(spark, tmp_path, n):
    folder = str(tmp_path / "parts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert stl.write_parts(facets(spark, n), folder) == n
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pieces = sorted((r["start"], bytes(r["bytes"])) for r in stl.file_bytes(spark, folder).collect())
    assert b"".join(b for _, b in pieces) == plain(n)
    assert all(a + len(b) == c for (a, b), (c, _) in zip(pieces, pieces[1:]))
    stl.assembled(spark, folder, str(tmp_path / "a.stl"))
    assert (tmp_path / "a.stl").read_bytes() == plain(n)
    # What the tasks wrote is what a reader of ranges gets, from parts and from the file.
    for path in (folder, str(tmp_path / "a.stl")):
        got = stl.read(spark, path, 700)
        assert got.rdd.getNumPartitions() >= n // 700
        rows = np.array([tuple(r) for r in got.collect()]).reshape(-1, 12)
        assert (rows == np.frombuffer(plain(n)[84:], stl.RECORD)["f"]).all()
    if n > 1000:
        assert len(stl.manifest(folder)["parts"]) > 1


def test_committed_parts_only(spark, tmp_path):
    """What isn't in the manifest isn't read, a second surface replaces the first, and appending is refused."""
    folder = tmp_path / "parts"
    stl.write_parts(facets(spark, 100), str(folder))
    (folder / "part-00000-left-by-a-lost-executor").write_bytes(b"x" * 77)
    assert stl.read(spark, str(folder)).count() == 100
    stl.write_parts(facets(spark, 30), str(folder))
    assert stl.read(spark, str(folder)).count() == 30
    assert sum(p.stat().st_size for p in folder.glob("part-*")) == 30 * 50 + 77
    with pytest.raises(Exception, match="holds a surface"):
        facets(spark, 3).write.format("stl").mode("append").save(str(folder))


def test_a_failed_task_commits_nothing(spark, tmp_path):
    folder = tmp_path / "parts"
    spark.dataSource.register(stl.StlSource)
    broken = facets(spark, 100).withColumn("nx", F.when(F.col("tid") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("nx")))
    with pytest.raises(Exception):
        stl.write_parts(broken, str(folder), ordered=False)
    assert stl.manifest(str(folder)) is None
    with pytest.raises(Exception, match="facets lack nz"):
        facets(spark, 3).drop("nz").write.format("stl").mode("overwrite").save(str(folder))


def test_odd_values_and_short_files(spark, tmp_path):
    odd = facets(spark, 2).withColumns({"nx": F.lit(float("nan")), "ny": F.lit(None).cast("double"), "v1x": F.lit(float("inf"))})
    got = np.frombuffer(stl.to_bytes(odd)[84:], stl.RECORD)["f"]
    assert (got[:, :2] == 0).all() and np.isfinite(got).all()
    (tmp_path / "cut.stl").write_bytes(plain(10)[:-20])
    with pytest.raises(Exception, match="ends before"):
        stl.read(spark, str(tmp_path / "cut.stl")).collect()
    with pytest.raises(ValueError, match="too many"):
        stl.to_bytes(facets(spark, 9), most=8)
