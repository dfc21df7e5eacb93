"""Machine, stock and tool descriptions in XML, read with Spark's own reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.grid import Grid

MACHINE = "name STRING, axes STRUCT<axis: ARRAY<STRUCT<name: STRING, type: STRING, rotationAxis: STRING, min: DOUBLE, max: DOUBLE>>>"
_XYZ = "STRUCT<X: DOUBLE, Y: DOUBLE, Z: DOUBLE>"
STOCK = f"WorkOrigin {_XYZ}, WorkSize {_XYZ}, OriginType STRING"
TOOL = "diameter DOUBLE, length DOUBLE, isBallEnd BOOLEAN"


def _read(spark: SparkSession, path: str | None, default: str | None, tag: str, schema: str) -> DataFrame:
    path = path or default
    if not path:
        raise ValueError(f"a path of a {tag} description is needed")
    # A missing path is an error of the reader, for any file system Spark can reach.
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_machine(spark: SparkSession, path: str | None = None, default: str | None = None) -> DataFrame:
    """One row an axis: machine, name, type, rotation_axis, min, max."""
    axes = _read(spark, path, default, "machine", MACHINE).select(F.col("name").alias("machine"), F.inline("axes.axis"))
    return axes.select("machine", "name", F.coalesce("type", F.lit("Linear")).alias("type"), F.col("rotationAxis").alias("rotation_axis"), "min", "max")


def work_volume(axes: DataFrame) -> DataFrame:
    """The box of the axes X, Y and Z of each machine; an error where one is missing."""

    def end(axis: str, which: str) -> Column:
        found = F.max(F.when(F.col("name") == axis, F.col(which)))
        message = F.concat(F.lit(f"axis {axis} is missing: "), F.coalesce(F.first("machine"), F.lit("")))
        return F.coalesce(found, F.raise_error(message).cast("double"))

    return axes.groupBy("machine").agg(*(end(a, w).alias(f"{w}_{a.lower()}") for w in ("min", "max") for a in "XYZ"))


def read_stock(spark: SparkSession, path: str | None = None, default: str | None = None) -> DataFrame:
    """origin_x.., size_x.., origin_type (MinCorner where not said)."""
    raw = _read(spark, path, default, "stock", STOCK)
    zero = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return raw.select(
        *(zero(f"WorkOrigin.{a}", 0.0).alias(f"origin_{a.lower()}") for a in "XYZ"),
        *(zero(f"WorkSize.{a}", 100.0).alias(f"size_{a.lower()}") for a in "XYZ"),
        F.coalesce("OriginType", F.lit("MinCorner")).alias("origin_type"),
    )


def stock_box(stock: DataFrame) -> DataFrame:
    """min_x .. max_z of each row of stock: around its origin, or from it as a corner."""
    centre = F.col("origin_type") == "Center"
    cols = []
    for a in "xyz":
        o, s = F.col(f"origin_{a}"), F.col(f"size_{a}")
        cols += [F.when(centre, o - s / 2).otherwise(o).alias(f"min_{a}"), F.when(centre, o + s / 2).otherwise(o + s).alias(f"max_{a}")]
    return stock.select(*cols)


def grid_of(stock: DataFrame, res: float = 1.0) -> Grid:
    """The lattice of a stock of one row."""
    row = stock_box(stock).first()
    return Grid(tuple(row[f"min_{a}"] for a in "xyz"), tuple(row[f"max_{a}"] for a in "xyz"), res)


def read_tool(spark: SparkSession, path: str | None = None, default: str | None = None) -> DataFrame:
    """diameter, length, type (Ball or Flat)."""
    raw = _read(spark, path, default, "tool", TOOL)
    return raw.select("diameter", "length", F.when(F.coalesce("isBallEnd", F.lit(False)), "Ball").otherwise("Flat").alias("type"))
