"""Connected components of a table of edges, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import materialize


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b), a > b, with those of each Arrow batch replaced by stars around its least vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
            a, b = at.reshape(2, -1)
            label = np.arange(len(vertex))
            while True:
                # Hook the larger of two labels to the smaller one, then follow labels to their ends.
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                if not (low < high).any():
                    break
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
            child = np.flatnonzero(label < np.arange(len(vertex)))
            yield pa.RecordBatch.from_arrays([pa.array(vertex[child]), pa.array(vertex[label[child]])], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """A large star, then a small star. Edges are (a, b) with a > b.

    Least neighbours are found by aggregation, which combines on the map side, and
    joined back; so a vertex with very many edges is split where Spark splits joins.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written, so that the join's sides are plain: only then does Spark split a vertex that very many edges share.
    least = materialize(both.groupBy(F.col("u").alias("k")).agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    small = large.join(least, F.col("a") == F.col("k")).select(
        F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
    )
    return small.select("e.a", "e.b").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each vertex is either a root or the child of one."""
    roles = edges.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(edges.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return roles.groupBy("v").agg(F.sum("child").alias("parents"), F.max("root").alias("root")).where("parents > 1 OR parents = 1 AND root = 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``vertex, root`` of every vertex of ``edges`` (a, b), long; the root is the least vertex.

    Edges with a null end don't count. Each round is written to shared storage. Rounds grow
    with the logarithm of the number of vertices. Loops and repeated edges don't matter.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    now = materialize(_contracted(now).distinct(), name)
    while not _settled(now):
        now = materialize(_stars(now), name)
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionAll(roots)
