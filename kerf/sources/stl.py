"""Binary STL as a data source: read in ranges of records, written in parts with one commit.

The format: 80 bytes of header, the number of triangles, then 50 bytes each: normal and
three vertices as 32-bit floats, and two zero bytes.

``df.write.format("stl").save(folder)`` writes a part for each task, records only, as they
stream in. Tasks report names and counts, and the commit writes the header and a manifest
of the parts in the order of their partitions; what a failed or repeated attempt left
isn't in it. The header and the parts, one after the other, are one STL file. As records
have one size, a part's place in it follows from the counts before, so
:func:`assembled` lets all tasks copy their parts into one file at once. No facet
passes the driver.

``spark.read.format("stl").load(path)`` reads such a folder, or a file, ``records`` triangles a task.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kerf.grid import AXES
from kerf.storage import shared_folder

HEADER = b"kerf surface"
FIELDS = [f"n{n}" for n in AXES] + [f"v{i}{n}" for i in (1, 2, 3) for n in AXES]
RECORD = np.dtype([("f", "<f4", (12,)), ("zero", "<u2")])
FRONT = 84
MANIFEST = "_manifest.json"
#: Triangles that a task reads, and bytes that are copied at once.
RECORDS, COPY = 1 << 20, 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def front(count: int) -> bytes:
    return HEADER.ljust(80, b"\0") + struct.pack("<I", count)


def records(batch: pa.RecordBatch) -> np.ndarray:
    """The records of facets; what isn't a number becomes 0, and what is too large the largest number."""
    most = float(np.finfo("f4").max)
    out = np.zeros(batch.num_rows, RECORD)
    for k, name in enumerate(FIELDS):
        out["f"][:, k] = np.clip(np.nan_to_num(batch.column(name).to_numpy(zero_copy_only=False).astype("f8")), -most, most)
    return out


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    count: int


class StlWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        fs, root = _open(path)
        if not overwrite and manifest(path) is not None:
            raise ValueError(f"{path} holds a surface already")
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        fs, root = _open(self.path)
        name, count = f"part-{part:05d}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                out.write(records(batch).tobytes())
                count += batch.num_rows
        return Written(part, name, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        old = manifest(self.path)
        parts = [{"name": m.name, "count": m.count} for m in sorted((m for m in messages if m), key=lambda m: m.part)]
        total = sum(p["count"] for p in parts)
        with fs.open_output_stream(f"{root}/header-{total}") as out:
            out.write(front(total))
        own = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(json.dumps({"header": f"header-{total}", "count": total, "parts": parts}).encode())
        fs.move(own, f"{root}/{MANIFEST}")
        for p in old["parts"] if old else []:
            fs.delete_file(f"{root}/{p['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


def manifest(folder: str) -> dict | None:
    """What the last commit wrote to a folder; null where there was none."""
    fs, root = _open(folder)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


@dataclass
class Range(InputPartition):
    file: str
    at: int
    count: int


class StlReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        fs, root = _open(self.path)
        done = manifest(self.path)
        if done is not None:
            files = [(f"{self.path}/{p['name']}", 0, p["count"]) for p in done["parts"]]
        else:
            with fs.open_input_file(root) as source:
                files = [(self.path, FRONT, struct.unpack("<I", source.read_at(4, 80))[0])]
        out = [Range(f, at + k * RECORD.itemsize, min(self.size, n - k)) for f, at, n in files for k in range(0, n, self.size)]
        return out or [Range(self.path, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, path = _open(partition.file)
        with fs.open_input_file(path) as source:
            source.seek(partition.at)
            left = partition.count
            while left:
                n = min(left, 1 << 16)
                raw = source.read(n * RECORD.itemsize)
                if len(raw) < n * RECORD.itemsize:
                    raise ValueError(f"{partition.file} ends before its last triangle")
                got = np.frombuffer(raw, RECORD)["f"]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(12)], names=FIELDS)
                left -= n


class StlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return ", ".join(f"{n} float" for n in FIELDS)

    def reader(self, schema: StructType) -> StlReader:
        return StlReader(self.options["path"], int(self.options.get("records", RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> StlWriter:
        missing = [n for n in FIELDS if n not in schema.names]
        if missing:
            raise ValueError(f"facets lack {', '.join(missing)}")
        return StlWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, size: int = RECORDS) -> DataFrame:
    """Facets (nx .. nz, v1x .. v3z) of a file or of a folder of parts."""
    spark.dataSource.register(StlSource)
    return spark.read.format("stl").option("records", size).load(path)


def write_parts(facets: DataFrame, folder: str, ordered: bool = True) -> int:
    """Writes a part for each task to ``folder``, in the order of ``tid`` over all parts; returns the number of triangles."""
    spark = facets.sparkSession
    spark.dataSource.register(StlSource)
    rows = facets.repartitionByRange("tid").sortWithinPartitions("tid") if ordered else facets
    rows.select(*FIELDS).write.format("stl").mode("overwrite").save(folder)
    return manifest(folder)["count"]


def places(folder: str) -> list[tuple[str, int, int]]:
    """(name, first byte in the whole file, bytes) of header and parts."""
    done = manifest(folder)
    out, at = [(done["header"], 0, FRONT)], FRONT
    for p in done["parts"]:
        size = p["count"] * RECORD.itemsize
        out.append((p["name"], at, size))
        at += size
    return out


def file_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``start, bytes``: the whole file in pieces, each with its place, read by the tasks that want them."""
    pieces = spark.createDataFrame([(f"{folder}/{name}", at, size) for name, at, size in places(folder)], "path string, start long, size long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _open(r["path"])
                with fs.open_input_stream(path) as source:
                    for k in range(0, r["size"], COPY):
                        yield pa.RecordBatch.from_arrays([pa.array([r["start"] + k], pa.int64()), pa.array([source.read(min(COPY, r["size"] - k))], pa.binary())], names=["start", "bytes"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "path").mapInArrow(run, "start long, bytes binary")


def assembled(spark: SparkSession, folder: str, path: str) -> None:
    """One file of a folder's parts: each task writes its pieces at their places.

    ``path`` must be in a file system that all tasks can open and write at any place.
    """
    with open(path, "wb") as f:
        f.truncate(sum(size for _, _, size in places(folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.seek(r["start"])
                    out.write(r["bytes"])
        yield from ()

    file_bytes(spark, folder).mapInArrow(run, "start long").write.format("noop").mode("overwrite").save()


def write(facets: DataFrame, path: str, ordered: bool = True) -> int:
    """Writes one file, in parallel; returns the number of triangles."""
    spark = facets.sparkSession
    folder = shared_folder(spark, "stl")
    count = write_parts(facets, folder, ordered)
    assembled(spark, folder, path)
    discard(folder)
    return count


def discard(folder: str) -> None:
    fs, root = _open(folder)
    fs.delete_dir(root)


def to_bytes(facets: DataFrame, most: int = 2_000_000) -> bytes:
    """The file's bytes at the driver, for small surfaces: an error beyond ``most`` triangles."""
    spark = facets.sparkSession
    folder = shared_folder(spark, "stl")
    count = write_parts(facets, folder)
    if count > most:
        discard(folder)
        raise ValueError(f"{count} triangles are too many for the driver; use write_parts and file_bytes")
    out = b"".join(bytes(r["bytes"]) for r in file_bytes(spark, folder).orderBy("start").collect())
    discard(folder)
    return out
