"""Helpers shared by the text operators: shared storage, tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows in an Arrow batch sent to Python. Texts may be long, so batches are short.
BATCH_ROWS = 256
#: Bytes of a batch where work on a batch has a cost of its own.
BATCH_BYTES = 2 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the storage that driver and executors share.

    The root is ``spark.checkpoint.dir``. Where that is unset, a temporary folder of
    this machine is used in local mode, as in tests; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="kerf-")
        root = _own_dirs[app]
    return f"{root.rstrip('/')}/kerf/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to shared storage and reads it back.

    This cuts lineage and, unlike a local checkpoint, survives lost executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kerf_path = path
    return out


#: Steps over one file scan that leave each row where the file has it.
_STABLE = {"Project", "Filter", "Relation", "LogicalRelation", "SubqueryAlias", "View"}
#: Bits of a row's place in its file. Above are 30 of the file's number.
ROW_BITS = 33
#: Bits of a row's place within what :class:`Fetch` keeps as one file.
PART_BITS = 17


def _placed(df: DataFrame) -> tuple[Column, Column] | None:
    """The file of each row and its place there, where ``df`` is a plain scan of Parquet files."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names = [re.match(r"[\s:+|-]*!?(\w+)", line)[1] for line in plan.toString().splitlines() if re.match(r"[\s:+|-]*!?\w", line)]
    if not set(names) <= _STABLE or sum("Relation" in n for n in names) != 1 or not plan.deterministic():
        return None
    try:
        of_file = df.metadataColumn("_metadata")
        path, place = of_file["file_path"], of_file["row_index"]
        df.select(path, place).schema  # noqa: B018  resolves them
    except AnalysisException:
        return None
    return path, place


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a column ``name`` of numbers that stay with their rows whenever and however the plan runs.

    A number is made of a hash of the row's file and the row's place in it, so it doesn't
    follow from how files are dealt to tasks, which changes with the executors at hand.
    Files whose hashes agree get numbers of their own. Anything but a scan of Parquet
    files that reads each once is written to shared storage first.
    """
    found = _placed(df)
    if found:
        path, place = found
        file = F.shiftrightunsigned(F.xxhash64(path), 35)
        files = df.select(path.alias("path"), file.alias("file"), place.alias("place")).groupBy("path", "file").agg(F.count("*").alias("rows"), F.max("place").alias("last"))
        once = Window.partitionBy("file")
        # Of a million files about a thousand pairs share 29 bits; only those come here.
        odd = files.withColumn("same", F.count("*").over(once)).where("same > 1 OR rows > last + 1").select("path", "rows", "last").collect()
        if any(r["rows"] > r["last"] + 1 for r in odd):
            found = None
    if not found:
        return numbered(materialize(df, "stable"), name)
    for k, p in enumerate(sorted(r["path"] for r in odd)):
        file = F.when(path == p, F.lit((1 << 29) + k)).otherwise(file)
    return df.select("*", F.shiftleft(file.cast("long"), ROW_BITS).bitwiseOR(place).alias(name))


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kerf_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs now: it does where plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fetch:
    """Rows of a DataFrame by number, without a shuffle of that DataFrame.

    ``rows`` is a DataFrame with a column ``row`` from :func:`numbered`, whose upper bits tell
    the input file and a range of its rows. What is wanted of each such part is written to
    shared storage as one file, and whichever task reads the part picks it up. So only
    ``wanted`` moves, never texts that nobody asked for.
    """

    def __init__(self, rows: DataFrame, wanted: DataFrame, at: str, name: str) -> None:
        """``wanted`` has the number of a row in ``at``; its other columns come along."""
        spark = rows.sparkSession
        self.rows, self.at = rows, at
        self.folder = folder = shared_dir(spark, name)
        self.given = [f for f in wanted.schema if f.name != at]
        kind = StructType([wanted.schema[at], *self.given])
        dealt = wanted.select(at, *(f.name for f in self.given)).withColumn("_part", F.shiftright(F.col(at), PART_BITS))
        dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_part").sortWithinPartitions("_part", at)
        short_batches(spark)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            now = None

            def close() -> None:
                fs, root = pafs.FileSystem.from_uri(folder)
                name = _part_file(root, int(now))
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                own = f"{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out, pa.ipc.new_stream(out, held[0].schema) as stream:
                    for b in held:
                        stream.write_batch(b)
                fs.move(own, name)

            for batch in batches:
                part = batch.column("_part").to_numpy()
                ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                batch = batch.select(range(batch.num_columns - 1))
                for a, b in zip([0, *ends[:-1]], ends):
                    if b > a:
                        if held and part[a] != now:
                            close()
                            held = []
                        now = part[a]
                        held.append(batch.slice(a, b - a))
            if held:
                close()
            yield from ()

        dealt.mapInArrow(write, kind).write.format("noop").mode("overwrite").save()

    def rows_with(
        self, columns: list[str], others: bool = False, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]] | None = None, schema: str | None = None
    ) -> DataFrame:
        """``columns`` of the wanted rows and what came with ``wanted``, a row for each wanted one.

        With ``others``, all rows come, with nulls where nothing was wanted; a row may be wanted
        once. With ``make`` and ``schema``, rows go through a function as in ``map_rows``, in
        the same worker.
        """
        made = StructType.fromDDL(schema) if schema else None
        folder, given = self.folder, [f.name for f in self.given]
        some = self.rows.select("row", *columns)
        out = StructType([some.schema[c] for c in columns] + [StructField(f.name, f.dataType, True) for f in self.given])
        short_batches(some.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = to_arrow_schema(out)
            given_out = to_arrow_schema(made) if made else None
            step = make() if make else None
            part, wanted, place = None, None, None
            for batch in _by_part(batches):
                row = batch.column(0).to_numpy()
                if part != row[0] >> PART_BITS:
                    part = row[0] >> PART_BITS
                    fs, root = pafs.FileSystem.from_uri(folder)
                    path = _part_file(root, int(part))
                    wanted = None
                    if fs.get_file_info(path).type == pafs.FileType.File:
                        with fs.open_input_stream(path) as source:
                            wanted = pa.ipc.open_stream(source).read_all().combine_chunks()
                    place = np.zeros(0, np.int64) if wanted is None else wanted.column(0).to_numpy()
                if wanted is None and not others:
                    continue
                a, b = np.searchsorted(place, [row[0], row[-1] + 1])
                if others:
                    hit = np.full(len(row), -1)
                    hit[np.searchsorted(row, place[a:b])] = np.arange(a, b)
                    own = pa.array(np.maximum(hit, 0), mask=hit < 0)
                    mine = [pa.nulls(len(row), f.type) if wanted is None else wanted.column(f.name).combine_chunks().take(own) for f in list(arrow)[len(columns) :]]
                    cols = [batch.column(k + 1) for k in range(len(columns))] + mine
                elif a < b:
                    take = pa.array(np.searchsorted(row, place[a:b]))
                    cols = [batch.column(k + 1).take(take) for k in range(len(columns))] + [wanted.column(c).slice(a, b - a).combine_chunks() for c in given]
                else:
                    continue
                cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
                if step:
                    got = step({f.name: c.to_pylist() for f, c in zip(arrow, cols)})
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in given_out], schema=given_out)
                    continue
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow)], schema=arrow)

        return some.mapInArrow(lambda batches: released(run(batches)), made or out)


def _part_file(root: str, part: int) -> str:
    return f"{root}/{part % 1024}/{part}"


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, with a batch for each part of numbers in the first column."""
    for batch in batches:
        part = batch.column(0).to_numpy() >> PART_BITS
        turn = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()
        for a, b in zip([0, *turn], [*turn, len(part)]):
            if a < b:
                yield batch.slice(a, b - a)


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at a task's end, freed memory goes back to the system, as workers live on between tasks."""
    try:
        yield from batches
    finally:
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
    size: int = 0,
) -> DataFrame:
    """Applies a columnar Python function to every Arrow batch of ``df``.

    ``make`` runs once a task and returns the function, which turns a dict of
    column lists into a dict of output column lists. With ``size``, batches are put
    together to about as many bytes.
    """
    short_batches(df.sparkSession)
    out = StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        step = make()
        for batch in full_batches(batches, size) if size else batches:
            got = step({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            arrays = [pa.array(got[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(lambda batches: released(run(batches)), out)


def full_batches(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, short batches put together to about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0

    def joined() -> pa.RecordBatch:
        if len(held) == 1:
            return held[0]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)], schema=held[0].schema)

    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield joined()
            held, total = [], 0
            # What a large batch took is freed by now, and the next one needn't add to it.
            give_back()
    if held:
        yield joined()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], schema: str) -> DataFrame:
    """Like ``map_rows`` for functions from a batch to arrays, without Python lists between.

    Batches are put together to about ``BATCH_BYTES``.
    """
    short_batches(df.sparkSession)
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        step = make()
        for batch in full_batches(batches):
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(step(batch), arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(lambda batches: released(run(batches)), out)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[dict[str, list]], list[bool]]], size: int = 0) -> DataFrame:
    """Rows of ``df`` that a Python function of some columns keeps.

    All columns pass as they are, whatever their names and types.
    """
    short_batches(df.sparkSession)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in full_batches(batches, size) if size else batches:
            mask = keep({c: batch.column(k).to_pylist() for c, k in zip(columns, at)})
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(lambda batches: released(run(batches)), df.schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators read; other columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
