"""Token sequences of equal length in Arrow stream files, read without copying.

Documents are dealt into ranges of ``doc_id``, sorted, encoded, each closed with an
end id, and packed back to back into rows of ``length`` ids. A range is written as files
of about ``file_ids`` ids, so files are bounded whatever the ranges are: each an Arrow IPC
stream whose batches hold a fixed-size-list column of ids (16 bits where the vocabulary
fits) and one of masks, whose bits, lowest first, tell ids from padding. Only the last row
of a file is padded.

All batches of a file but the last take the same number of bytes, so the place of row k
is computed: a reader opens one batch at a time, and a memory map gives any sequence and
its mask as array views.

An index gives for each document its file and place; the number of ids before it in
the whole corpus is summed over the files' totals, one row a file. A file is
written under a name of its own attempt and then renamed, so a task that is lost or
runs twice leaves whole files; what lost attempts left is deleted at the end.

Null text counts as empty: it has the end id alone. Null ids come first. Rows with
equal ids keep all their tokens, in the order of their texts. An empty table makes
no file and an empty index.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerf.llm.bpe import default_vocabulary
from kerf.llm.common import full_batches, id_and_text, materialize, released, shared_dir, short_batches
from kerf.llm.pieces import ASCII_WHITE, PieceCoder

END_ID = 2
LENGTH = 1024
#: Rows of ids in an Arrow batch, and batches' ids kept in memory at a time.
BATCH = 256
#: Ids after which a range goes on in another file.
FILE_IDS = 1 << 27
#: Bytes of input, as Spark estimates them, for which a range is made at least.
RANGE_BYTES = 256 << 20
INDEX = "doc_id long, part int, number int, offset long, n_tokens long, file string"


#: Bytes that the library encodes at a time where pieces are joined.
JOINED = 1 << 16


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """The tokenizers library, asked once for each different piece of text.

    Pieces that begin with white space and end without are joined, encoded together and
    cut by the number of bytes that each id stands for.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    many = getattr(t, "encode_batch_fast", t.encode_batch)
    special = {i for i in t.get_added_tokens_decoder()}
    vocab = t.get_vocab()
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        # One character stands for one byte, but in added tokens.
        width[i] = len(token.encode()) if i in special else len(token)

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        found = many([x.decode("utf-8", "surrogatepass") for x in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        want = np.cumsum([len(x) for x in texts])
        stops = np.unique(np.searchsorted(want, np.arange(JOINED, want[-1] + JOINED, JOINED)) + 1)
        stops = np.minimum(stops, len(texts)).tolist()
        starts = [0, *stops[:-1]]
        codes, sizes = [], []
        for a, b, ids in zip(starts, stops, encode([b"".join(texts[a:b]) for a, b in zip(starts, stops)])):
            if a == b:
                continue
            ends, ask = np.cumsum(width[ids]), want[a:b] - (want[a - 1] if a else 0)
            cut = np.searchsorted(ends, ask)
            if len(ids) and np.array_equal(ends[np.minimum(cut, len(ends) - 1)], ask):
                codes.append(ids)
                sizes.append(np.diff(np.concatenate([[0], cut + 1])))
            else:
                got = flat(encode(texts[a:b]))
                codes.append(got[0])
                sizes.append(got[1])
        return np.concatenate(codes), np.concatenate(sizes)

    def each(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        fits = np.array([x[0] in ASCII_WHITE and x[-1] not in ASCII_WHITE for x in texts], bool)
        if fits.all():
            return joined(texts)
        alone = encode([texts[k] for k in np.flatnonzero(~fits).tolist()])
        codes, sizes = joined([texts[k] for k in np.flatnonzero(fits).tolist()]) if fits.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        size = np.zeros(len(texts), np.int64)
        size[fits], size[~fits] = sizes, [len(x) for x in alone]
        out = np.zeros(int(size.sum()), np.uint32)
        of_fit = np.repeat(fits, size)
        out[of_fit], out[~of_fit] = codes, np.concatenate(alone)
        return out, size

    return PieceCoder(each)


def _schema(length: int, wide: bool) -> pa.Schema:
    if length % 8:
        raise ValueError("a sequence has a multiple of 8 ids, so that its mask begins with a byte")
    row = lambda kind, n: pa.list_(pa.field("item", kind, nullable=False), n)
    return pa.schema([pa.field("ids", row(pa.uint32() if wide else pa.uint16(), length), nullable=False), pa.field("mask", row(pa.uint8(), length // 8), nullable=False)])


class _Writer:
    """Packs ids into rows of equal length and writes them batch by batch."""

    def __init__(self, fs: pafs.FileSystem, path: str, length: int, wide: bool) -> None:
        self.schema, self.length, self.kind = _schema(length, wide), length, np.uint32 if wide else np.uint16
        self.out = fs.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.kept: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids.astype(self.kind))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH:
            # All batches but the last have the same number of rows.
            self._flush(self.n // (self.length * BATCH) * self.length * BATCH)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.kept) if self.kept else np.zeros(0, self.kind)
        now, rest = flat[:n], flat[n:]
        self.kept, self.n = [rest], len(rest)
        pad = -len(now) % self.length
        mask = np.packbits(np.concatenate([np.ones(len(now), np.uint8), np.zeros(pad, np.uint8)]), bitorder="little")
        now = np.concatenate([now, np.zeros(pad, self.kind)])
        for at in range(0, len(now), self.length * BATCH):
            to = at + self.length * BATCH
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((now[at:to], mask[at // 8 : to // 8]), self.schema)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        self._flush(self.n)
        self.stream.close()
        self.out.close()


class _Files:
    """The files of one range, one after the other."""

    def __init__(self, folder: str, part: int, length: int, wide: bool, file_ids: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.length, self.wide, self.file_ids = part, length, wide, file_ids
        self.number, self.writer = -1, None

    def add(self, ids: np.ndarray) -> tuple[int, int, str]:
        """Number of the file, ids before these in it, its name."""
        if self.writer is None or self.writer.total >= self.file_ids:
            self.close()
            self.number += 1
            self.name, self.own = f"tokens-{self.part:06d}-{self.number:04d}.arrows", f"{self.root}/_own-{self.part:06d}-{uuid.uuid4().hex}"
            self.writer = _Writer(self.fs, self.own, self.length, self.wide)
        at = self.writer.total
        self.writer.add(ids)
        return self.number, at, self.name

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            self.fs.move(self.own, f"{self.root}/{self.name}")
            self.writer = None


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, length: int = LENGTH, partitions: int | None = None, file_ids: int = FILE_IDS
) -> DataFrame:
    """Writes the files and returns their index, one row a document, from shared storage.

    ``offset`` counts ids within the file. There are ``partitions`` ranges, by default as
    many as shuffles have and one for each ``RANGE_BYTES`` of input at least.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    short_batches(spark)
    _schema(length, False)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 1_000_000))
    # The hash of the text splits ranges where many rows share an id.
    tie = F.xxhash64("text")
    dealt = id_and_text(docs).withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    out = StructType.fromDDL(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        encode = coder(path)
        part = TaskContext.get().partitionId()
        files = _Files(folder, part, length, _size(path) > 1 << 16, file_ids)
        end = np.array([end_id], np.uint32)
        for batch in full_batches(batches):
            ids, bounds = encode(batch.column("text"))
            # Each document's ids are followed by the end id.
            ids = np.insert(ids, bounds[1:], end)
            bounds = (bounds + np.arange(len(bounds))).tolist()
            placed = [files.add(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            if placed:
                number, at, name = zip(*placed)
                cols = [batch.column("doc_id"), [part] * len(placed), number, at, np.diff(bounds), name]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)
        files.close()

    index = materialize(dealt.drop("tie").mapInArrow(lambda batches: released(run(batches)), out), "token-index")
    _delete_orphans(folder)
    return index


def _delete_orphans(folder: str) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("_own-"):
                fs.delete_file(info.path)


@lru_cache(maxsize=2)
def _size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class TokenFile:
    """Random access to one file; ids and masks are views where memory maps work.

    One batch is open at a time, so a file on remote storage is never held whole.
    """

    def __init__(self, folder: str, name: str) -> None:
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{root}/{name}") if local else fs.open_input_file(f"{root}/{name}")
        self.schema = pa.ipc.read_schema(self.source)
        self.length = self.schema.field("ids").type.list_size
        self.begin = self.source.tell()
        self.at, self.batch = 0, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        self.stride, self.per = self.source.tell() - self.begin, self.batch.num_rows
        # An end mark of 8 bytes follows the last batch.
        self.batches = -(-(self.source.size() - 8 - self.begin) // self.stride)

    def _open(self, b: int) -> pa.RecordBatch:
        if b != self.at:
            self.source.seek(self.begin + b * self.stride)
            self.at, self.batch = b, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.batch

    def __len__(self) -> int:
        return (self.batches - 1) * self.per + self._open(self.batches - 1).num_rows

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row k, both without a copy; ``numpy.unpackbits(mask, bitorder="little")`` has a byte for each id."""
        batch, at = self._open(k // self.per), k % self.per
        ids = batch.column("ids").values.slice(at * self.length, self.length)
        mask = batch.column("mask").values.slice(at * self.length // 8, self.length // 8)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=True)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, gathered over batches; a view where they lie in one."""
        out, per = [], self.length * self.per
        while n > 0:
            flat = self._open(start // per).column("ids").values.to_numpy(zero_copy_only=True)
            at = start % per
            got = flat[at : at + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, each from the ids in the files.

    A row of the index stands in the task that reads its file: files are read once
    where the index comes sorted, as it is written.
    """
    totals = index.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
    # One row a file of about ``file_ids`` ids: 100 TB of text make some hundred thousand.
    before, at = {}, 0
    for part, number, total in totals.orderBy("part", "number").collect():
        before[part, number] = at
        at += total
    shared = index.sparkSession.sparkContext.broadcast(before)
    out = StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        first = shared.value
        name, file = None, None
        for batch in batches:
            start, n, crc = [], [], []
            for key, number, at, size, of in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "offset", "n_tokens", "file"))):
                if of != name:
                    name, file = of, TokenFile(folder, of)
                ids = file.ids(at, size).astype("<u4")
                start.append(first[key, number] + at)
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (start, n, crc))], schema=arrow)

    return index.mapInArrow(run, out)


def token_file_digests(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, length=length), folder)
