"""Cutting lineage in the cluster's shared folder, packing documents into chunks, and messages between chunks and buckets."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw text bytes of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Stands for a null document id inside numpy arrays.
NULL_ID = -(1 << 63)
MESSAGE = "dst long, src long, data binary"
CHUNK = "chunk long, ids binary, lens binary, text binary"


class Work:
    """Tables that cut lineage: Parquet files in a folder of its own under spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quillgrid-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self.n = spark, f"{base}/{name}-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame, *by: str, compression: str = "zstd") -> DataFrame:
        """Writes df and reads it back; a lost executor then costs no earlier work."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", compression)
        (writer.partitionBy(*by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path)
        out.saved_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of save() that no later step reads."""
        jvm = self.spark._jvm
        for t in (t for t in tables if hasattr(t, "saved_path")):
            p = jvm.org.apache.hadoop.fs.Path(t.saved_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clean(self) -> None:
        """Lets Spark delete the files of finished shuffles. It takes two rounds: the first one frees what Python holds of the plans, the second one the plans."""
        for _ in range(2):
            gc.collect()
            time.sleep(0.05)
            self.spark._jvm.System.gc()
            time.sleep(0.05)


#: Bits of a row's number that tell its place in its file.
FILE_ROWS = 40


def numbered(docs: DataFrame, work: Work, *more, copy: bool = False) -> DataFrame:
    """Every row in a struct column row, with a number of its own in n (and the columns in more): ids may be null or come again.

    A table that is read from files as it is has its rows numbered by file and place, in the order of the files' names; anything else is written once with numbers, and with copy a table of files too (as its files may be replaced)."""
    row = F.struct(*docs.columns).alias("row")
    if copy or docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        return work.save(docs.select(F.monotonically_increasing_id().alias("n"), row, *more))
    path = F.col("_metadata.file_path").alias("path")
    files = docs.select(path).distinct()
    # a row for each file
    files = work.save(files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file")))
    rows = docs.select(path, F.col("_metadata.row_index").alias("at"), row, *more)
    return rows.join(F.broadcast(files), "path").select((F.shiftleft("file", FILE_ROWS) + F.col("at")).alias("n"), "row", *[F.col(name) for name in rows.columns[3:]])


def lean() -> None:
    """Makes this worker give large arrays back to the system as soon as they are free, and what Arrow holds unused."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: no longer raised by what was freed before
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def leanly(run):
    """run over the batches of a task; its worker, which stays for later tasks of any query, gives back at the end what it holds."""

    def wrapped(batches):
        lean()
        try:
            yield from run(batches)
        finally:
            lean()

    return wrapped


def ship(spark: SparkSession, value):
    """Broadcasts a value whose class travels by value, as workers may not have this library; the result loads it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null mask of an Arrow string or binary array, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if off is None or n == 0:
        offsets = np.zeros(n + 1, np.int64)
    else:
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool) if column.null_count else np.zeros(n, bool)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], null


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def slices(offsets: np.ndarray, most: int):
    """Ranges of documents of about that many bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunk_row(chunk: int, ids: np.ndarray, offsets: np.ndarray, null: np.ndarray, raw: np.ndarray) -> tuple:
    lens = np.where(null, -1, np.diff(offsets)).astype(np.int64)
    return chunk, ids.astype("<i8").tobytes(), lens.astype("<i8").tobytes(), pack(raw.tobytes(), 3)


def read_chunk(ids, lens, text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, null mask and bytes of a chunk."""
    lens = np.frombuffer(lens, "<i8")
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(np.maximum(lens, 0), out=offsets[1:])
    return np.frombuffer(ids, "<i8"), offsets, lens < 0, np.frombuffer(unpack(text), np.uint8)


def table(schema: dict, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


CHUNK_ARROW = {"chunk": pa.int64(), "ids": pa.binary(), "lens": pa.binary(), "text": pa.binary()}
MESSAGE_ARROW = {"dst": pa.int64(), "src": pa.int64(), "data": pa.binary()}


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = CHUNK_BYTES) -> DataFrame:
    """Documents packed into rows of target bytes and as many more as the last document has: one pass without a shuffle. Save the result before using it twice: a chunk's number tells its task."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def row():
            nonlocal number, held, size
            ids = np.concatenate([h[0] for h in held])
            lens = np.concatenate([h[1] for h in held])
            null = np.concatenate([h[2] for h in held])
            offsets = np.zeros(len(lens) + 1, np.int64)
            np.cumsum(lens, out=offsets[1:])
            out = chunk_row(number, ids, offsets, null, np.concatenate([h[3] for h in held]))
            number, held, size = number + 1, [], 0
            return table(CHUNK_ARROW, [[x] for x in out])

        for batch in batches:
            ids = ids_of(batch.column(0))
            raw, offsets, null = texts_of(batch.column(1))
            a = 0
            while a < len(ids):
                # cut by bytes alone, wherever batches end
                b = min(len(ids), int(np.searchsorted(offsets, offsets[a] + target - size, "left")))
                held.append((ids[a:b], np.diff(offsets[a : b + 1]), null[a:b], raw[offsets[a] : offsets[b]].copy()))
                size += offsets[b] - offsets[a]
                a = b
                if size >= target:
                    yield row()
        if held:
            yield row()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, CHUNK)


def dealt_by_content(docs: DataFrame, doc_id: str, text: str, part: int) -> DataFrame:
    """doc_id and text dealt by a hash of both to as many partitions as hold about part bytes each, in the order of the hash: what lies where depends on the rows alone."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text")).repartition(max(1, -(-total // part)), "key")
    return keyed.sortWithinPartitions("key", "doc_id").select("doc_id", "text")


def n_buckets(spark: SparkSession, chunks: DataFrame, of: float = 2) -> int:
    """A power of two: buckets for what all chunks send, so that each gets what about that many chunks hold."""
    rows = chunks.select("chunk").count()
    return 1 << max(6, int(np.ceil(np.log2(max(1, rows / of, partitions(spark))))))


def grouped(messages: DataFrame, fn, schema: str = MESSAGE) -> DataFrame:
    """fn gets an Arrow table of all messages of one receiver."""

    def run(got: pa.Table) -> pa.Table:
        lean()
        return fn(got)

    return messages.groupBy("dst").applyInArrow(run, schema)
