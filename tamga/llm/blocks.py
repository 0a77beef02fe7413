"""Blocks of whole rows, and blob exchanges between blocks and key buckets.

Several operators need statistics of the whole corpus at every position of every text (how often is this
n-gram seen anywhere?). One row per position would shuffle many times the input, so a task condenses a block
of documents to sorted numpy arrays, one blob for each key bucket; buckets merge the blobs of all blocks and
answer each block with what it asked for. A block is bounded in bytes, a bucket by the number of buckets, which
grows with the input; neither holds more than its share however often one key occurs, because a block names
each key once.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 16 << 20
#: The least number of key buckets; there are as many as blocks when these are more.
BUCKETS = 64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that spark.checkpoint.dir names; set one only on a local master that names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tamga-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; later stages restart from there when executors are lost.

    Spark drops them with the last frame that reads them. For rounds of a loop use Kept: a checkpoint carries its
    plan's size estimate along, and joins multiply these from round to round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """Rows of a loop's rounds as Parquet in the shared folder, dropped together when the loop is over."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
        self.count = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_: object) -> None:
        drop(self.spark, self.folder)


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What operators remember in a worker between tasks, by operator, and how to forget it.
FORGET: dict[str, Callable[[], None]] = {}


def tidy(own: str = "") -> None:
    """Forget what other operators remember in this worker, and give free memory back to the machine."""
    for name, forget in FORGET.items():
        if name != own:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffles and checkpoints of frames that are out of reach."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most limit bytes of a string column, or one row."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    start = 0
    while start < len(values):
        end = int(np.searchsorted(offsets, int(offsets[start]) + limit, "right")) - 1
        end = min(max(end, start + 1), len(values))
        yield batch.slice(start, end - start)
        start = end


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as stream:
        return stream.read_all()


def to_blocks(docs: DataFrame, text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): the rows of docs, some MB in each payload. Blocks are numbered by partition and order."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit, text):
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([pack(part)], pa.binary())], ["block", "payload"])
                number += 1
        tidy()

    return cut(docs.mapInArrow(build, "block long, payload binary"))


BLOB = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def shares(bounds: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets that have anything, and where it lies: bucket b from bounds[b] to bounds[b + 1]."""
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, slice(int(bounds[b]), int(bounds[b + 1]))


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as set it apart from all columns; Spark ignores case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def renamed(columns: Iterable[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Columns under names of digits, which no operator uses for its own; these names; and the columns' names again."""
    columns = list(columns)
    names = [f"_{i}" for i in range(len(columns))]
    return [F.col(quoted(c)).alias(n) for c, n in zip(columns, names, strict=True)], names, [F.col(n).alias(c) for c, n in zip(columns, names, strict=True)]


def blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """A batch of BLOB."""
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["block", "bucket", "blob"])


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed blob; an ascending unsigned first array is kept as differences."""
    columns = [np.ascontiguousarray(a) for a in arrays]
    if len(columns[0]) and columns[0].dtype.kind == "u":
        columns[0] = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    parts = b"".join(_planes(c) for c in columns)
    head = np.array([len(columns), *(x for c in columns for x in (len(c), ord(c.dtype.char)))], np.int64)
    return len(head).to_bytes(4, "little") + head.tobytes() + pa.Codec("zstd", 1).compress(parts, asbytes=True)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    head = np.frombuffer(blob, np.int64, n, 4)
    kinds = [(int(head[1 + 2 * i]), np.dtype(chr(head[2 + 2 * i]))) for i in range(int(head[0]))]
    raw = pa.Codec("zstd").decompress(blob[4 + 8 * n :], sum(k * d.itemsize for k, d in kinds), asbytes=True)
    out, at = [], 0
    for k, d in kinds:
        planes = np.frombuffer(raw, np.uint8, k * d.itemsize, at).reshape(d.itemsize, k)
        out.append(np.ascontiguousarray(planes.T).view(d).reshape(k))
        at += k * d.itemsize
    if out and out[0].dtype.kind == "u":
        out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _planes(a: np.ndarray) -> bytes:
    """Byte planes: the many zero bytes of small numbers then lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
