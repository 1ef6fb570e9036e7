"""Shared folder, materialised tables and byte-range files for the operators.

Executors can be lost at any time, so anything that cuts a lineage is written below
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A read joins neighbouring records into one range of at most so many bytes.
RANGE_BYTES = 8 << 20
#: Records that are further apart than this are not read in one range.
GAP_BYTES = 64 << 10

#: Folder, below the shared one, that new tables and files go to; see ``scope``.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is taken, on a local master only.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{_SCOPE.get()}{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written to the shared folder inside the block lies in one folder, which goes at its end."""
    folder = shared_dir(spark, name)
    token = _SCOPE.set(_SCOPE.get() + folder.rpartition("/")[2] + "/")
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; the lineage ends there."""
    path = path or shared_dir(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(nullable(df.schema)).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, when later tables have replaced them."""
    for df in tables:
        remove(df.sparkSession, df._written)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 250) -> None:
    """Fewer rows in each Arrow batch of this session: texts are long, and JVM and worker hold a batch each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def tidied(result):
    """``result``, after the worker gave memory that it no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    return result


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; also bounds the session's Arrow batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column, n: int):
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def new_file(fs, path: str):
    """An output stream below a folder that is made if it is not there."""
    folder = path.rpartition("/")[0]
    fs.create_dir(folder, recursive=True)
    return fs.open_output_stream(path)


def sized_broadcast(spark: SparkSession, value: bytes, most: int):
    """Broadcast ``value`` after its size was checked against ``most`` bytes."""
    if len(value) > most:
        raise ValueError(f"{len(value)} bytes to broadcast; at most {most} are allowed")
    return spark.sparkContext.broadcast(value)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast where it has at most ``most`` rows; else it stays as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def clash_free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    name, k = stem, 0
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.empty(0, np.uint8)
        body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        out.append(struct.pack("<cQQ", a.dtype.char.encode(), len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<cQQ", data, at)
        at += struct.calcsize("<cQQ")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.empty(0, dtype))
        at += size
    return out


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[str, int, int, list[int]]]:
    """Coalesced byte ranges (file, from, to, members) of (file, offset, length) rows, sorted by place."""
    out: list = []
    for i in sorted(range(len(rows)), key=lambda i: rows[i][:2]):
        file, offset, length = rows[i]
        last = out[-1] if out else None
        if last and last[0] == file and offset - last[2] <= gap and offset + length - last[1] <= most:
            last[3].append(i)
            last[2] = max(last[2], offset + length)
        else:
            out.append([file, offset, offset + length, [i]])
    return [tuple(x) for x in out]


class Memory(dict):
    """Results of ``compute(key)``, remembered in two generations of at most ``most`` / 2 keys.

    Keys that are asked for again move into the young generation, so frequent ones stay.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
