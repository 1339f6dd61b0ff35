"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and \t \n \v \f \r. bytes.split() splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexaloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Texts go to Python in batches of at most so many rows and bytes, so that two workers fit beside an executor's heap.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch to ours. They are read when a plan runs, so they have to stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if (int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else 1 << 62) > most or now.startswith(("-", "0")):
            spark.conf.set(name, most)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not glibc
        return None


def release_memory() -> None:
    """Give freed memory back to the system, which allocators else keep for a worker that serves many tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function; its worker gives memory back at the end of a task and after each some megabytes of output."""

    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0
        try:
            for b in run(batches):
                out += b.nbytes
                yield b
                if out > 16 << 20:
                    out = 0
                    del b
                    release_memory()
        finally:
            release_memory()

    return with_release


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at its end, but for those stored to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            dropped(spark, path)


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(spark: SparkSession, path: str) -> None:
    found, fs = _path(spark, path)
    fs.delete(found, True)


def scratch_folder(spark: SparkSession, label: str, *, keep: bool = False) -> str:
    """A new folder's path in the shared folder, which goes as a stored table does."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    found, fs = _path(spark, path)
    fs.deleteOnExit(found)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return path


def stored(df: DataFrame, label: str, *, keep: bool = False, files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there and any executor can read it.

    files bounds the files of a table that ends in a shuffle and is small for its partitions.
    The table goes with the surrounding scratch (unless kept), at the latest when the application ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label, keep=keep)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit word hashes, kept while they fit; at the bound the memory starts again."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of UTF-8 text."""
    return data.lower().split() if data else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


