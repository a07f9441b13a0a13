"""Shared plumbing of the training-data operators: folders, staged tables, files.

Everything that must outlive a task is written below one folder that the driver
and all executors can reach (``spark.checkpoint.dir``); where that setting is
absent (tests on one machine) a temporary folder is made and registered.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of columns that an operator adds to rows it passes through.
OWN = "__cw_"
#: Rows handled at once inside an Arrow batch, so that Python objects stay few.
SLICE = 256
#: Bytes of text in such a slice at most, but for a longer text.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 8 << 20
#: Bytes of files that one task reads back, about.
READ_TASK = 256 << 20
#: Fewer than so many keys can each have more than one in HOT rows.
HOT = 1000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="cellweave-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/cellweave-{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what jobs hand to Python comes in batches of BATCH_BYTES: a worker and its task each hold two or so."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and reread: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


def delete_file(uri: str) -> None:
    fs, path = filesystem(uri)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_file(path)


def list_files(uri: str) -> list[str]:
    fs, path = filesystem(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return [f"{uri}/{x.base_name}" for x in found if x.type == pafs.FileType.File]


def release() -> None:
    """Memory that this process has freed goes back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts of at most ``rows`` rows, and ``most`` bytes of text where a cut has two rows or more.

    What the worker has freed goes back to the system every BATCH_BYTES, and at the end.
    """
    freed = 0
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for x in batch.columns:
            if pa.types.is_string(x.type) or pa.types.is_binary(x.type) or pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type):
                sizes += pc.binary_length(x).fill_null(0).to_numpy()
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = min(batch.num_rows, at + rows, max(at + 1, full))
            yield batch.slice(at, to - at)
            if ends[to - 1] - freed >= BATCH_BYTES:
                freed = ends[to - 1]
                release()
            at = to
        freed -= ends[-1] if batch.num_rows else 0
    release()


def texts(column: pa.Array) -> list[str]:
    """Null: empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """A short driver-made table, dealt to so many tasks (4096 at most)."""
    return df.repartition(max(1, min(tasks, 4096)))


def readers(spark: SparkSession, files: int, n_bytes: int) -> int:
    """Tasks that read so many files: three for each core, more where that leaves a task over READ_TASK bytes, one for each file at most."""
    return min(files, max(3 * spark.sparkContext.defaultParallelism, n_bytes // READ_TASK))


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the row of ``table`` that has their ``key``; ``table``: unique keys, and n, how many of ``total`` rows have each.

    Keys of more than one in HOT rows, so fewer than HOT keys, are broadcast: a key
    with a third of all rows stays where it lies. The others meet by a shuffle.
    """
    hot = F.broadcast(table.where(F.col("n") * HOT > total))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") * HOT <= total), key)
    return rows.join(hot, key).unionByName(others)


def text_column(name: str = "text"):
    return F.col(name).cast("string")
