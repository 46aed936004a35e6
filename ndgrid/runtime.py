"""What every distributed operator needs: package code on the Python workers and a folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
_written: dict[str, list[str]] = {}


#: Rows that go to a Python worker at a time, where the session does not say: texts and chunk payloads may be large,
#: and Spark's default is 10,000.
ARROW_ROWS = 2000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Put this package on the workers' path, once per application; executors fetch it from the driver."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, ARROW_ROWS)
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    name = f"ndgrid-{hashlib.sha256(buf.getvalue()).hexdigest()[:12]}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="ndgrid-"), name)
    Path(path).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


#: Allocations of this many bytes get pages of their own, which go back to the system when they are freed.
MMAP_BYTES = 1 << 20
_M_MMAP_THRESHOLD = -3


def lean(work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``work`` over a task's batches, in a worker that holds little memory besides what is in use.

    Arrow takes its buffers from malloc, large ones have pages of their own, and after each batch what is free goes
    back to the system: Spark keeps Python workers for later tasks, and all they hold counts against the executor.
    """

    def run(batches):
        libc = ctypes.CDLL(None)
        glibc = hasattr(libc, "malloc_trim")
        if glibc:
            pa.set_memory_pool(pa.system_memory_pool())
            libc.mallopt(_M_MMAP_THRESHOLD, MMAP_BYTES)
        try:
            for out in work(batches):
                yield out
                if glibc:
                    libc.malloc_trim(0)
        finally:
            if glibc:
                libc.malloc_trim(0)

    return run


@contextlib.contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Jobs that start inside carry ``text`` in Spark's UI and event log; the description before comes back."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(text)
    try:
        yield
    finally:
        context.setJobDescription(before)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, driver and executors must be one process (``local[n]``, as in tests): it is a new folder then.
    A cluster without a shared folder raises, as what one executor writes to its own disk the others cannot read.
    """
    context = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return base
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="ndgrid-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    base = shared_folder(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`cut` or :func:`shared_path` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_shared(spark: SparkSession) -> int:
    """Delete everything this application has written through :func:`shared_path`; call it once results are consumed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)
