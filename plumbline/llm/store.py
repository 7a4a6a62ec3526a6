"""Places that the driver and all executors share.

Intermediate tables and files go below ``spark.checkpoint.dir``. Only where that is
unset and Spark runs in one process, as in tests, a temporary folder takes its place.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether a query's shuffle files are deleted when it ends; a written table needs them no more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's intermediate data, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        base = _LOCAL[app]
    return base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nobody has used; it is not created."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, batch: int = 1000) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, survives lost executors.

    Whole texts and sets go to the Python workers in batches of ``batch`` rows and 16 MB at
    most, which bounds what is held at once.
    """
    spark = df.sparkSession
    path = new_dir(spark, tag)
    settings = {_BATCH: str(min(int(spark.conf.get(_BATCH)), batch)), _BYTES: str(16 << 20), _CLEAN: "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, whose worker gives its memory back when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once everything made of it is written too."""
    for df in tables:
        drop(df.sparkSession, df.stored_at)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` to be broadcast if it holds ``most`` rows at most, else as it is; for narrow tables that are written."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared folder once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI (file, hdfs, s3, gs) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
