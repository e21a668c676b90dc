"""Where the operators of this subpackage keep tables and files that several machines read.

Everything goes below the folder that the cluster names in ``spark.checkpoint.dir``, so a
lost executor takes nothing with it that a later stage needs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder. Where it is unset and the master is local, a new temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="seqlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if "://" in found or found.startswith("file:/") else "file://" + os.path.abspath(found)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has used, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/seqlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="seqlake-zip-"), "seqlake_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def settle() -> None:
    """Gives what a Python worker has freed back to the system: workers stay, and the next stage's tasks come on top."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settled(run):
    """A function of Arrow batches that settles when a task is through."""

    def wrapped(frames):
        yield from run(frames)
        settle()

    return wrapped


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI: file, hdfs, s3 and gs work from any executor."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def clean(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, each cast to its type; columns beyond those, whatever their names, go."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in columns.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
