"""Shared working folders, written tables, and reaching binary files from tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    A session on one machine without that setting (tests) gets a folder of its own, once; several machines need it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("several machines need a shared folder: set spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, scratch: list[str] | None = None, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors.

    scratch: a list that the folder's name is put on, for ``delete``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if scratch is not None:
        scratch.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended: it does so once the driver's JVM collects their plans."""
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, scratch: list[str]) -> None:
    """Delete written tables that nothing reads any more, and the shuffle files of the queries that wrote or read them."""
    free_shuffles(spark)
    jvm = spark.sparkContext._jvm
    for name in scratch:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; plain paths are local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


def put_in_place(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file; a retried or speculative task leaves the same bytes under the same name."""
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(temporary, final)


def open_for_reading(uri: str) -> pa.NativeFile:
    """Memory-mapped where the folder is mounted, else a seekable remote file."""
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
