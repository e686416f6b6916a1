"""Folders for what an operator writes in between, shared by the driver and the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where that is unset and all runs in one process, a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="schemaloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder, or None where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file of the shared folder; readers see the old one or the new one, or for a moment none."""
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(fresh)
    stream.write(text.encode())
    stream.close()
    system.delete(target, False)
    if not system.rename(fresh, target):
        raise OSError(f"could not write {path}")


_made: list[str] = []


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared one; deleted when the application ends, if not before."""
    path = f"{shared_dir(spark)}/schemaloom-{purpose}-{uuid.uuid4().hex}"
    _made.append(path)

    def tidy() -> None:
        try:
            if path in _made:
                delete_path(spark, path)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(tidy)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that are made inside, once what was computed from them is written elsewhere."""
    before = len(_made)
    yield
    for path in _made[before:]:
        delete_path(spark, path)
    del _made[before:]


def written(df: DataFrame, path: str, small: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in a shared folder and read it back.

    ``small`` rows, without texts, are first gathered into files of a usual size, rather than one from each task.
    """
    (df.hint("rebalance") if small else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
