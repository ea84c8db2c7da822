"""Folders and tables that the driver and the executors share."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set: a temporary folder on a local master, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        path = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, path, True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of any address that Spark reads."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it was there. Of several callers one makes it.

    A local file system's own "create" looks first and makes then, so there the operating system is asked.
    """
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(p, False).close()
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    return True


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written to a new table in the shared folder and read back: lineage ends, and lost executors cost a task."""
    path = f"{shared_dir(df.sparkSession)}/lodestrata-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files under some paths: their names, sizes and times."""
    seen = []
    for path in paths:
        fs, p = file_system(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def built(spark: SparkSession, name: str, make: Callable[[str], object]) -> str:
    """The folder that make(path) writes once, under a name in the shared folder.

    It is written under a name of its own and renamed at the end, so that no half of it is ever read.
    """
    path = f"{shared_dir(spark)}/lodestrata-{name}"
    if not exists(spark, path):
        part = f"{path}-{uuid.uuid4().hex}"
        make(part)
        fs, source = file_system(spark, part)
        if not fs.rename(source, file_system(spark, path)[1]):
            # another session was first
            remove(spark, part)
    return path


def kept(spark: SparkSession, name: str, schemas: dict[str, str], make) -> dict[str, DataFrame]:
    """Tables that are made once and read from then on. make() -> {table: (DataFrame, write)}; write(df, path) writes one."""

    def write_all(part: str) -> None:
        for table, (df, write) in make().items():
            write(df, f"{part}/{table}")

    path = built(spark, name, write_all)
    return {table: spark.read.schema(schema).parquet(f"{path}/{table}") for table, schema in schemas.items()}
