"""Files in the folders that driver and executors share, through Spark's file systems.

Whatever a path's scheme (hdfs, s3a, viewfs, file), listing, small texts and footers
go through Hadoop's FileSystem in the driver; no Spark job is started.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of every data file under ``path``, hidden ones left out, in order of path."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    found, each = [], fs.listFiles(p, True)
    while each.hasNext():
        f = each.next()
        if not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def first_file(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """The first data file that a listing of ``path`` gives; the rest is not listed."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    each = fs.listFiles(p, True)
    while each.hasNext():
        f = each.next()
        if not f.getPath().getName().startswith(("_", ".")):
            return f.getPath().toString(), f.getLen(), f.getModificationTime()
    return None


def version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under ``paths``: their names, sizes and modification times."""
    listed = [(path, *f) for path in sorted(paths) for f in data_files(spark, path)]
    return hashlib.sha256(repr(listed).encode()).hexdigest()


def parquet_columns(spark: SparkSession, file: str) -> list[str]:
    """Column names in the footer of a parquet file."""
    jvm = spark._jvm
    where = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(where)
    try:
        return [f.getName() for f in reader.getFooter().getFileMetaData().getSchema().getFields()]
    finally:
        reader.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, p = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already (of several callers, one makes it)."""
    fs, p = _open(spark, path)
    return fs.createNewFile(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)
