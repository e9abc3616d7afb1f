"""Small trees of named files below the shared folder, for queries over sources that go by file names; Spark's own writers name their files themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def write_files(spark: SparkSession, folder: str, files: Iterable[tuple[str, str]]) -> None:
    """Files of (path below the folder, text), written one by one."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in files:
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def move_parts(spark: SparkSession, folder: str, to: str, name) -> None:
    """The one file in each subfolder of ``folder`` (key=value) moved to ``to``, ``name`` making its name out of the value: a rename for each, nothing is read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    for found in fs.globStatus(path(f"{folder}/*=*/part-*")):
        key = jvm.java.net.URLDecoder.decode(found.getPath().getParent().getName().replace("+", "%2B"), "UTF-8").partition("=")[2]
        if not fs.rename(found.getPath(), path(f"{to}/{name(key)}")):
            raise OSError(f"{found.getPath().toString()} could not be renamed")
