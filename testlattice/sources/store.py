"""A merged map that modules are merged into: Parquet in folders by hash of a key, and versions that say which folders count.

A merge reads and writes the folders of the keys that it brings, as new folders; then one small file, put in its place by a rename, names the folders of
the new version. A reader takes the newest version when it plans its read, so it sees all of a merge or none of it, and keeps what it saw, since folders are
never written twice. A version also names the last batch of each source, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import merge_metrics
from ..operators.merge import replace_test_classes
from ..session import pinned

PARTS = 64


def replace_tests(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` without the tests of ``new``, and ``new``."""
    return base.join(new.select("test_name").distinct(), "test_name", "left_anti").unionByName(new.select(*base.columns))


def merge_counters(base: DataFrame, new: DataFrame) -> DataFrame:
    """A3: least missed and most covered counts of each class."""
    return merge_metrics(base.unionByName(new.select(*base.columns)))


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts)).cast("int")


class Versions:
    """The version files of a store, by way of the file system that Spark uses for its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, f"{path.rstrip('/')}/versions"
        self.folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict]:
        """Number and content of the newest version; 0 and nothing where there is none."""
        if not self.fs.exists(self.folder):
            return 0, {"folders": {}, "batches": {}}
        numbers = [int(f.getPath().getName()[:-5]) for f in self.fs.listStatus(self.folder) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {"folders": {}, "batches": {}}
        stream = self.fs.open(self._file(max(numbers)))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _file(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number:010d}.json")

    def put(self, number: int, content: dict) -> None:
        """Make a version by renaming a written file; a version that another writer has made first is an error."""
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self.fs.exists(self._file(number)) or not self.fs.rename(draft, self._file(number)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another merge into {self.path} was faster; repeat this one")


def read(spark: SparkSession, path: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """The rows of the newest version, of all folders or of some; no rows where there is none."""
    _, content = Versions(spark, path).last()
    folders = [f for p, f in content["folders"].items() if parts is None or int(p) in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(path: str, new: DataFrame, key: str = "test_class", how: Callable[[DataFrame, DataFrame], DataFrame] = replace_test_classes, source: str = "", batch: int | None = None, parts: int = PARTS) -> bool:
    """Merge rows into the store, ``how`` (base, new) telling how those of one key hash meet; false if the batch of this source was merged before."""
    spark = new.sparkSession
    versions = Versions(spark, path)
    number, content = versions.last()
    if batch is not None and content["batches"].get(source, -1) >= batch:
        return False
    parts = content.get("parts", parts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    kept = pinned(new.withColumn("_part", _part(key, parts)))
    touched = sorted(r["_part"] for r in kept.select("_part").distinct().collect())  # at most ``parts``
    merged = how(read(spark, path, schema, touched), kept.drop("_part")).withColumn("_part", _part(key, parts))
    to = f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    # a folder's rows are dealt out once more by key, so that a large folder isn't one task
    merged.repartition("_part", key).write.partitionBy("_part").parquet(to)
    written = {str(r["_part"]) for r in spark.read.parquet(to).select("_part").distinct().collect()} if touched else set()
    folders = {p: f for p, f in content["folders"].items() if int(p) not in touched} | {p: f"{to}/_part={p}" for p in written}
    batches = content["batches"] | ({source: batch} if batch is not None else {})
    versions.put(number + 1, {"parts": parts, "folders": folders, "batches": batches})
    return True
