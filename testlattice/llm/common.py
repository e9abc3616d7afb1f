"""Helpers that every corpus operator shares: session set-up, checkpoints, table reading."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers get batches of at most so many rows and bytes, whatever the length of a text.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Make a session fit for the operators: bounded Arrow batches, a checkpoint folder, and the package on every executor.

    The cluster's ``spark.checkpoint.dir`` is used as it is; a folder is made only where the setting is absent and Spark runs in one process (tests).
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="testlattice-checkpoint-"))
    if sc.applicationId not in _shipped:
        sc.addPyFile(_package_zip())
        _shipped.add(sc.applicationId)
    return spark


def _package_zip() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="testlattice-ship-"), "testlattice_llm_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in ("__init__.py", *(f"llm/{x}" for x in sorted(os.listdir(os.path.join(root, "llm"))) if x.endswith(".py"))):
            z.write(os.path.join(root, name), f"testlattice/{name}")
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let go of shuffle and checkpoint files that no live DataFrame needs.

    Spark deletes them when their owners are collected; a driver with little to do collects seldom, so it is asked to. What planning and compiling have
    freed outside its heap goes back to the system too.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Ask the driver's JVM to return freed native memory, by its command ``System.trim_native_heap`` (Linux, JDK 17.0.9 on); False where it has none."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that a lost executor costs no long recomputation."""
    ready(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Return memory that a worker has freed to the system: workers stay for the next stage, which may need it in another process."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most_rows: int = BATCH_ROWS) -> DataFrame:
    """``work`` on each Arrow batch of ``df``, ``most_rows`` at a time."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                if (out := work(batch.slice(at, most_rows))) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str) -> DataFrame:
    """``left`` joined with a ``right`` of one row a key; the rows of a key are dealt out to SALTS places by the hash of ``by``, each with a copy of the right row."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    few = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.join(few, [*on, "_salt"], how).drop("_salt")


class Memo:
    """What ``make`` gives for words, made once for words that return: two generations of at most ``most`` words, so that frequent ones stay when rare ones go."""

    def __init__(self, make: Callable[[list], list], most: int):
        self.make, self.most = make, most
        self.now: dict = {}
        self.before: dict = {}

    def learn(self, texts: list[list]) -> Callable:
        """A look-up that knows all words of the texts, until the next call."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        met = {w for x in texts for w in x if w not in now}
        new = [w for w in met if w not in before]
        now.update((w, before[w]) for w in met if w in before)
        if new:
            now.update(zip(new, self.make(new), strict=True))
        return now.__getitem__


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]
