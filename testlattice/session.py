"""Session helpers for the coverage operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is made only where none is named and Spark runs in one process."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", ""):
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="testlattice-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of the given columns.

    Rows are dealt out by ranges, numbered within their range, and moved by the sizes of the ranges before: no task sees all rows, and the one
    window without a partition runs over a row for each range.
    """
    dealt = pinned(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_start"))
    inside = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return inside.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_part", "_start", "_at")
