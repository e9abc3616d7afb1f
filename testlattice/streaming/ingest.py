"""Coverage reports merged into a stored map as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as sf
from ..model import REPORT
from ..operators import coverage
from ..sources import store
from ..sources.reports import report_reader

#: Rows of the stored map.
COVERED = "test_name string, test_class string, class_fqn string, method_fqn string, covered long"


def covered_rows(reports: DataFrame) -> DataFrame:
    """The covered methods of report trees as rows of the stored map."""
    own = coverage.covered_methods(reports)
    return own.select("test_name", sf.test_class(F.col("test_name")).alias("test_class"), "class_fqn", "method_fqn", F.col("covered").cast("long").alias("covered"))


def ingest_reports(spark: SparkSession, folder: str, path: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Start a query that merges the report files of a folder into the store, those that are new since its checkpoint, and ends when it has all.

    A test's rows replace those that the map had of it. A batch that was merged before the query was stopped, but not yet noted in the checkpoint, comes
    again with its number and is passed over.
    """
    files = report_reader(spark.readStream).option("maxFilesPerTrigger", files_a_batch).schema(REPORT).load(folder)
    reports = files.select(sf.test_of_file(F.col("_metadata.file_name")).alias("test_name"), "*")

    def add(batch: DataFrame, number: int) -> None:
        store.merge(path, covered_rows(batch), how=store.replace_tests, source=checkpoint, batch=number)

    return reports.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
