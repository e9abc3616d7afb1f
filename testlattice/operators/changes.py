"""Changed classes, methods, tests and files out of version-control text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sf
from ..session import pinned


def changed_files(paths: DataFrame) -> DataFrame:
    """Distinct paths of (origin, line) rows, committed and uncommitted together."""
    return paths.select(F.trim("line").alias("path")).where("path <> ''").distinct()


def changed_classes(files: DataFrame) -> DataFrame:
    """F1, P12 over paths: production classes."""
    return files.select(sf.path_to_fqn(F.col("path")).alias("class_fqn")).where("class_fqn is not null").distinct()


def changed_tests(name_status: DataFrame) -> DataFrame:
    """(test_fqn, status), the last status of each test file; lines are (ord, line)."""
    status, path = sf.name_status(F.col("line"))
    own = name_status.select("ord", status.alias("status"), sf.test_path_to_fqn(path).alias("test_fqn")).where("test_fqn is not null")
    return own.groupBy("test_fqn").agg(F.max(F.struct("ord", "status")).alias("x")).select("test_fqn", "x.status")


def patch_classes(patch: DataFrame, by: str = "patch_id") -> DataFrame:
    """Every patch line with the class of the file it belongs to; lines are (patch_id, line_no, line).

    A ``diff --git`` line always carries a struct, whose path may name no class, so a file that is no source ends the one before. Lines are dealt out by
    ranges, whatever the number of patches: each range is filled on its own, and what comes before its first header is that of the last range with one. The
    window over ranges has a row for each range and patch.
    """
    head = F.col("line").startswith("diff --git")
    mark = F.when(head, F.struct(sf.diff_target(F.col("line")).alias("path")))
    dealt = pinned(patch.withColumn("_head", head).withColumn("_mark", mark).repartitionByRange(by, "line_no").withColumn("_range", F.spark_partition_id()))
    inside = F.last("_mark", ignorenulls=True).over(W.partitionBy("_range", by).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ends = dealt.groupBy("_range", by).agg(F.max_by("_mark", F.when(F.col("_head"), F.col("line_no"))).alias("_last"))
    told = ends.select("_range", F.col(by).alias("_by"), carried.alias("_carried"))
    filled = dealt.withColumn("_inside", inside).alias("l").join(told.alias("r"), (F.col("l._range") == F.col("r._range")) & F.col(f"l.{by}").eqNullSafe(F.col("r._by")))
    path = F.coalesce("_inside", "_carried")["path"]
    return filled.select(*(F.col(f"l.{c}") for c in patch.columns), F.col("l._head"), sf.path_to_fqn(path).alias("class_fqn"))


def changed_methods(patch: DataFrame, by: str = "patch_id") -> DataFrame:
    """F3, F4 over patch lines: methods that hunk headers name."""
    lines = patch.where(F.col("line").startswith("diff --git") | F.col("line").startswith("@@"))
    hunks = patch_classes(lines, by).where(~F.col("_head") & F.col("class_fqn").isNotNull())
    named = hunks.select("class_fqn", sf.method_name(sf.hunk_context(F.col("line"))).alias("m")).where("m is not null")
    return named.select(F.concat_ws("#", "class_fqn", "m").alias("method_fqn")).distinct()


def commit_distance(commits: DataFrame, commit_id: str) -> DataFrame:
    """Commits after ``commit_id`` in a table of (position, commit_id); no row if it is unknown."""
    own = commits.where(F.col("commit_id") == commit_id).agg(F.max("position").alias("p")).where("p is not null")
    return commits.join(own, F.col("position") > F.col("p"), "right").groupBy("p").agg(F.count("commit_id").alias("distance")).select("distance")
