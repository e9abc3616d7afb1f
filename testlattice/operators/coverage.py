"""Coverage reports to rows, counters and merged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sf
from ..session import numbered

FIELDS = ("line_missed", "line_covered", "branch_missed", "branch_covered")


def _counter(counters: str, kind: str, field: str) -> F.Column:
    return F.aggregate(F.filter(F.coalesce(F.col(counters), F.array().cast("array<struct<_type:string,_missed:int,_covered:int>>")), lambda c: c["_type"] == kind), F.lit(0), lambda a, c: a + F.coalesce(c[field], F.lit(0)))


def classes(reports: DataFrame) -> DataFrame:
    """(test_name, class_fqn, class) of report trees (test_name, package)."""
    return reports.select("test_name", F.explode("package").alias("p")).select("test_name", F.explode("p.class").alias("c")).select("test_name", sf.to_dots(F.col("c._name")).alias("class_fqn"), "c")


def covered_methods(reports: DataFrame) -> DataFrame:
    """Methods with a covered instruction, (test_name, class_fqn, method_fqn, covered)."""
    methods = classes(reports).select("test_name", "class_fqn", F.explode("c.method").alias("m")).select("test_name", "class_fqn", F.concat_ws("#", "class_fqn", "m._name").alias("method_fqn"), F.col("m.counter").alias("counter"))
    return methods.select("test_name", "class_fqn", "method_fqn", _counter("counter", "INSTRUCTION", "_covered").alias("covered")).where("covered > 0")


def mappings(covered: DataFrame) -> DataFrame:
    """Sorted distinct classes and methods of each test."""
    return covered.groupBy("test_name").agg(F.sort_array(F.collect_set("class_fqn")).alias("classes"), F.sort_array(F.collect_set("method_fqn")).alias("methods"))


def without_test_classes(cov_class: DataFrame, cov_method: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class rows without test classes, and method rows without those of classes just dropped from the same test (of the same map, where rows name one)."""
    keys = [c for c in ("map_id",) if c in cov_class.columns and c in cov_method.columns] + ["test_name", "class_fqn"]
    dropped = cov_class.where(sf.is_test_class(F.col("class_fqn"))).select(*keys).distinct()
    return cov_class.where(~sf.is_test_class(F.col("class_fqn"))), cov_method.join(dropped, keys, "left_anti")


def with_covered_lines(reports: DataFrame) -> DataFrame:
    """Report trees with only the classes that have a covered line, as the XML writer wants them; packages that are left empty stay."""
    covered = lambda c: F.exists(F.coalesce(c["counter"], F.array().cast("array<struct<_type:string,_missed:int,_covered:int>>")), lambda x: (x["_type"] == "LINE") & (x["_covered"] > 0))
    return reports.withColumn("package", F.transform("package", lambda p: p.withField("class", F.filter(p["class"], covered))))


def class_counters(reports: DataFrame) -> DataFrame:
    """Counters of the classes of report trees, one row for each test and class."""
    return classes(reports).select("test_name", "class_fqn", F.col("c.counter").alias("counter")).select("test_name", "class_fqn", *(_counter("counter", kind, f"_{field}").alias(f"{kind.lower()}_{field}") for kind in ("LINE", "BRANCH") for field in ("missed", "covered")))


def merge_metrics(counters: DataFrame) -> DataFrame:
    """Least missed and most covered of each class; classes without lines are left out. This is no union of covered lines."""
    seen = counters.where("line_missed + line_covered > 0")
    return seen.groupBy("class_fqn").agg(F.min("line_missed").alias("line_missed"), F.max("line_covered").alias("line_covered"), F.min("branch_missed").alias("branch_missed"), F.max("branch_covered").alias("branch_covered"))


def production_metrics(metrics: DataFrame) -> DataFrame:
    """P5: metrics without test classes."""
    return metrics.where(~sf.is_test_class(F.col("class_fqn")))


def percentages(metrics: DataFrame) -> DataFrame:
    """Line and branch percentages."""
    line, branch = (F.col(f"{k}_missed") + F.col(f"{k}_covered") for k in ("line", "branch"))
    return metrics.select("class_fqn", sf.percent(F.col("line_covered"), line).alias("line_pct"), sf.percent(F.col("branch_covered"), branch).alias("branch_pct"))


def lines(reports: DataFrame) -> DataFrame:
    """(test_name, pkg, sourcefile, nr, mi, ci, mb, cb) of report trees."""
    files = reports.select("test_name", F.explode("package").alias("p")).select("test_name", F.col("p._name").alias("pkg"), F.explode("p.sourcefile").alias("s"))
    return files.select("test_name", "pkg", F.col("s._name").alias("sourcefile"), F.explode("s.line").alias("l")).select("test_name", "pkg", "sourcefile", *(F.col(f"l._{c}").alias(c) for c in ("nr", "mi", "ci", "mb", "cb")))


def merge_lines(line_cov: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """A4: lines of several reports as one. Covered counts are the largest; the total is that of the first report by ``order``."""
    total = lambda m, c: F.min(F.struct(F.col(order), (F.col(m) + F.col(c)).alias("t")))["t"]
    merged = line_cov.groupBy(*keys, "nr").agg(F.max("ci").alias("ci"), total("mi", "ci").alias("ti"), F.max("cb").alias("cb"), total("mb", "cb").alias("tb"))
    zero = F.lit(0)
    return merged.select(*keys, "nr", F.greatest(zero, F.col("ti") - F.col("ci")).cast("int").alias("mi"), "ci", F.greatest(zero, F.col("tb") - F.col("cb")).cast("int").alias("mb"), "cb")


def line_percent(merged: DataFrame, *keys: str) -> DataFrame:
    """A5: percentage of instructions and branches, and lines hit and missed; no row where nothing is counted."""
    out = merged.groupBy(*keys).agg(F.sum(F.col("ci") + F.col("cb")).alias("covered"), F.sum(F.col("ci") + F.col("mi") + F.col("cb") + F.col("mb")).alias("total"), F.count_if(F.col("ci") > 0).alias("lines_hit"), F.count_if((F.col("ci") == 0) & (F.col("mi") > 0)).alias("lines_missed"))
    return out.where("total > 0").select(*keys, sf.percent(F.col("covered"), F.col("total")).alias("pct"), "lines_hit", "lines_missed")


def dictionary(names: DataFrame, column: str) -> DataFrame:
    """0-based ids of the sorted distinct names."""
    return numbered(names.select(column).distinct(), column, name="id")


def encoded(cov: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """K2: for each test the sorted ids of its names."""
    return cov.join(ids, column).groupBy("test_name").agg(F.sort_array(F.collect_set("id")).alias("ids"))
