"""Maps, selections and metrics of several modules or runs as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sf


def last_wins(tests: DataFrame, order: str = "file_ord") -> DataFrame:
    """One row for each test, that of the last file."""
    value = F.struct(order, *(c for c in tests.columns if c not in ("test_name", order)))
    kept = tests.groupBy("test_name").agg(F.max(value).alias("x"))
    return kept.select("test_name", *(f"x.{c}" for c in tests.columns if c not in ("test_name", order)))


def first_metadata(meta: DataFrame, order: str = "file_ord") -> DataFrame:
    """The metadata of the first file that has any."""
    fields = [c for c in meta.columns if c != order]
    some = F.coalesce(*(F.col(c).cast("string") for c in fields)).isNotNull()
    return meta.where(some).agg(F.min(F.struct(order, *fields)).alias("x")).where("x is not null").select(*(f"x.{c}" for c in fields))


def replace_test_classes(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` without the test classes of ``new``, and ``new``; both with (test_name, test_class, ...)."""
    return base.join(new.select("test_class").distinct(), "test_class", "left_anti").unionByName(new.select(*base.columns))


def enrich(selected: DataFrame, unmapped: DataFrame, map_test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, unmapped) after unmapped classes were looked up in a newer map by simple name.

    A class is resolved if the map has a test of that name that wasn't selected yet. Of several classes with one simple name the first, by name, gets the tests.
    """
    names = unmapped.groupBy(sf.short_class(F.col("class_fqn")).alias("simple")).agg(F.min("class_fqn").alias("class_fqn"))
    fresh = map_test.select("test_name").distinct().join(selected.select("test_name"), "test_name", "left_anti").withColumn("simple", sf.test_class(F.col("test_name")))
    found = fresh.join(names, "simple")
    tests = selected.select("test_name").unionByName(found.select("test_name")).distinct()
    return tests, unmapped.join(found.select("class_fqn").distinct(), "class_fqn", "left_anti")


def first_module(files: DataFrame, key: str) -> DataFrame:
    """For each key the first module or directory that holds it, of (key, ord, module); aggregator modules (packaging pom) never count."""
    own = files.where(F.coalesce(F.col("packaging"), F.lit("jar")) != "pom") if "packaging" in files.columns else files
    return own.groupBy(key).agg(F.min(F.struct("ord", "module")).alias("x")).select(key, "x.module")


def changed_modules(changed_class: DataFrame, class_file: DataFrame) -> DataFrame:
    """Module of each changed class; files are (rel_path, ord, module)."""
    own = changed_class.select("class_fqn", F.concat(sf.to_slashes(F.col("class_fqn")), F.lit(".class")).alias("rel_path"))
    return own.join(first_module(class_file.join(own, "rel_path", "left_semi"), "rel_path"), "rel_path").select("class_fqn", "module")


def test_modules(test_file: DataFrame, by_name: bool = False) -> DataFrame:
    """Module of each compiled test class: by full name, or by simple name as test names carry it."""
    fqn = sf.to_dots(F.regexp_replace("rel_path", r"\.class$", ""))
    key = sf.short_class(fqn) if by_name else fqn
    return first_module(test_file.withColumn("class_key", key), "class_key")


def affected_modules(selected: DataFrame, unmapped: DataFrame, changed_class: DataFrame, test_file: DataFrame, class_file: DataFrame) -> DataFrame:
    """Modules of selected tests, and modules of unmapped tests that hold changed code."""
    by_test = selected.select(sf.test_class(F.col("test_name")).alias("class_key")).distinct().join(test_modules(test_file, by_name=True), "class_key").select("module")
    of_unmapped = unmapped.select(F.col("class_fqn").alias("class_key")).distinct().join(test_modules(test_file), "class_key").select("module")
    with_changes = changed_modules(changed_class, class_file).select("module").distinct()
    return by_test.unionByName(of_unmapped.join(with_changes, "module", "left_semi")).distinct()


def unmapped_of_modules(unmapped: DataFrame, test_file: DataFrame, modules: DataFrame) -> DataFrame:
    """Unmapped classes whose compiled file is in one of the modules."""
    own = unmapped.withColumn("class_key", F.col("class_fqn")).join(test_modules(test_file), "class_key")
    return own.join(modules.select("module").distinct(), "module", "left_semi").select("module", "class_fqn")


def prune(selected: DataFrame, xml_file: DataFrame) -> DataFrame:
    """Selected tests for which there is a coverage file, under its plain name."""
    there = xml_file.select(F.regexp_replace(F.regexp_replace("file_name", "^session_", ""), r"\.xml$", "").alias("test_name")).distinct()
    return selected.join(there, "test_name", "left_semi")


def stale_artifacts(files: DataFrame, test_classes: DataFrame, unmapped: DataFrame | None = None) -> DataFrame:
    """Files whose name contains the name of an affected test class, or the simple name of an unmapped one (class_fqn).

    Candidates are all parts of a file name that are as long as some class name, so containing is an equality join, and exact.
    """
    names = test_classes.select("test_class")
    if unmapped is not None:
        names = names.unionByName(unmapped.select(sf.short_class(F.col("class_fqn")).alias("test_class")))
    names = names.where("test_class is not null").distinct()
    sizes = names.agg(F.collect_set(F.length("test_class")).alias("sizes"))
    own = files.select("file_name").distinct().crossJoin(F.broadcast(sizes))
    fitting = own.select("file_name", F.explode(F.filter("sizes", lambda n: n <= F.length("file_name"))).alias("size"))
    starts = fitting.select("file_name", "size", F.explode(F.sequence(F.lit(1), F.length("file_name") - F.col("size") + 1)).alias("at"))
    parts = starts.select("file_name", F.substring(F.col("file_name"), F.col("at"), F.col("size")).alias("test_class"))
    return parts.join(names, "test_class", "left_semi").select("file_name").distinct()


def run_summary(metric: DataFrame, *keys: str) -> DataFrame:
    """Totals of test metrics; any status but PASSED and FAILED counts as skipped, and unknown durations (-1) are added as they are."""
    passed, failed = F.count_if(F.col("status") == "PASSED"), F.count_if(F.col("status") == "FAILED")
    out = metric.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), failed.alias("failed"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
    return out.withColumn("skipped", F.col("total") - F.col("passed") - F.col("failed"))


def status_counts(runs: DataFrame) -> DataFrame:
    """How many rows have each status."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
