"""Ad-hoc questions to a map. An empty result is a miss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_ignoring_case, one_decimal
from ..model import SUGGESTIONS


def statistics(map_test: DataFrame, cov_class: DataFrame, cov_method: DataFrame) -> DataFrame:
    """Tests, distinct classes and methods, and least, most and mean classes of a test; nulls for an empty map."""
    sizes = cov_class.groupBy("test_name").agg(F.count_distinct("class_fqn").alias("n"))
    tests = map_test.select("test_name").distinct().join(sizes, "test_name", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    a = tests.agg(F.count(F.lit(1)).alias("tests"), F.min("n").alias("min_classes"), F.max("n").alias("max_classes"), F.avg("n").alias("m"))
    b, c = cov_class.agg(F.count_distinct("class_fqn").alias("classes")), cov_method.agg(F.count_distinct("method_fqn").alias("methods"))
    return a.crossJoin(b).crossJoin(c).select("tests", "classes", "methods", "min_classes", "max_classes", one_decimal(F.col("m")).alias("avg_classes"))


def by_test(cov: DataFrame, test: str, column: str) -> DataFrame:
    """Sorted classes or methods of a test."""
    return cov.where(F.col("test_name") == test).select(column).distinct().orderBy(column)


def similar_tests(map_test: DataFrame, part: str) -> DataFrame:
    """P14 on a miss: tests whose name contains the text."""
    return map_test.where(F.contains(F.col("test_name"), F.lit(part))).select("test_name").distinct()


def by_class(cov_class: DataFrame, fqn: str) -> DataFrame:
    """Sorted tests that cover a class."""
    return cov_class.where(F.col("class_fqn") == fqn).select("test_name").distinct().orderBy("test_name")


def similar_classes(cov_class: DataFrame, part: str, most: int = SUGGESTIONS) -> DataFrame:
    """P15 on a miss, T3: the first ``most`` distinct classes, each test giving the first of its list that contains the text."""
    first = cov_class.where(F.contains(F.col("class_fqn"), F.lit(part))).groupBy("test_name").agg(F.min(F.struct("pos", "class_fqn")).alias("x"))
    return first.select("x.class_fqn").distinct().orderBy("class_fqn").limit(most)


def by_method(cov_method: DataFrame, method: str) -> DataFrame:
    """Sorted tests that cover a method."""
    return cov_method.where(F.col("method_fqn") == method).select("test_name").distinct().orderBy("test_name")


def grep(map_test: DataFrame, cov_class: DataFrame, cov_method: DataFrame, part: str) -> DataFrame:
    """Distinct (kind, name) that contain the text, whatever its case."""
    out = None
    for kind, df, column in (("test", map_test, "test_name"), ("class", cov_class, "class_fqn"), ("method", cov_method, "method_fqn")):
        own = df.where(contains_ignoring_case(F.col(column), part)).select(F.lit(kind).alias("kind"), F.col(column).alias("name"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def section_search(rows: DataFrame, part: str, tests: bool = False, classes: bool = False, methods: bool = False, selected_only: bool = False) -> DataFrame:
    """Index rows (t, s, c, m) whose ticked fields contain the text; no field ticked means all."""
    every = not (tests or classes or methods)
    hit = F.lit(False)
    for ticked, column in ((tests, "t"), (classes, "c"), (methods, "m")):
        if ticked or every:
            hit = hit | contains_ignoring_case(F.col(column), part)
    return rows.where(hit & (F.col("s") if selected_only else F.lit(True)))


def answers(asked: DataFrame, map_test: DataFrame, cov_class: DataFrame, cov_method: DataFrame) -> DataFrame:
    """K13, P14-P16 for many questions (kind, name) at once: how many rows each answer has, and the exit code, 0 for a hit and 1 for a miss.

    A test answers with its classes and is a hit even without any; a class or a method answers with its tests. Each table is counted for the names that are
    asked alone. Questions of another kind, or without a name, are misses.
    """
    questions = asked.select("kind", "name").distinct()
    own = lambda kind: questions.where(F.col("kind") == kind).select("name")
    tests = map_test.select(F.col("test_name").alias("name")).distinct().join(own("test"), "name", "left_semi")
    parts = [tests.select(F.lit("test").alias("kind"), "name", F.lit(None).cast("string").alias("of"))]
    for kind, cov, key, of in (("test", cov_class, "test_name", "class_fqn"), ("class", cov_class, "class_fqn", "test_name"), ("method", cov_method, "method_fqn", "test_name")):
        parts.append(cov.select(F.lit(kind).alias("kind"), F.col(key).alias("name"), F.col(of).alias("of")).join(own(kind), "name", "left_semi"))
    found = reduce(DataFrame.unionByName, parts).distinct().groupBy("kind", "name").agg(F.count("of").alias("n"))
    told = questions.join(found, ["kind", "name"], "left")
    return told.select("kind", "name", F.coalesce("n", F.lit(0)).alias("rows"), F.when(F.col("n").isNull(), 1).otherwise(0).alias("exit_code"))
