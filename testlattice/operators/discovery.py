"""Test classes that a coverage map does not know, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sf

# The reasons that are shown.
MODIFIED_KNOWN = "Modified test class — may contain new test methods"
NEW, CHANGED, UNKNOWN = "New test — added after coverage map", "Modified after coverage map", "Not in coverage map"
DISABLED, ENCLOSED = "All tests @Disabled/@Ignore", "Enclosed runner — tests only in inner classes"
PACKAGE_PRIVATE = "Package-private class — may not produce coverage sessions"
CONDITIONAL = "Conditional skip — tests may not execute without env vars"
ARCH, NO_TESTS = "ArchUnit test — @ArchTest fields, no standard @Test", "No @Test methods found"


def known_classes(map_test: DataFrame) -> DataFrame:
    """Simple names of the test classes of a map."""
    return map_test.where(F.instr("test_name", "#") > 1).select(sf.test_class(F.col("test_name")).alias("simple")).distinct()


def classes_on_disk(files: DataFrame, any_class: bool = False) -> DataFrame:
    """(class_fqn, simple) of compiled classes; ``any_class`` keeps those not named like tests."""
    fqn = sf.to_dots(F.regexp_replace("rel_path", r"\.class$", ""))
    own = files.where(F.col("rel_path").endswith(".class") & ~F.col("rel_path").contains("$")).select(fqn.alias("class_fqn")).withColumn("simple", sf.short_class(F.col("class_fqn")))
    return (own if any_class else own.where(sf.looks_like_test(F.col("simple")))).distinct()


def new_tests(files: DataFrame, map_test: DataFrame, any_class: bool = False) -> DataFrame:
    """Classes on disk whose simple name no test of the map has."""
    return classes_on_disk(files, any_class).join(known_classes(map_test), "simple", "left_anti").select("class_fqn")


def modified_known(changed_test: DataFrame, map_test: DataFrame) -> DataFrame:
    """Changed test files with the simple name of a known class that was added or modified somewhere."""
    own = changed_test.withColumn("simple", sf.short_class(F.col("test_fqn")))
    touched = own.where(F.col("status").isin("A", "M")).select("simple").distinct().join(known_classes(map_test), "simple", "left_semi")
    return own.join(touched, "simple", "left_semi").select(F.col("test_fqn").alias("class_fqn"))


# White space that is trimmed from a line, without the line's end.
_BLANK = r"[\x00-\x09\x0b-\x20]"
_COMMENT = rf"(?dm)^{_BLANK}*/(?=\*)(?:(?s:.*?)\*/[^\n]*|(?s:.*))"


def code_text(text: Column) -> Column:
    """The text with empty lines in place of block comments.

    A comment opens where a line begins with its mark, and ends with the line that has the closing mark, or with the text; both marks may share a line.
    One expression cuts all comments in one pass, so neither its code nor its time depends on the number of lines.
    """
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _COMMENT, "")


def code_lines(text: Column) -> Column:
    """The trimmed lines of ``code_text`` as an array."""
    return F.transform(F.split(code_text(text), "\n"), lambda x: F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+$", ""))


def source_reason(text: Column) -> Column:
    """why a test class may have no coverage; null if its source says nothing."""
    return _reason(text, code_text(text))


def _reason(text: Column, code: Column) -> Column:
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(code.rlike(rf"(?dm)^{_BLANK}*@(?:Disabled|Ignore)(?:\(|{_BLANK}*$)"), DISABLED)
        .when(code.contains("Enclosed.class"), ENCLOSED)
        .when(code.rlike(rf"(?dm)^{_BLANK}*(?:final[ \t\x0b\f]+)?class[ \t\x0b\f]+[^\s]"), PACKAGE_PRIVATE)
        .when(text.contains("System.getenv("), CONDITIONAL)
        .when(code.contains("@ArchTest"), ARCH)
        .when(~(code.contains("@Test") | code.contains("@ParameterizedTest")), NO_TESTS)
    )


def not_instantiable(text: Column) -> Column:
    """P10: whether the first declaration of a source is abstract, an interface or an annotation."""
    return _first_abstract(code_lines(text))


def _first_abstract(lines: Column) -> Column:
    kind = lambda x: F.when((x == "") | x.rlike("^(package |import |//)"), 0).when(x.contains("abstract class ") | x.contains("@interface ") | x.rlike(r"\binterface\s+\w+"), 1).when(x.startswith("@"), 0).when(x.contains(" class ") | x.contains(" enum "), 2).otherwise(0)
    told = F.filter(F.transform(lines, kind), lambda k: k > 0)
    return F.coalesce(F.try_element_at(told, F.lit(1)) == 1, F.lit(False))


def unmapped(files: DataFrame, map_test: DataFrame, changed_test: DataFrame, source: DataFrame) -> DataFrame:
    """(class_fqn, reason) of all classes that have to run although the map doesn't know them.

    ``source``: (class_fqn, text). Classes that cannot be instantiated are left out; a reason from the status of a changed file comes before one from the source.
    """
    facts = source.select("class_fqn", not_instantiable(F.col("text")).alias("_skip"), source_reason(F.col("text")).alias("_why"))
    own = new_tests(files, map_test).join(facts, "class_fqn", "left").where(~F.coalesce("_skip", F.lit(False)))
    status = changed_test.select(F.col("test_fqn").alias("class_fqn"), "status")
    told = own.join(status, "class_fqn", "left").select("class_fqn", F.when(F.col("status") == "A", NEW).when(F.col("status") == "M", CHANGED).otherwise(F.coalesce("_why", F.lit(UNKNOWN))).alias("reason"))
    known = modified_known(changed_test, map_test).select("class_fqn", F.lit(MODIFIED_KNOWN).alias("reason"))
    return told.unionByName(known.join(told, "class_fqn", "left_anti"))
