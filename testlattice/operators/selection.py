"""Which tests does a change affect: method matches, class fallback, escalation, and the decision ladder around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import glob_regex
from ..functions.scalars import class_of_method, include_path, include_pattern, percent, test_class
from ..model import MAX_COMMIT_DISTANCE

METHOD, CLASS, ESCALATED = "METHOD", "CLASS", "ESCALATED"


def method_info_classes(changed_method: DataFrame) -> DataFrame:
    """Classes that some changed method names."""
    return changed_method.select(class_of_method(F.col("method_fqn")).alias("class_fqn")).where("class_fqn is not null").distinct()


def class_only(changed_class: DataFrame, changed_method: DataFrame) -> DataFrame:
    """Changed classes about which the change says nothing on methods."""
    return changed_class.select("class_fqn").distinct().join(method_info_classes(changed_method), "class_fqn", "left_anti")


def first_hits(cov_method: DataFrame, changed_method: DataFrame) -> DataFrame:
    """For each test the first changed method in its list, (test_name, method_fqn, class_fqn)."""
    touched = cov_method.join(changed_method.select("method_fqn").distinct(), "method_fqn", "left_semi")
    first = touched.groupBy("test_name").agg(F.min(F.struct("pos", "method_fqn")).alias("hit"))
    return first.select("test_name", "hit.method_fqn", class_of_method(F.col("hit.method_fqn")).alias("class_fqn"))


def hits_per_class(hits: DataFrame, changed_method: DataFrame) -> DataFrame:
    """How many tests are credited to each class with method information, 0 included."""
    counted = hits.groupBy("class_fqn").agg(F.count(F.lit(1)).alias("hits"))
    return method_info_classes(changed_method).join(counted, "class_fqn", "left").select("class_fqn", F.coalesce("hits", F.lit(0)).alias("hits"))


def zero_hit_classes(hits: DataFrame, changed_method: DataFrame) -> DataFrame:
    """Classes with method information that no test was credited to; their tests are selected by class."""
    return method_info_classes(changed_method).join(hits.select("class_fqn").distinct(), "class_fqn", "left_anti")


def covering(cov_class: DataFrame, classes: DataFrame) -> DataFrame:
    """Tests that cover any of the classes."""
    return cov_class.join(classes.select("class_fqn").distinct(), "class_fqn", "left_semi").select("test_name").distinct()


def select_tests(cov_method: DataFrame, cov_class: DataFrame, changed_method: DataFrame, changed_class: DataFrame) -> DataFrame:
    """Selected tests with the strongest way in which they match: METHOD, then CLASS, then ESCALATED.

    The two class-level passes share one scan and one join: classes carry how they count, and a test takes the best.
    """
    hits = first_hits(cov_method, changed_method)
    wanted = class_only(changed_class, changed_method).select("class_fqn", F.lit(1).alias("rank")).unionByName(zero_hit_classes(hits, changed_method).select("class_fqn", F.lit(2).alias("rank")))
    by_class = cov_class.select("test_name", "class_fqn").join(wanted, "class_fqn").select("test_name", "rank")
    best = hits.select("test_name", F.lit(0).alias("rank")).unionByName(by_class).groupBy("test_name").agg(F.min("rank").alias("rank"))
    return best.select("test_name", F.element_at(F.array(F.lit(METHOD), F.lit(CLASS), F.lit(ESCALATED)), F.col("rank") + 1).alias("matched_by"))


def totals(map_test: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts by way of matching and the reduction in percent."""
    every = map_test.select("test_name").distinct().agg(F.count(F.lit(1)).alias("total"))
    kinds = [F.count_if(F.col("matched_by") == k).alias(k.lower()) for k in (METHOD, CLASS, ESCALATED)]
    found = selected.agg(F.count(F.lit(1)).alias("selected"), *kinds)
    return every.crossJoin(found).withColumn("reduction_pct", F.when(F.col("total") > 0, percent(F.col("total") - F.col("selected"), F.col("total"))).otherwise(0.0))


def trigger_match(changed_file: DataFrame, triggers: list[str]) -> DataFrame:
    """The first pattern, in their order, that a changed path matches, with its smallest path; no row if none does."""
    hit = F.coalesce(*(F.when(F.col("path").rlike(glob_regex(t)), F.lit(i)) for i, t in enumerate(triggers)), F.lit(len(triggers))) if triggers else F.lit(0)
    rows = changed_file.where("path is not null").select("path", hit.alias("at")).where(F.col("at") < len(triggers))
    pattern = F.element_at(F.array(*map(F.lit, triggers)), F.col("x.at") + 1) if triggers else F.lit("")
    return rows.agg(F.min(F.struct("at", "path")).alias("x")).where("x is not null").select("x.path", pattern.alias("pattern"))


def runnable(selected: DataFrame, unmapped: DataFrame) -> DataFrame:
    """U4: everything that has to run."""
    return selected.select(F.col("test_name").alias("name")).union(unmapped.select(F.col("class_fqn").alias("name"))).distinct()


def nearest_map(candidates: DataFrame, prefer: str = "NEAREST") -> DataFrame:
    """One map of (project, slot, distance): the preferred slot where it exists; by distance otherwise, unknown being farthest and remote winning ties."""
    own = F.col("slot").eqNullSafe(F.lit(prefer.lower())) if prefer in ("REMOTE", "LOCAL") else F.lit(True)
    key = F.struct((~own).cast("int").alias("other"), F.coalesce("distance", F.lit(2147483647)).alias("far"), (F.col("slot") != "remote").cast("int").alias("late"), "slot")
    return candidates.groupBy("project").agg(F.min(key).alias("k")).select("project", "k.slot", F.col("k.far").alias("distance"))


def prefer_mode(text: str | None) -> str:
    """a preference's name; anything unknown is NEAREST."""
    return text.strip().upper() if text and text.strip().upper() in ("REMOTE", "LOCAL") else "NEAREST"


# The reasons that are shown.
NO_MAP, NO_METADATA, NO_COMMIT = "Coverage map not found", "Coverage map or metadata missing", "No commitId in coverage map metadata"
TRIGGERED, NO_CHANGES = "Changed file matches fullSuiteTrigger pattern", "No production code changes detected"
NO_TESTS, SELECTED = "Coverage map has no test mappings", "Selected by coverage"


def status_of(metadata: dict | None, valid_commit: bool, distance: int, trigger: str | None, changes: bool, most: int = MAX_COMMIT_DISTANCE) -> tuple[str, str]:
    """Status and reason for one map, from scalars. A map that could not be read has no metadata."""
    if metadata is None:
        return "FULL_SUITE", NO_METADATA
    commit = metadata.get("commit_id")
    if not commit:
        return "FULL_SUITE", NO_COMMIT
    if not valid_commit:
        return "FULL_SUITE", f"commitId {commit} is not a valid git commit (rebase/force push?)"
    if distance > most:
        return "FULL_SUITE", f"Commit distance {distance} exceeds max {most} — mapping is too stale"
    if trigger:
        return "FULL_SUITE", f"{TRIGGERED}: {trigger}"
    return ("SELECTED", "") if changes else ("NONE", NO_CHANGES)


def ladder(state: DataFrame, most: int = MAX_COMMIT_DISTANCE) -> DataFrame:
    """D1, D2 over many maps at once: rows of (map_id, found, readable, commit_id, valid, distance, triggered, changes, tests) with their status."""
    full: list[tuple[Column, str]] = [
        (~F.col("found"), NO_MAP),
        (~F.col("readable"), NO_METADATA),
        (F.coalesce(F.col("commit_id"), F.lit("")) == "", NO_COMMIT),
        (~F.col("valid"), "commitId is not a valid git commit"),
        (F.col("distance") > most, "Commit distance exceeds max"),
        (F.col("triggered"), TRIGGERED),
    ]
    status, reason = F, F
    for condition, text in full:
        status, reason = status.when(condition, "FULL_SUITE"), reason.when(condition, text)
    none, empty = F.col("changes") == 0, F.col("tests") == 0
    status = status.when(none, "NONE").when(empty, "FULL_SUITE").otherwise("SELECTED")
    reason = reason.when(none, NO_CHANGES).when(empty, NO_TESTS).otherwise(SELECTED)
    return state.select("map_id", status.alias("status"), reason.alias("reason"))


# Fixed values of the include files.
DEFAULT_PATTERNS, SENTINEL = ("**/*Test.java", "**/*Tests.java", "**/*TestCase.java"), "__no_tests_to_run__"


def filter_lines(status: str | None, tests: DataFrame, unmapped: DataFrame, patterns: bool = False) -> DataFrame:
    """Distinct include lines for a build tool, from (test_name) and (class_fqn).

    Without a status or for FULL_SUITE the default patterns; else the classes of selected tests (``patterns``: ``Class.method``) and the unmapped classes; one
    sentinel line if nothing is to run.
    """
    spark = tests.sparkSession
    if status not in ("SELECTED", "NONE"):
        return spark.createDataFrame([(x,) for x in (("*",) if patterns else DEFAULT_PATTERNS)], "line string")
    extra = unmapped.select((include_pattern if patterns else include_path)(F.col("class_fqn")).alias("line"))
    if status == "SELECTED":
        own = tests.select((include_pattern if patterns else test_class)(F.col("test_name")).alias("line"))
        return own.unionByName(extra).distinct()
    none = spark.createDataFrame([(SENTINEL,)], "line string").join(extra.limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_anti")
    return extra.distinct().unionByName(none)
