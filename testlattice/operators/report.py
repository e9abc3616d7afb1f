"""The tables behind a coverage report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sf
from ..model import CHUNK_TESTS, INLINE_CAP, LIST_CAP, TOP_CLASSES
from ..session import numbered, pinned

# The reasons that are shown.
COVERS_METHOD, COVERS_CLASS, UNTOLD = "covers changed method ", "covers changed class ", "Selected by coverage match"

LIST_BLOCK = 10_000
#: Characters of a search field; a name takes one at least, its blank, so no more names can show than so many and one, or LIST_CAP.
SEARCH_CAP = 500
SHOWN = max(LIST_CAP, SEARCH_CAP + 1)


def class_expansion(map_test: DataFrame, selected: DataFrame) -> DataFrame:
    """All tests of the classes of selected tests, with ``kind`` selected or added."""
    own = map_test.select("test_name").distinct().withColumn("test_class", sf.test_class(F.col("test_name"))).where(F.instr("test_name", "#") > 1)
    chosen = selected.select("test_name").distinct()
    classes = chosen.where(F.instr("test_name", "#") > 1).select(sf.test_class(F.col("test_name")).alias("test_class")).distinct()
    return own.join(classes, "test_class", "left_semi").join(chosen.withColumn("s", F.lit(True)), "test_name", "left").select("test_name", "test_class", F.when(F.col("s"), "selected").otherwise("added").alias("kind"))


def expansion_totals(expanded: DataFrame) -> DataFrame:
    """Methods selected and executed of each test class."""
    return expanded.groupBy("test_class").agg(F.count_if(F.col("kind") == "selected").alias("selected"), F.count(F.lit(1)).alias("executed"))


def cards(map_test: DataFrame, expanded: DataFrame, changed_class: DataFrame, changed_method: DataFrame) -> DataFrame:
    """One row of totals."""
    total = map_test.select("test_name").distinct().agg(F.count(F.lit(1)).alias("total"))
    run = expanded.agg(F.count_if(F.col("kind") == "selected").alias("selected"), F.count_if(F.col("kind") == "added").alias("added"))
    classes, methods = (df.distinct().agg(F.count(F.lit(1)).alias(n)) for df, n in ((changed_class.select("class_fqn"), "changed_classes"), (changed_method.select("method_fqn"), "changed_methods")))
    skipped = F.col("total") - F.col("selected") - F.col("added")
    return total.crossJoin(run).crossJoin(classes).crossJoin(methods).select("total", "selected", "added", skipped.alias("skipped"), sf.whole_number(sf.percent(skipped, F.col("total"))).alias("reduction"), "changed_classes", "changed_methods")


def histogram(pcts: DataFrame) -> DataFrame:
    """Classes with 0, under 50, 50 to under 75, and at least 75 percent of lines."""
    p = F.col("line_pct")
    return pcts.agg(F.count_if(p == 0).alias("none"), F.count_if((p > 0) & (p < 50)).alias("low"), F.count_if((p >= 50) & (p < 75)).alias("middle"), F.count_if(p >= 75).alias("good"))


def metrics_filter(pcts: DataFrame, which: str = "all") -> DataFrame:
    """All, none (0 %), low (under 50 %) or good (at least 75 %)."""
    p = F.col("line_pct")
    return pcts.where({"all": F.lit(True), "none": p == 0, "low": p < 50, "good": p >= 75}[which])


def worst_first(pcts: DataFrame) -> DataFrame:
    """Classes by line percentage; equal ones by name."""
    return pcts.withColumn("colour", sf.colour(F.col("line_pct"))).orderBy("line_pct", "class_fqn")


def relevant_classes(changed_class: DataFrame, changed_method: DataFrame) -> DataFrame:
    """Changed classes and classes of changed methods."""
    return changed_class.select("class_fqn").union(changed_method.select(sf.class_of_method(F.col("method_fqn")))).where("class_fqn is not null").distinct()


def covering_counts(cov_class: DataFrame, relevant: DataFrame) -> DataFrame:
    """How many tests cover each relevant class, 0 included."""
    counts = cov_class.join(relevant, "class_fqn", "left_semi").groupBy("class_fqn").agg(F.count_distinct("test_name").alias("tests"))
    return relevant.join(counts, "class_fqn", "left").select("class_fqn", F.coalesce("tests", F.lit(0)).alias("tests"))


def top_classes(counts: DataFrame, most: int = TOP_CLASSES) -> DataFrame:
    """Most covered first; equal ones by name."""
    return counts.orderBy(F.desc("tests"), "class_fqn").limit(most)


def changed_code(changed_class: DataFrame, changed_method: DataFrame) -> DataFrame:
    """Changed methods of each relevant class, sorted; none for a class without."""
    own = changed_method.select(sf.class_of_method(F.col("method_fqn")).alias("class_fqn"), F.substring_index("method_fqn", "#", -1).alias("m")).where("class_fqn is not null").distinct()
    lists = own.groupBy("class_fqn").agg(F.sort_array(F.collect_list("m")).alias("methods"))
    return relevant_classes(changed_class, changed_method).join(lists, "class_fqn", "left").select("class_fqn", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def matrix(cov: DataFrame, selected: DataFrame) -> DataFrame:
    """Coverage rows of selected tests."""
    return cov.join(selected.select("test_name").distinct(), "test_name", "left_semi")


def closure(cov_class: DataFrame, selected: DataFrame) -> DataFrame:
    """Other tests that cover a class of a selected test, each credited to the first such class of its own list.

    Classes are made distinct before the second hop, so a class that nearly all tests cover costs a row for each test and no more.
    """
    chosen = selected.select("test_name").distinct()
    classes = matrix(cov_class, chosen).select("class_fqn").distinct()
    extra = cov_class.join(chosen, "test_name", "left_anti").join(classes, "class_fqn", "left_semi")
    return extra.groupBy("test_name").agg(F.min(F.struct("pos", "class_fqn")).alias("x")).select("test_name", "x.class_fqn")


def class_tests(cov_class: DataFrame) -> DataFrame:
    """Tests of each class, sorted."""
    return cov_class.groupBy("class_fqn").agg(F.sort_array(F.collect_set("test_name")).alias("tests"))


def source_lines(lines: DataFrame, merged: DataFrame) -> DataFrame:
    """Source lines (key, nr, text) with hit / missed / none and branches full / partial / missed / none."""
    joined = lines.join(merged, ["key", "nr"], "left")
    hit = F.when(F.col("ci") > 0, "hit").when(F.col("mi") > 0, "missed").otherwise("none")
    branches = F.when(F.coalesce(F.col("cb") + F.col("mb"), F.lit(0)) == 0, "none").when(F.col("mb") == 0, "full").when(F.col("cb") == 0, "missed").otherwise("partial")
    return joined.select("key", "nr", "text", hit.alias("hit"), branches.alias("branches"))


def split_source(source: DataFrame) -> DataFrame:
    """Numbered lines of (key, text)."""
    return source.select("key", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("key", (F.col("at") + 1).alias("nr"), "text")


def reasons(cov_method: DataFrame, cov_class: DataFrame, changed_method: DataFrame, changed_class: DataFrame, selected: DataFrame) -> DataFrame:
    """Why each selected test was selected: matching methods in the order of its list, then classes without method information."""
    chosen = selected.select("test_name").distinct()
    told = _told(cov_method, cov_class, changed_method, changed_class).join(chosen, "test_name", "left_semi").groupBy("test_name").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "t"))).alias("x"))
    return chosen.join(told, "test_name", "left").select("test_name", F.coalesce(F.array_join("x.t", "; "), F.lit(UNTOLD)).alias("reason"))


def _told(cov_method: DataFrame, cov_class: DataFrame, changed_method: DataFrame, changed_class: DataFrame) -> DataFrame:
    """(test_name, k, pos, t): each reason of each test, methods (k = 0) before classes."""
    from .selection import class_only

    methods = cov_method.join(changed_method.select("method_fqn").distinct(), "method_fqn", "left_semi").select("test_name", F.lit(0).alias("k"), "pos", F.concat(F.lit(COVERS_METHOD), F.substring_index("method_fqn", "#", -1)).alias("t"))
    classes = cov_class.join(class_only(changed_class, changed_method), "class_fqn", "left_semi").select("test_name", F.lit(1).alias("k"), "pos", F.concat(F.lit(COVERS_CLASS), sf.short_class(F.col("class_fqn"))).alias("t"))
    return methods.unionByName(classes)


def chunked(map_test: DataFrame, size: int = CHUNK_TESTS) -> DataFrame:
    """Sorted tests with their row and chunk."""
    return numbered(map_test.select("test_name").distinct(), "test_name").withColumn("chunk", F.floor(F.col("row") / size).cast("long"))


def page(rows: DataFrame, number: int, size: int = CHUNK_TESTS) -> DataFrame:
    """Rows of a page counted from 0; a page past the end is the last one."""
    last = rows.agg(F.greatest(F.lit(0), F.floor((F.max("row")) / size)).cast("long").alias("last"))
    return rows.crossJoin(last).where(F.floor(F.col("row") / size) == F.least(F.lit(max(0, number)), F.col("last"))).drop("last")


def inline(map_test: DataFrame, most: int = INLINE_CAP) -> DataFrame:
    """The first sorted tests."""
    return map_test.select("test_name").distinct().orderBy("test_name").limit(most)


def chunk_rows(map_test: DataFrame, cov_class: DataFrame, cov_method: DataFrame, selected: DataFrame, pcts: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The rows of chunk files: t, s, cc, mc, classes, methods (cut to LIST_CAP), chunk, and maps ``sl`` and ``cp`` of a test's classes."""

    def lists(cov: DataFrame, column: str, count: str) -> DataFrame:
        # as many names as a row can show; the count is that of all, and both come from rows that lie together
        ranked = cov.select("test_name", "pos", column, F.row_number().over(W.partitionBy("test_name").orderBy("pos", column)).alias("_n"))
        shown = F.array_sort(F.collect_list(F.when(F.col("_n") <= SHOWN, F.struct("pos", column))))
        return ranked.groupBy("test_name").agg(F.transform(shown, lambda x: x[column]).alias(column), F.count(F.lit(1)).cast("int").alias(count))

    out = chunked(map_test).join(lists(cov_class, "class_fqn", "cc"), "test_name", "left").join(lists(cov_method, "method_fqn", "mc"), "test_name", "left").join(selected.select("test_name").distinct().withColumn("s", F.lit(True)), "test_name", "left")
    none = F.array().cast("array<string>")
    c, m = F.coalesce("class_fqn", none), F.coalesce("method_fqn", none)
    shorts = F.array_join(F.transform(m, lambda x: F.substring_index(x, "#", -1)), " ")
    out = out.select(F.col("test_name").alias("t"), F.coalesce("s", F.lit(False)).alias("s"), F.coalesce("cc", F.lit(0)).alias("cc"), F.coalesce("mc", F.lit(0)).alias("mc"), F.slice(c, 1, LIST_CAP).alias("classes"), F.slice(m, 1, LIST_CAP).alias("methods"), sf.shortened(sf.short_names(c), SEARCH_CAP).alias("c"), sf.shortened(shorts, SEARCH_CAP).alias("m"), F.col("chunk").alias("k"))
    for name, extra, value in (("sl", links, "link"), ("cp", pcts, "pct")):
        if extra is not None:
            own = cov_class.select("test_name", "class_fqn").distinct().join(extra, "class_fqn").groupBy(F.col("test_name").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("class_fqn", value))).alias(name))
            out = out.join(own, "t", "left")
    return out


def search_index(rows: DataFrame) -> DataFrame:
    """The index beside the chunks."""
    return rows.select("t", "s", "cc", "mc", "c", "m", "k")


def ant_string(selected: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One line ``Class#m1+m2,Other#m3``, unmapped classes bare at the end; names in order.

    Methods are joined inside their class first; only class rows meet in the last step.
    """
    own = selected.select(sf.test_class(F.col("test_name")).alias("c"), F.when(F.instr("test_name", "#") > 1, F.substring(F.col("test_name"), F.instr("test_name", "#") + 1, F.length("test_name"))).alias("m")).distinct()
    classes = own.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list("m")), "+").alias("ms")).select(F.lit(0).alias("k"), "c", F.when(F.col("ms") != "", F.concat_ws("#", "c", "ms")).otherwise(F.col("c")).alias("t"))
    bare = unmapped.select(F.lit(1).alias("k"), F.col("class_fqn").alias("c"), F.col("class_fqn").alias("t")).distinct()
    return classes.unionByName(bare).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c", "t"))), lambda x: x["t"]), ",").alias("line"))


# ---- lists in blocks: a key has as many rows as its list needs, so no list is ever one array


def blocks(values: DataFrame, key: str, *order: str, value: str, size: int = LIST_BLOCK) -> DataFrame:
    """(key, block, first, values): the values of each key in order, ``size`` to a block; ``first`` is the place of a block's first value in the whole list.

    Rows are numbered over all keys together, in ranges; a key's places count from its own first number, so a key that all rows share is dealt out like any other.
    """
    rows = pinned(numbered(values, key, *order, name="_n"))
    start = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_start"))
    placed = rows.join(start, rows[key].eqNullSafe(F.col("_key"))).withColumn("_at", F.col("_n") - F.col("_start"))
    packed = placed.groupBy(key, F.floor(F.col("_at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("x"))
    return packed.select(key, "block", F.col("x._at")[0].alias("first"), F.col(f"x.{value}").alias("values"))


def class_test_blocks(cov_class: DataFrame, size: int = LIST_BLOCK) -> DataFrame:
    """The sorted tests of each class in blocks, (class_fqn, block, first, values)."""
    return blocks(cov_class.select("class_fqn", "test_name").distinct(), "class_fqn", "test_name", value="test_name", size=size)


def reason_blocks(cov_method: DataFrame, cov_class: DataFrame, changed_method: DataFrame, changed_class: DataFrame, selected: DataFrame, size: int = LIST_BLOCK) -> DataFrame:
    """The reasons of each selected test in their order, in blocks; a test without a match has one block with the one reason."""
    chosen = selected.select("test_name").distinct()
    told = _told(cov_method, cov_class, changed_method, changed_class).join(chosen, "test_name", "left_semi")
    none = chosen.join(told.select("test_name").distinct(), "test_name", "left_anti").select("test_name", F.lit(0).alias("k"), F.lit(0).cast("long").alias("pos"), F.lit(UNTOLD).alias("t"))
    return blocks(told.unionByName(none), "test_name", "k", "pos", "t", value="t", size=size)


def link_blocks(cov_class: DataFrame, extra: DataFrame, value: str, size: int = LIST_BLOCK) -> DataFrame:
    """What ``extra`` (class_fqn, value) has on the classes of each test, in blocks of (class_fqn, value) by class."""
    own = cov_class.select("test_name", "class_fqn").distinct().join(extra.select("class_fqn", value), "class_fqn")
    return blocks(own.select("test_name", "class_fqn", F.struct("class_fqn", value).alias("entry")), "test_name", "class_fqn", value="entry", size=size)


def report_mode(tests: DataFrame) -> DataFrame:
    """One row (tests, mode): chunked where there are more tests than a chunk holds, else inline."""
    return tests.agg(F.count(F.lit(1)).alias("tests")).select("tests", F.when(F.col("tests") > CHUNK_TESTS, "chunked").otherwise("inline").alias("mode"))
