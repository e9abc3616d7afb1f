import gzip
import json

import pytest
from pyspark.sql import functions as F

from testlattice.operators import changes, coverage, discovery, explore, merge, report
from testlattice.session import numbered
from testlattice.sources import maps, reports, sinks

XML = """<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd">
<report name="r"><sessioninfo id="s" start="1" dump="2"/><package name="com/acme"><class name="com/acme/User">
<method name="updateAddress" desc="()V" line="3"><counter type="INSTRUCTION" missed="1" covered="5"/><counter type="LINE" missed="0" covered="1"/></method>
<method name="deleteUser" desc="()V" line="9"><counter type="INSTRUCTION" missed="4" covered="0"/></method><counter type="LINE" missed="2" covered="3"/><counter type="BRANCH" missed="1" covered="1"/></class>
<class name="com/acme/Repo"><method name="save" desc="()V" line="3"><counter type="INSTRUCTION" missed="0" covered="3"/></method><method name="findById" desc="(I)V" line="5"><counter type="INSTRUCTION" missed="0" covered="7"/></method><counter type="LINE" missed="0" covered="0"/></class>
<sourcefile name="User.java"><line nr="3" mi="0" ci="3" mb="0" cb="0"/><line nr="9" mi="5" ci="0" mb="1" cb="1"/></sourcefile></package></report>"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_reports(spark, tmp_path):
    (tmp_path / "session_MyTest#test~Something.xml").write_text(XML)
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "other.txt").write_text("no")
    tree = reports.read_reports(spark, str(tmp_path))
    covered = coverage.covered_methods(tree)
    assert rows(covered.select("test_name", "method_fqn", "covered")) == [("MyTest#testSomething", "com.acme.Repo#findById", 7), ("MyTest#testSomething", "com.acme.Repo#save", 3), ("MyTest#testSomething", "com.acme.User#updateAddress", 5)]
    mapped = coverage.mappings(covered).first()
    assert mapped["classes"] == ["com.acme.Repo", "com.acme.User"] and len(mapped["methods"]) == 3
    counters = coverage.class_counters(tree)
    assert rows(coverage.merge_metrics(counters)) == [("com.acme.User", 2, 3, 1, 1)]
    assert rows(coverage.lines(tree).select("pkg", "sourcefile", "nr", "mi", "ci")) == [("com/acme", "User.java", 3, 0, 3), ("com/acme", "User.java", 9, 5, 0)]
    sinks.write_reports(tree, str(tmp_path / "out"))
    assert spark.read.format("xml").option("rowTag", "report").load(str(tmp_path / "out")).count() == 1


def line_frame(spark, *lines):
    return spark.createDataFrame(lines, "key string, ord int, nr int, mi int, ci int, mb int, cb int")


def test_line_goldens(spark):
    pct = lambda *lines: coverage.line_percent(coverage.merge_lines(line_frame(spark, *lines), "key"), "key").first()["pct"]
    assert pct(("a", 1, 1, 0, 3, 0, 0), ("a", 1, 2, 0, 2, 0, 0), ("a", 1, 3, 5, 0, 0, 0)) == 50.0
    first = ("a", 1, 10, 0, 3, 0, 0), ("a", 2, 10, 3, 0, 0, 0)
    assert pct(*first, ("a", 1, 11, 5, 0, 0, 0), ("a", 2, 11, 0, 4, 0, 0)) == 87.5
    assert pct(*first, ("a", 2, 11, 5, 0, 0, 0), ("a", 1, 11, 0, 4, 0, 0)) == 100.0
    assert coverage.line_percent(coverage.merge_lines(line_frame(spark, ("a", 1, 1, 0, 0, 0, 0)), "key"), "key").isEmpty()


def test_merged_lines_are_the_fold(spark):
    import random

    rng, given, want = random.Random(2), [], {}
    for k in range(200):
        reports_ = [(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 5))]
        mi, ci = reports_[0]
        for a, b in reports_[1:]:
            total = mi + ci
            ci = max(ci, b)
            mi = max(0, total - ci)
        want[str(k)] = (mi, ci)
        given += [(str(k), i, 1, a, b, 0, 0) for i, (a, b) in enumerate(reports_)]
    assert {r["key"]: (r["mi"], r["ci"]) for r in coverage.merge_lines(line_frame(spark, *given), "key").collect()} == want


DOC = {
    "metadata": {"baseBranch": "main", "commitId": "abc", "timestamp": "t"},
    "testMappings": {
        "FooTest#b.c": {"classes": ["p.B", "p.A", "p.FooTest"], "methods": ["p.B#x", "p.FooTest#t", "p.LoneTest#t"]},
        "FooTest#empty": {"classes": [], "methods": []},
        "NullTest#n": {"classes": ["p.A"]},
    },
    "classMetrics": {"p.A": {"lineMissed": 1, "lineCovered": 2, "branchMissed": 3, "branchCovered": 4}},
}


def test_maps_round_trip(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps(DOC, indent=1))
    with gzip.open(tmp_path / "map.json.gz", "wt") as f:
        json.dump(DOC, f)
    want = None
    for p in (path, tmp_path / "map.json.gz"):
        t = maps.tables(maps.read_map(spark, str(p)))
        assert rows(t["cov_class"].select("test_name", "pos", "class_fqn")) == [("FooTest#b.c", 0, "p.B"), ("FooTest#b.c", 1, "p.A"), ("NullTest#n", 0, "p.A")]
        assert rows(t["cov_method"].select("method_fqn")) == [("p.B#x",), ("p.LoneTest#t",)]
        assert t["map_test"].count() == 3 and rows(t["class_metrics"].drop("map_id")) == [("p.A", 1, 2, 3, 4)]
        want = want or {k: rows(v) for k, v in t.items()}
        assert {k: rows(v) for k, v in t.items()} == want
    assert rows(maps.read_metadata(spark, str(path))) == [("main", "abc", "t")]
    for gz in (False, True):
        for name, write in (("plain", sinks.write_plain_map), ("indexed", sinks.write_indexed_map)):
            write(t, str(tmp_path / f"{name}{gz}"), gz)
            back = maps.tables(maps.read_map(spark, str(tmp_path / f"{name}{gz}")))
            for k in ("map_meta", "map_test", "class_metrics"):
                assert rows(back[k]) == want[k]
            assert rows(back["cov_class"].select("test_name", "class_fqn")) == rows(t["cov_class"].select("test_name", "class_fqn"))
    assert maps.is_indexed(spark, str(tmp_path / "indexedTrue")) and not maps.is_indexed(spark, str(path))
    both = maps.read_modules(spark, {"m1": str(path), "m2": str(path)})
    assert both["map_test"].groupBy("map_id").count().count() == 2


def test_indexed_map_with_a_wrong_id(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"classIndex": ["A"], "methodIndex": [], "testMappings": {"T": {"classes": [3], "methods": []}}}))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        maps.read_map(spark, str(tmp_path / "bad.json")).collect()


def source(*lines):
    return "/* licence\n * @Disabled */\npackage p;\n" + "\n".join(lines)


def test_source_reasons(spark):
    cases = {
        source("@Disabled", "public class A { @Test void a() {} }"): discovery.DISABLED,
        source('@Ignore("x")', "public class A { @Test void a() {} }"): discovery.DISABLED,
        source("@IgnoreReason", "public class A {", "@Test void a() {} }"): None,
        source("@RunWith(Enclosed.class)", "public class A {"): discovery.ENCLOSED,
        source("final class A {", "@Test void a() {} }"): discovery.PACKAGE_PRIVATE,
        source("public class A { String e = System.getenv(\"E\"); @Test void a() {} }"): discovery.CONDITIONAL,
        source("public class A {", "@ArchTest", "static x y; }"): discovery.ARCH,
        source("public class A { }"): discovery.NO_TESTS,
        source("public class A { @ParameterizedTest void a() {} }"): None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string").orderBy("i")
    assert [r[0] for r in df.select(discovery.source_reason(F.col("text"))).collect()] == list(cases.values())
    kinds = {source("public abstract class A {"): True, source("@X", "public interface I {"): True, source("public @interface J {"): True, source("public class C {", "  interface D {"): False, source("public enum E {"): False, "": False, None: False}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(kinds)], "i int, text string").orderBy("i")
    assert [r[0] for r in df.select(discovery.not_instantiable(F.col("text"))).collect()] == list(kinds.values())


def test_unmapped(spark):
    files = spark.createDataFrame([("com/example/NewTest.class",), ("com/example/ExistingTest.class",), ("com/example/New$InnerTest.class",), ("com/example/AddedTest.class",), ("com/example/BaseTest.class",), ("com/example/Helper.class",)], "rel_path string")
    tests = spark.createDataFrame([("ExistingTest#a",)], "test_name string")
    changed = spark.createDataFrame([("com.example.AddedTest", "A"), ("x.ExistingTest", "M"), ("y.ExistingTest", "D")], "test_fqn string, status string")
    text = spark.createDataFrame([("com.example.BaseTest", "public abstract class BaseTest {")], "class_fqn string, text string")
    assert rows(discovery.unmapped(files, tests, changed, text)) == sorted([("com.example.NewTest", discovery.UNKNOWN), ("com.example.AddedTest", discovery.NEW), ("x.ExistingTest", discovery.MODIFIED_KNOWN), ("y.ExistingTest", discovery.MODIFIED_KNOWN)])
    assert rows(discovery.new_tests(files, tests, any_class=True)) == sorted([("com.example.NewTest",), ("com.example.AddedTest",), ("com.example.BaseTest",), ("com.example.Helper",)])


def test_patches(spark):
    text = "diff --git a/src/main/java/p/A.java b/src/main/java/p/A.java\n@@ -1 +1 @@ void f() {\n@@ -2 +2 @@ public class A {\ndiff --git a/README.md b/README.md\n@@ -1 +1 @@ void lost() {\ndiff --git a/src/main/java/p/B.java b/src/main/java/p/B.java\n@@ -1 +1 @@ private int g(int x)"
    lines = reports.change_lines(spark, text, "committed").withColumnRenamed("origin", "patch_id")
    assert rows(changes.changed_methods(lines)) == [("p.A#f",), ("p.B#g",)]


def test_merging(spark):
    base = spark.createDataFrame([("A#1", "A", 1), ("B#1", "B", 1), ("A#old", "A", 1)], "test_name string, test_class string, v int")
    new = spark.createDataFrame([("A#1", "A", 2)], "test_name string, test_class string, v int")
    assert rows(merge.replace_test_classes(base, new)) == rows(spark.createDataFrame([("A", "x"), ("B", "y")], "a string, b string").limit(0)) + sorted([tuple(r) for r in merge.replace_test_classes(base, new).collect()], key=repr)
    assert {(r["test_name"], r["v"]) for r in merge.replace_test_classes(base, new).collect()} == {("A#1", 2), ("B#1", 1)}
    versions = spark.createDataFrame([("A#1", 1, None), ("A#1", 2, "x"), ("A#1", 3, None)], "test_name string, file_ord int, v string")
    assert rows(merge.last_wins(versions)) == [("A#1", None)]
    metric = spark.createDataFrame([("m", "PASSED", 5), ("m", "FAILED", -1), ("m", "ODD", 2)], "module string, status string, duration_ms long")
    assert rows(merge.run_summary(metric, "module").select("total", "passed", "failed", "skipped", "duration_ms")) == [(3, 1, 1, 1, 6)]
    selected, unmapped = spark.createDataFrame([("A#1",)], "test_name string"), spark.createDataFrame([("p.A",), ("p.B",), ("p.C",)], "class_fqn string")
    tests, left = merge.enrich(selected, unmapped, base)
    assert rows(tests) == [("A#1",), ("A#old",), ("B#1",)] and rows(left) == [("p.C",)]


def test_chunks_pages_and_search(spark):
    tests = spark.createDataFrame([(f"T#{i:03}",) for i in range(120)], "test_name string")
    chunks = report.chunked(tests)
    assert rows(chunks.groupBy("chunk").count()) == [(0, 50), (1, 50), (2, 20)]
    assert report.page(chunks, 9).count() == 20 and report.page(chunks, -1).count() == 50
    cov_class = spark.createDataFrame([("T#000", 0, "a.b.FooService"), ("T#000", 1, "c.Bar")], "test_name string, pos int, class_fqn string")
    cov_method = spark.createDataFrame([("T#000", 0, "a.b.FooService#go")], "test_name string, pos int, method_fqn string")
    index = report.search_index(report.chunk_rows(tests, cov_class, cov_method, tests.limit(0), pcts=spark.createDataFrame([("c.Bar", 5.0)], "class_fqn string, pct double")))
    first = index.where("t = 'T#000'").first()
    assert (first["c"], first["m"], first["cc"], first["s"]) == ("FooService Bar", "go", 2, False)
    assert explore.section_search(index, "foo").count() == 1 and explore.section_search(index, "foo", tests=True).isEmpty()
    assert [r["row"] for r in numbered(tests.orderBy(F.desc("test_name")), "test_name").orderBy("test_name").collect()] == list(range(120))


def test_report_tables(spark):
    cov = spark.createDataFrame([("T#1", 0, "A"), ("T#2", 0, "B"), ("T#2", 1, "A"), ("U#1", 0, "C")], "test_name string, pos int, class_fqn string")
    tests, selected = cov.select("test_name").distinct(), spark.createDataFrame([("T#1",)], "test_name string")
    expanded = report.class_expansion(tests, selected)
    assert rows(expanded) == [("T#1", "T", "selected"), ("T#2", "T", "added")]
    assert rows(report.closure(cov, selected)) == [("T#2", "A")]
    classes, methods = spark.createDataFrame([("A",), ("Z",)], "class_fqn string"), spark.createDataFrame([("B#x",), ("B#a",)], "method_fqn string")
    assert rows(report.changed_code(classes, methods)) == [("A", []), ("B", ["a", "x"]), ("Z", [])]
    counts = report.covering_counts(cov, report.relevant_classes(classes, methods))
    assert [tuple(r) for r in report.top_classes(counts).collect()] == [("A", 2), ("B", 1), ("Z", 0)]
    assert report.ant_string(spark.createDataFrame([("C#m2",), ("C#m1",), ("D#x",)], "test_name string"), spark.createDataFrame([("p.N",)], "class_fqn string")).first()["line"] == "C#m1+m2,D#x,p.N"
    stats = explore.statistics(tests, cov, spark.createDataFrame([("T#1", "A#x")], "test_name string, method_fqn string")).first()
    assert tuple(stats) == (3, 3, 1, 1, 2, "1.3")
    assert explore.statistics(tests.limit(0), cov.limit(0), spark.createDataFrame([], "test_name string, method_fqn string")).first()["min_classes"] is None


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "classes/a/b").mkdir(parents=True)
    (tmp_path / "classes/a/b/X+Test.class").write_bytes(b"\xca\xfe")
    (tmp_path / "classes/a/b/Y.java").write_text("one\ntwo")
    assert rows(reports.class_files(spark, str(tmp_path / "classes")).select("rel_path")) == [("a/b/X+Test.class",)]
    assert rows(reports.source_files(spark, str(tmp_path / "classes")).select("rel_path", "text")) == [("a/b/Y.java", "one\ntwo")]
    folders = spark.createDataFrame([("${PLATFORM_BIN_DIR}/ext", "core"), ("/abs", None)], "path string, name string")
    assert rows(reports.platform_folders(folders, "/bin")) == [("/abs",), ("/bin/ext/core",)]
    (tmp_path / "m.json").write_text(json.dumps({"tests": [{"name": "T#a", "status": "PASSED", "durationMs": 3}]}))
    assert rows(reports.read_metrics(spark, {"mod": str(tmp_path / "m.json")}).select("module", "name", "duration_ms", "failure_type")) == [("mod", "T#a", 3, None)]
    picked = spark.createDataFrame([("SELECTED", "r", ["T#a"], {"p.N": "new"}, ["p.A"])], "status string, reason string, selectedTests array<string>, unmappedTests map<string,string>, changedClasses array<string>")
    for form in ("json", "txt", "other"):
        sinks.write_selection(picked, str(tmp_path / form), form)
    assert rows(spark.read.text(str(tmp_path / "txt"))) == [("T#a",), ("p.N",)]
    assert rows(reports.read_selection(spark, str(tmp_path / "json"))) == rows(reports.read_selection(spark, str(tmp_path / "other"))) == rows(picked)
    chunk = report.chunk_rows(spark.createDataFrame([("T#a",)], "test_name string"), *(spark.createDataFrame([], f"test_name string, pos int, {c} string") for c in ("class_fqn", "method_fqn")), spark.createDataFrame([("T#a",)], "test_name string"))
    sinks.write_chunks(chunk, str(tmp_path / "chunks"))
    assert spark.read.json(str(tmp_path / "chunks/chunks")).count() == 1


def test_live_metrics(spark, tmp_path):
    from testlattice.streaming.metrics import live_metrics

    schema = "class_fqn string, line_missed int, line_covered int, branch_missed int, branch_covered int"
    spark.createDataFrame([("A", 5, 1, 0, 0), ("A", 3, 2, 1, 1), ("B", 0, 0, 0, 0)], schema).write.parquet(str(tmp_path / "in"))
    stream = live_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert rows(spark.table("live")) == [("A", 3, 2, 0, 1)]


def test_stale_artifacts_contain_the_name(spark):
    names = ["TEST-Order_IT-a.xml", "MyFooTest.xml", "FooTest2.xml", "session_FooTest#a.exec", "Order-IT.xml", "fooTest.xml", "x", "", None, "a.Outer$InnerTest.xml", "TEST-com.acme.NewSpecs.xml"]
    files = spark.createDataFrame([(x,) for x in names], "file_name string")
    classes = ["Order_IT", "FooTest", "Outer$InnerTest", "AVeryLongNameOfATestClassThatNoFileHas", None]
    tests = spark.createDataFrame([(x,) for x in classes], "test_class string")
    unmapped = spark.createDataFrame([("com.acme.NewSpec",), ("Order",)], "class_fqn string")
    want = lambda known: sorted(f for f in names if f is not None and any(c in f for c in known))
    assert [x for x, in rows(merge.stale_artifacts(files, tests))] == want(classes[:-1])
    assert [x for x, in rows(merge.stale_artifacts(files, tests, unmapped))] == want([*classes[:-1], "NewSpec", "Order"])
    assert merge.stale_artifacts(files, tests.limit(0)).isEmpty()


def test_metrics_document_and_change_scans(spark, tmp_path):
    metric = spark.createDataFrame([("m", "T#a", "PASSED", 3, None, None), ("m", "T#b", "FAILED", 4, "X", "no")], "module string, name string, status string, duration_ms long, failure_type string, failure_message string")
    sinks.write_metrics(metric, str(tmp_path / "m.json"), "run", "abc", "main", "ci", "now")
    one = spark.read.json(str(tmp_path / "m.json")).first()
    assert (one["runId"], one["branch"], one["summary"]["total"], one["summary"]["failed"], one["summary"]["durationMs"]) == ("run", "main", 2, 1, 7)
    assert rows(reports.read_metrics(spark, {"m": str(tmp_path / "m.json")}).select("name", "failure_type")) == [("T#a", None), ("T#b", "X")]
    for origin in ("committed", "worktree"):
        for scan in ("names", "statuses", "patch"):
            (tmp_path / f"{origin}.{scan}").write_text(f"{scan} of {origin}\n\nlast\n")
    scans = reports.change_scans(spark, str(tmp_path))
    assert rows(scans["patch"]) == [("committed", 0, "patch of committed"), ("committed", 2, "last"), ("worktree", 0, "patch of worktree"), ("worktree", 2, "last")]


def test_extensions_and_report_mode(spark, tmp_path):
    (tmp_path / "extensions.xml").write_text('<config><extensions><path dir="${PLATFORM_BIN_DIR}/custom"/><extension name="core"/><extension dir="/abs/e"/></extensions></config>')
    assert rows(reports.extensions(spark, str(tmp_path / "extensions.xml"), "/bin")) == [("/abs/e",), ("/bin/custom",), ("/bin/ext/core",)]
    assert rows(report.report_mode(spark.range(50))) == [(50, "inline")] and rows(report.report_mode(spark.range(51))) == [(51, "chunked")]


def test_live_summary(spark, tmp_path):
    from testlattice.streaming.metrics import live_summary

    schema = "name string, status string, duration_ms long, ts timestamp"
    spark.sql("SELECT 'a' AS name, 'PASSED' AS status, 2L AS duration_ms, timestamp'2024-01-01 10:05:00' AS ts UNION ALL SELECT 'b', 'OTHER', 3L, timestamp'2024-01-01 10:50:00'").write.parquet(str(tmp_path / "in"))
    stream = live_summary(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("complete").format("memory").queryName("live_summary").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("live_summary").first()
    assert (got["total"], got["passed"], got["skipped"], got["duration_ms"]) == (2, 1, 1, 5)
