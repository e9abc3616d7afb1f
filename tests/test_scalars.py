import pytest
from pyspark.sql import functions as F

from testlattice.functions import scalars as sf
from testlattice.functions.glob import glob_regex


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(*columns).collect()]


def one(spark, rows, column):
    return [r[0] for r in values(spark, rows, column)]


def test_paths(spark):
    paths = ["src/main/java/org/example/Foo.java", "src/test/java/org/example/FooTest.java", "README.md", "modules/myext/src/com/example/MyService.java", "ext/core/testsrc/com/example/FooTest.java", "src/com/x/Y.java", "m/src/One.java", "m/src/integrationTest/java/p/Y.java", None]
    assert one(spark, paths, sf.path_to_fqn(F.col("x"))) == ["org.example.Foo", None, None, "com.example.MyService", None, None, None, "integrationTest.java.p.Y", None]
    assert one(spark, paths, sf.test_path_to_fqn(F.col("x")))[1] == "org.example.FooTest"


def test_method_names(spark):
    assert one(spark, ["public String getName() {", "private int process(List<String> items) {", "public class Foo {", "", None], sf.method_name(F.col("x"))) == ["getName", "process", None, None, None]
    assert one(spark, ["@@ -1,2 +1,3 @@ void a() {", "@@ -1 +1 @@", "plain"], sf.hunk_context(F.col("x"))) == ["void a() {", "", ""]
    assert one(spark, ["diff --git a/x b/src/main/java/A.java", "diff"], sf.diff_target(F.col("x"))) == ["src/main/java/A.java", None]
    status, path = sf.name_status(F.col("x"))
    assert values(spark, ["A\ta.java", "R100\told\tnew", "", "M"], status, path) == [("A", "a.java"), ("R", "new"), (None, None), (None, None)]


def test_test_classes(spark):
    yes = ["a.FooTest", "a.FooTests", "a.FooIT", "a.FooTestCase", "a.TestDefaultAdapter", "a.FooTest$1", "a.test.Helper", "a.testframework.X", "a.EDIT"]
    no = ["a.FooService", "a.Contest", "a.Latest", "a.Attestation", "", None, "test.Helper"]
    assert one(spark, yes, sf.is_test_class(F.col("x"))) == [True] * len(yes)
    assert one(spark, no, sf.is_test_class(F.col("x"))) == [False] * len(no)
    assert one(spark, ["FooTestCase", "TestX", "FooIT"], sf.looks_like_test(F.col("x"))) == [False, False, True]


def test_file_names_and_sessions(spark):
    names = ["MyTest#testBoolean", "MyTest#x", "NoHash", "A#é~"]
    escaped = sf.escape_file_name(F.col("x"))
    assert one(spark, names, escaped)[:3] == ["MyTest#test~Boolean", "MyTest#x", "NoHash"]
    assert one(spark, names, sf.unescape_file_name(escaped)) == names
    assert one(spark, ["session_MyTest%23test~Boolean.xml", "A%23b+c.xml", "Plain.xml"], sf.test_of_file(F.col("x"))) == ["MyTest#testBoolean", "A#b+c", "Plain"]
    got = one(spark, ["testSomething"], sf.session_id(F.lit("FooTest"), F.col("x"), F.lit("com.example.FooTest")))
    assert got == ["FooTest#testSomething_58e7d7e"]


def test_names_and_text(spark):
    assert values(spark, ["a.b.C#m"], sf.class_of_method(F.col("x")), *sf.test_parts(F.col("x")), sf.source_key(F.lit("a.b.C"))) == [("a.b.C", "a.b.", "C", "m", "a/b/C.java")]
    assert one(spark, ["#m", "m", None], sf.class_of_method(F.col("x"))) == [None, None, None]
    assert values(spark, ['<a & "b">'], sf.html_escape(F.col("x")), sf.shortened(F.col("x"), 3, "...")) == [("&lt;a &amp; &quot;b&quot;&gt;", "<a ...")]
    assert one(spark, ["x.AssertionError", "org.junit.TestTimedOutException", "x.IOException", None], sf.failure_type(F.col("x"))) == ["ASSERTION", "TIMEOUT", "EXCEPTION", None]
    assert one(spark, ["75.0", "75.1", "49.9", "50"], sf.colour(F.col("x").cast("double"))) == ["yellow", "green", "red", "yellow"]
    assert one(spark, ["abcdefghij", "abc", None], sf.short_commit(F.col("x"))) == ["abcdefg", "abc", "unknown"]
    assert one(spark, ["A#b", "A"], sf.include_pattern(F.col("x"))) == ["A.b", "A.*"]
    assert one(spark, ["42 tests selected out of 99 total"], sf.pruned_reason(F.col("x"), F.lit(40), F.lit(2))) == ["40 tests selected out of 99 total (2 removed: no longer in source)"]
    assert [sf.context(e) for e in ({}, {"CI": "1"}, {"JENKINS_URL": "u", "CHANGE_ID": "3"})] == ["local", "ci-main", "ci-pr"]


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*.gradle", ["build.gradle"], ["a/build.gradle"]),
        ("**/*.xml", ["a/b.xml", "a/b/c.xml"], ["b.xml", "a/b.xmlx"]),
        ("a?c/{x,y*}.[jk]s", ["abc/x.js", "abc/yy.ks"], ["a/c/x.js", "abc/z.js", "abc/x.ls"]),
        ("[!a]b", ["cb"], ["ab", "/b"]),
        ("a.b+(c)", ["a.b+(c)"], ["axb+(c)"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    hit = F.col("x").rlike(glob_regex(pattern))
    assert one(spark, yes, hit) == [True] * len(yes) and one(spark, no, hit) == [False] * len(no)
