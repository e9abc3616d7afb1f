"""Scalar functions of the coverage domain as Column expressions; none of them is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conventions of source trees, test names and method signatures.
SOURCE_ROOTS = ("src/main/java/", "src/main/groovy/", "src/main/kotlin/")
TEST_ROOT = "src/test/java/"
TEST_SUFFIX = "(Test|Tests|Spec|IT|TestCase)$"
TEST_PACKAGES = (".test.", ".tests.", ".testsrc.", ".testframework.")
SIGNATURE = r"(?:public|private|protected|static|final|abstract|synchronized|native|default|\s)*[\w<>\[\],\s]+\s+(\w+)\s*\("
HUNK = r"^@@\s+[^@]+@@\s*(.*)$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` names it; its text isn't copied into the plan or the generated code either."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _after(path: Column, marker: str) -> Column:
    """What follows the first occurrence of ``marker``."""
    return F.substring(path, F.instr(path, marker) + F.lit(len(marker)), F.length(path))


def _dotted(relative: Column) -> Column:
    return F.replace(F.left(relative, F.length(relative) - 5), F.lit("/"), F.lit("."))


def path_to_fqn(path: Column) -> Column:
    """class name of a production source path, null if it is none."""

    def use(p: Column) -> Column:
        out = F
        for root in SOURCE_ROOTS:
            out = out.when(p.contains(root), _dotted(_after(p, root)))
        rest = _after(p, "/src/")
        other = p.contains("/src/") & rest.contains("/") & ~rest.startswith("test/") & ~rest.startswith("testsrc/")
        return F.when(p.endswith(".java"), out.when(other, _dotted(rest)))

    return once(path, use)


def test_path_to_fqn(path: Column) -> Column:
    """class name of a test source path, null if it is none."""
    return once(path, lambda p: F.when(p.contains(TEST_ROOT) & p.endswith(".java"), _dotted(_after(p, TEST_ROOT))))


def method_name(context: Column) -> Column:
    """the method a signature declares; null if there is none."""
    return F.nullif(F.regexp_extract(context, SIGNATURE, 1), F.lit(""))


def hunk_context(line: Column) -> Column:
    """the text after the second ``@@`` of a hunk header."""
    return F.trim(F.regexp_extract(line, HUNK, 1))


def diff_target(line: Column) -> Column:
    """the path after the last `` b/`` of a ``diff --git`` line."""
    return F.when(F.instr(line, " b/") > 0, F.substring_index(line, " b/", -1))


def name_status(line: Column) -> tuple[Column, Column]:
    """status letter and target path of a name-status line; null where the line has no tab."""
    parts = F.split(F.trim(line), "\t")
    return once(parts, lambda x: F.when(F.size(x) >= 2, F.left(x[0], F.lit(1)))), once(parts, lambda x: F.when(F.size(x) >= 2, F.element_at(x, -1)))


def escape_file_name(test: Column) -> Column:
    """``~`` before every capital of the method part."""
    at = F.instr(test, "#")
    return F.when(at > 0, F.concat(F.left(test, at), F.regexp_replace(F.substring(test, at + 1, F.length(test)), r"(\p{Lu})", "~$1"))).otherwise(test)


def unescape_file_name(name: Column) -> Column:
    """F8: ``~X`` of the method part becomes ``X``; a ``~`` at the end stays."""
    at = F.instr(name, "#")
    return F.when(at > 0, F.concat(F.left(name, at), F.regexp_replace(F.substring(name, at + 1, F.length(name)), "~(.)", "$1"))).otherwise(name)


def test_of_file(file_name: Column) -> Column:
    """test name of a coverage file name (percent-encoded as in Spark's metadata)."""
    raw = F.url_decode(F.replace(file_name, F.lit("+"), F.lit("%2B")))
    bare = F.replace(raw, F.lit(".xml"), F.lit(""))
    return unescape_file_name(F.when(bare.startswith("session_"), F.substring(bare, 9, F.length(bare))).otherwise(bare))


def string_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM as a non-negative 31-bit number, for text of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % F.lit(4294967296)).bitwiseAND(F.lit(2147483647))


def session_id(simple_class: Column, method: Column, class_fqn: Column) -> Column:
    """``Simple#method_h7``."""
    h = F.lower(F.hex(string_hash(F.concat(class_fqn, F.lit("#"), method))))
    return F.concat(simple_class, F.lit("#"), method, F.lit("_"), F.left(F.lpad(h, 7, "0"), F.lit(7)))


def class_of_method(method: Column) -> Column:
    """the class part of a method name; null without one."""
    return F.when(F.instr(method, "#") > 1, F.substring_index(method, "#", 1))


def test_class(test: Column) -> Column:
    """The class part of a test name, or the whole name."""
    return F.substring_index(test, "#", 1)


def short_class(fqn: Column) -> Column:
    """the name after the last dot."""
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    """all before the short name, with its dot."""
    return F.left(fqn, F.length(fqn) - F.length(short_class(fqn)))


def test_parts(test: Column) -> tuple[Column, Column, Column]:
    """package, class and method of a test name."""
    own = test_class(test)
    return package_of(own), short_class(own), F.when(F.instr(test, "#") > 0, F.substring(test, F.instr(test, "#") + 1, F.length(test))).otherwise(F.lit(""))


def to_dots(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))


def to_slashes(fqn: Column) -> Column:
    return F.replace(fqn, F.lit("."), F.lit("/"))


def source_key(fqn: Column) -> Column:
    """``pkg/Simple.java`` of a class."""
    return F.concat(to_slashes(fqn), F.lit(".java"))


def colour(percent: Column) -> Column:
    """green above 75, yellow from 50."""
    return F.when(percent > 75, "green").when(percent >= 50, "yellow").otherwise("red")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where there is no whole."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def one_decimal(value: Column) -> Column:
    """F16."""
    return F.format_string("%.1f", value)


def whole_number(value: Column) -> Column:
    return F.format_string("%.0f", value)


def shortened(text: Column, most: int, mark: str = "") -> Column:
    """text of at most ``most`` characters, with a mark where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def failure_type(class_name: Column) -> Column:
    """kind of a failure, from the name of its class."""
    return F.when(class_name.rlike("AssertionError|AssertionFailedError|ComparisonFailure"), "ASSERTION").when(class_name.rlike("TimeoutException|TestTimedOutException"), "TIMEOUT").when(class_name.isNotNull(), "EXCEPTION")


def metric_status(failed: Column, successful: Column) -> Column:
    """F19."""
    return F.when(failed, "FAILED").when(successful, "PASSED").otherwise("FAILED")


def html_escape(text: Column) -> Column:
    """F21."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def short_commit(commit: Column) -> Column:
    """F24."""
    return F.coalesce(F.left(commit, F.lit(7)), F.lit("unknown"))


def short_names(names: Column) -> Column:
    """last parts of class names, joined by blanks."""
    return F.array_join(F.transform(names, short_class), " ")


def include_path(fqn: Column) -> Column:
    """``a/b/C.java``."""
    return source_key(fqn)


def include_pattern(test: Column) -> Column:
    """``Class.method``, or ``Class.*`` without a method."""
    return F.when(F.instr(test, "#") > 0, F.replace(test, F.lit("#"), F.lit("."))).otherwise(F.concat(test, F.lit(".*")))


def pruned_reason(reason: Column, kept: Column, removed: Column) -> Column:
    """the reason of a selection after tests without source were taken out."""
    rest = F.regexp_replace(reason, r"^\d+ tests selected out of ", "")
    return F.concat(kept.cast("string"), F.lit(" tests selected out of "), rest, F.lit(" ("), removed.cast("string"), F.lit(" removed: no longer in source)"))


def contains_ignoring_case(text: Column, part: str) -> Column:
    """F29."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def is_test_class(fqn: Column) -> Column:
    """Whether a name is that of a test class; false for null."""
    simple = F.substring_index(short_class(fqn), "$", 1)
    named = simple.rlike(TEST_SUFFIX) | simple.startswith("Test")
    for part in TEST_PACKAGES:
        named = named | fqn.contains(part)
    return F.coalesce(named & (fqn != ""), F.lit(False))


def looks_like_test(simple: Column) -> Column:
    """The narrower rule for files on disk."""
    return simple.rlike("(Test|Tests|Spec|IT)$")


def context(environment: dict[str, str]) -> str:
    """where a run took place, from its environment variables."""
    if not environment.keys() & {"CI", "JENKINS_URL"}:
        return "local"
    return "ci-pr" if environment.keys() & {"CHANGE_ID", "GITHUB_PR_NUMBER"} else "ci-main"


def context_of(environment: Column) -> Column:
    """F23 over many runs: where each took place, from a map of its environment variables; a variable counts if it is set, even to nothing. No map is no variables."""
    some = lambda *names: F.coalesce(F.arrays_overlap(F.map_keys(environment), F.array(*map(F.lit, names))), F.lit(False))
    return F.when(~some("CI", "JENKINS_URL"), "local").when(some("CHANGE_ID", "GITHUB_PR_NUMBER"), "ci-pr").otherwise("ci-main")


def prefer_of(text: Column) -> Column:
    """F34 over many settings: a preference's name; anything unknown, or none, is NEAREST."""
    name = F.upper(F.trim(text))
    return F.when(name.isin("REMOTE", "LOCAL"), name).otherwise("NEAREST")


def json_string(text: Column) -> Column:
    """a text as a JSON string, with its quotes; null for null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))
