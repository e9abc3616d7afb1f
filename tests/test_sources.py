"""Stored maps, ingest, many modules in one scan, platform folders, comments in sources."""

import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from testlattice.operators import discovery
from testlattice.sources import documents, maps, paths, reports, sinks, store
from testlattice.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "test_name string, test_class string, payload int"


def test_merge_touches_its_parts_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    base = [(f"T{k % 30}#t{k}", f"T{k % 30}", k) for k in range(200)]
    assert rows(store.read(spark, path, SCHEMA)) == []
    assert store.merge(path, spark.createDataFrame(base, SCHEMA), source="base", batch=3, parts=8)
    _, before = store.Versions(spark, path).last()
    new = [("T4#new", "T4", 1000), ("T5#t5", "T5", 1001)]
    held = store.read(spark, path, SCHEMA)
    assert store.merge(path, spark.createDataFrame(new, SCHEMA), source="module", batch=0)
    number, after = store.Versions(spark, path).last()
    changed = {p for p in after["folders"] if after["folders"][p] != before["folders"].get(p)}
    assert number == 2 and 1 <= len(changed) <= 2 and after["parts"] == 8 and after["batches"] == {"base": 3, "module": 0}
    want = sorted([r for r in base if r[1] not in ("T4", "T5")] + new, key=str)
    assert rows(store.read(spark, path, SCHEMA)) == want
    assert rows(held) == sorted(base, key=str)  # planned before the merge
    assert not store.merge(path, spark.createDataFrame(new, SCHEMA), source="module", batch=0)
    assert store.merge(path, spark.createDataFrame(new, SCHEMA)) and rows(store.read(spark, path, SCHEMA)) == want
    assert store.merge(path, spark.createDataFrame([], SCHEMA)) and rows(store.read(spark, path, SCHEMA)) == want
    with pytest.raises(RuntimeError):
        store.Versions(spark, path).put(2, {})
    assert rows(store.read(spark, path, SCHEMA)) == want and not [x for x in os.listdir(f"{path}/versions") if x.startswith(".") and not x.endswith(".crc")]


def test_merge_by_test_and_counters(spark, tmp_path):
    path = str(tmp_path / "store")
    for part in ([("T#a", "T", 1), ("T#b", "T", 1), (None, None, 5)], [("T#b", "T", 2)]):
        store.merge(path, spark.createDataFrame(part, SCHEMA), how=store.replace_tests)
    assert rows(store.read(spark, path, SCHEMA)) == [("T#a", "T", 1), ("T#b", "T", 2), (None, None, 5)]
    columns = "class_fqn string, line_missed int, line_covered int, branch_missed int, branch_covered int"
    for part in ([("a", 5, 1, 0, 0), ("b", 1, 1, 1, 1)], [("a", 2, 4, 3, 1), ("c", 0, 0, 0, 0)]):
        store.merge(f"{path}-c", spark.createDataFrame(part, columns), key="class_fqn", how=store.merge_counters)
    assert rows(store.read(spark, f"{path}-c", columns)) == [("a", 2, 4, 0, 1), ("b", 1, 1, 1, 1)]


def report(*methods):
    return '<?xml version="1.0"?><report name="x"><package name="p"><class name="p/C">' + "".join(f'<method name="{m}" desc="()V"><counter type="INSTRUCTION" missed="0" covered="{n}"/></method>' for m, n in methods) + "</class></package></report>"


def test_ingest_is_stopped_and_goes_on(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "map"), str(tmp_path / "checkpoint")
    folder.mkdir()
    (folder / "session_A#one.xml").write_text(report(("m", 3), ("n", 0)))
    (folder / "session_A#test~Two.xml").write_text(report(("k", 1)))
    (folder / "empty.xml").write_text("")
    go = lambda n=1: ingest.ingest_reports(spark, str(folder), path, checkpoint, n).awaitTermination()
    go()
    first = [("A#one", "A", "p.C", "p.C#m", 3), ("A#testTwo", "A", "p.C", "p.C#k", 1)]
    assert rows(store.read(spark, path, ingest.COVERED)) == first
    go()
    number, content = store.Versions(spark, path).last()
    (folder / "session_B#b.xml").write_text(report(("m", 9)))
    (folder / "broken.xml").write_text("<report><package name=")
    go(10)
    want = [*first, ("B#b", "B", "p.C", "p.C#m", 9)]
    assert rows(store.read(spark, path, ingest.COVERED)) == want and store.Versions(spark, path).last()[0] == number + 1
    # stopped after the merge, before the checkpoint has it: the batch comes again and is passed over
    commits = sorted((int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit()))
    for x in (str(commits[-1]), f".{commits[-1]}.crc"):
        (tmp_path / "checkpoint" / "commits" / x).unlink(missing_ok=True)
    go(10)
    assert store.Versions(spark, path).last()[0] == number + 1 and rows(store.read(spark, path, ingest.COVERED)) == want
    # a newer report of a test takes the place of its rows, those of its class stay
    (folder / "session_A#one.xml").unlink()
    (folder / "later").mkdir()
    time.sleep(0.01)
    (folder / "A#one.xml").write_text(report(("z", 2)))
    go(10)
    assert rows(store.read(spark, path, ingest.COVERED)) == sorted([("A#one", "A", "p.C", "p.C#z", 2), *want[1:]], key=str)


def test_200_modules_in_one_scan(spark, tmp_path):
    plain = {"metadata": {"commitId": "c"}, "testMappings": {"T#a": {"classes": ["p.A", "p.FooTest"], "methods": ["p.A#m"]}, "T#none": {"classes": [], "methods": []}}, "classMetrics": {"p.A": {"lineMissed": 1, "lineCovered": 2, "branchMissed": 0, "branchCovered": 0}}}
    coded = {"classIndex": ["p.A", "p.FooTest"], "methodIndex": ["p.A#m"], "testMappings": {"T#a": {"classes": [0, 1], "methods": [0]}, "T#none": {"classes": [], "methods": []}}}
    given = {}
    for k in range(200):
        folder = tmp_path / f"m {k}+%41"
        folder.mkdir()
        (folder / "map.json").write_text(json.dumps(coded if k % 2 else plain))
        given[f"mod{k}"] = str(folder / "map.json") if k % 3 else f"file://{folder}/"
    found = maps.read_modules(spark, given)
    assert rows(found["cov_class"].select("map_id", "test_name", "pos", "class_fqn")) == sorted([(f"mod{k}", "T#a", 0, "p.A") for k in range(200)], key=str)
    assert rows(found["map_test"].groupBy("test_name").count()) == [("T#a", 200), ("T#none", 200)] and found["class_metrics"].count() == 100
    plan = found["cov_class"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan json") == 1 and plan.count("Scan binaryFile") == 1
    (tmp_path / "bad.json").write_text(json.dumps(coded | {"testMappings": {"T#a": {"classes": [7], "methods": []}}}))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        maps.read_modules(spark, {"bad": str(tmp_path / "bad.json")})["cov_class"].collect()


def test_metrics_have_the_nearest_module(spark, tmp_path):
    for name in ("a", "a/inner", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps({"tests": [{"name": f"T#{name}", "status": "PASSED", "durationMs": 1}]}))
    given = {"outer": f"{tmp_path}/a/metrics.json", "inner": f"{tmp_path}/a/inner", "b": f"{tmp_path}/b/"}
    assert rows(reports.read_metrics(spark, given).select("module", "name")) == [("b", "T#b"), ("inner", "T#a/inner"), ("outer", "T#a")]
    assert reports.read_metrics(spark, {}).count() == 0


def test_platform_folders(spark, tmp_path):
    home = tmp_path / "bin" / "platform"
    for f in ("platform/ext/core/classes/p/A.class", "platform/ext/core/src/p/A.java", "platform/ext/web/classes/p/A.class", "platform/ext/web/classes/q/B$1.class", "platform/ext/stray.class", "platform/bootstrap/classes/z/Z.class", "platform/bootstrap/src/z/Z.java", "custom/shop/classes/s/S+1.class", "lone/classes/l/L.class", "lone/src/l/L.java", "unnamed/classes/u/U.class"):
        (tmp_path / "bin" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "bin" / f).write_text("text of " + f)
    tail = lambda found: [re.sub(f"^file:/*{str(tmp_path)[1:]}/bin/", "", x) for x in found]
    assert tail(reports.platform_roots(spark, str(home))) == ["platform/ext/core/classes", "platform/ext/web/classes", "platform/bootstrap/classes"]
    (home / "extensions.xml").write_text('<config><extensions><path dir="${PLATFORM_BIN_DIR}/custom" autoload="true"/><path dir="/missing"/><extension name="core"/><extension dir="${PLATFORM_BIN_DIR}/lone"/><extension dir=""/></extensions></config>')
    roots = reports.platform_roots(spark, str(home))
    assert tail(roots) == ["platform/ext/core/classes", "platform/ext/web/classes", "custom/shop/classes", "lone/classes", "platform/bootstrap/classes"]
    assert rows(reports.class_files(spark, *roots).select("ord", "rel_path")) == [(0, "p/A.class"), (1, "p/A.class"), (1, "q/B$1.class"), (2, "s/S+1.class"), (3, "l/L.class"), (4, "z/Z.class")]
    sources = reports.platform_roots(spark, f"{home}/", "src")
    assert tail(sources) == ["platform/ext/core/src", "lone/src"]
    assert rows(reports.source_files(spark, *sources).select("rel_path", "text")) == [("l/L.java", "text of lone/src/l/L.java"), ("p/A.java", "text of platform/ext/core/src/p/A.java")]


def test_plain_paths(spark):
    df = spark.createDataFrame([("file:///a//b/",), ("hdfs://host:80/a/b",), ("/a/b",), ("s3a://bucket/a/b",), ("file:/",)], "p string")
    assert [r[0] for r in df.select(paths.plain(F.col("p"))).collect()] == ["/a/b"] * 4 + ["/"]


def plain_code(text):
    out, inside = [], False
    for raw in re.sub("\r\n?", "\n", text).split("\n"):
        x = raw.strip("".join(map(chr, range(33))))
        if inside:
            inside = "*/" not in x
        elif x.startswith("/*"):
            inside = "*/" not in x
        else:
            out.append(x)
    return out


def plain_reason(text):
    code = plain_code(text)
    if any(x in ("@Disabled", "@Ignore") or x.startswith(("@Disabled(", "@Ignore(")) for x in code):
        return discovery.DISABLED
    if any("Enclosed.class" in x for x in code):
        return discovery.ENCLOSED
    if any(re.match(r"(final\s+)?class\s+\S", x) for x in code):
        return discovery.PACKAGE_PRIVATE
    if "System.getenv(" in text:
        return discovery.CONDITIONAL
    if any("@ArchTest" in x for x in code):
        return discovery.ARCH
    return None if any("@Test" in x or "@ParameterizedTest" in x for x in code) else discovery.NO_TESTS


def plain_abstract(text):
    for x in plain_code(text):
        if not x or x.startswith(("package ", "import ", "//")):
            continue
        if "abstract class " in x or "@interface " in x or re.search(r"\binterface\s+\w+", x):
            return True
        if not x.startswith("@") and (" class " in x or " enum " in x):
            return False
    return False


LINES = ["/*", "*/", "/**", " * x", "/*/", "/* a */ @Disabled", "a /* b", "\t/* c", "@Disabled", "\t@Ignore(\"x\")", "@Ignore(", "@IgnoreReason", "@Test void a()", "class A {", "final  class B", "public class C", "abstract class D", "public @interface E", "  interface F", "package p;", "// class", "@RunWith(Enclosed.class)", "@ArchTest", "x System.getenv(\"y\")", "", " ", "class", "enum G", "*/ class H"]


def test_comments_against_a_state_machine(spark):
    import random

    rng = random.Random(7)
    texts = [rng.choice(["\n", "\r\n", "\r", "\n"]).join(rng.choices(LINES, k=rng.randrange(0, 9))) for _ in range(2500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r for r in df.select("i", discovery.source_reason(F.col("text")).alias("why"), discovery.not_instantiable(F.col("text")).alias("skip"), discovery.code_lines(F.col("text")).alias("code")).collect()}
    for i, t in enumerate(texts):
        assert [x for x in got[i]["code"] if x] == [x for x in plain_code(t) if x], repr(t)
        assert (got[i]["why"], got[i]["skip"]) == (plain_reason(t), plain_abstract(t)), repr(t)


def test_a_source_of_100_000_lines(spark):
    text = "/* head\n" + "\n".join(f"  int x{k}; /* c\n/*\n@Disabled\n*/" for k in range(25_000)) + "\npublic class Big {\n @Test void a() {}"
    open_end = text + "\n/*" + "\nclass X" * 50_000
    began = time.time()
    df = spark.createDataFrame([(text,), (open_end,), (None,)], "text string")
    got = df.select(discovery.source_reason(F.col("text")), discovery.not_instantiable(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [(None, False), (None, False), (None, False)] and time.time() - began < 20


def test_answers_and_settings(spark):
    from testlattice.functions import scalars as sf
    from testlattice.operators import explore

    tests = spark.createDataFrame([("T#a",), ("T#none",)], "test_name string")
    cls = spark.createDataFrame([("T#a", "p.A"), ("T#a", "p.A"), ("T#a", "p.B")], "test_name string, class_fqn string")
    method = spark.createDataFrame([("T#a", "p.A#m")], "test_name string, method_fqn string")
    asked = spark.createDataFrame([("test", "T#a"), ("test", "T#none"), ("test", "T#x"), ("class", "p.A"), ("class", "T#a"), ("method", "p.A#m"), ("other", "p.A"), ("class", None)], "kind string, name string")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in explore.answers(asked.union(asked), tests, cls, method).collect()}
    assert got == {("test", "T#a"): (2, 0), ("test", "T#none"): (0, 0), ("test", "T#x"): (0, 1), ("class", "p.A"): (1, 0), ("class", "T#a"): (0, 1), ("method", "p.A#m"): (1, 0), ("other", "p.A"): (0, 1), ("class", None): (0, 1)}
    df = spark.createDataFrame([(None, None), ({}, "x"), ({"CI": ""}, " local"), ({"CHANGE_ID": "1"}, "REMOTE"), ({"JENKINS_URL": "u", "GITHUB_PR_NUMBER": "2"}, "")], "e map<string,string>, p string")
    assert [tuple(r) for r in df.select(sf.context_of(F.col("e")), sf.prefer_of(F.col("p"))).collect()] == [("local", "NEAREST"), ("local", "NEAREST"), ("ci-main", "LOCAL"), ("local", "REMOTE"), ("ci-pr", "NEAREST")]
    texts = ['a"b\\c\n\t/é ', "", None]
    assert [r[0] and json.loads(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sf.json_string(F.col("t"))).collect()] == texts


@pytest.fixture
def in_splits(spark, monkeypatch):
    """Every document counts as large, and splits are of some hundred bytes."""
    monkeypatch.setattr(documents, "LARGE", -1)
    monkeypatch.setattr(documents, "LARGE_PACKED", -1)
    given = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k in given:
        spark.conf.unset(k)


def test_metrics_without_a_row_for_all(spark, tmp_path, in_splits):
    """no task writes or reads more than a range of the tests; equal tests stay as often as they come."""
    text = ['a"b', "x,y", "{[", "]}", "\\", "é\n", None]
    tests = [("m", f"T#{k % 60}", text[k % 7] or "PASSED", k % 60, text[k % 7], text[k % 5]) for k in range(120)] + [("", "", "", -1, None, None)] * 3
    metric = spark.createDataFrame(tests, "module string, name string, status string, duration_ms long, failure_type string, failure_message string")
    sinks.write_metrics(metric, str(tmp_path / "m"), "run", "abc", "main", "ci", "now")
    (file,) = [x for x in os.listdir(tmp_path / "m") if not x.startswith((".", "_"))]
    lines = (tmp_path / "m" / file).read_text().splitlines()
    document = json.loads(lines[0])
    fields = ("module", "name", "status", "durationMs", "failureType", "failureMessage")
    assert len(lines) == 1 and document["summary"]["total"] == 123 and sorted((tuple(t[f] for f in fields) for t in document["tests"]), key=str) == sorted(tests, key=str)
    assert [t["name"] for t in document["tests"]] == sorted(t[1] for t in tests)
    read = reports.read_tests(spark, [str(tmp_path / "m")])
    assert read.rdd.getNumPartitions() > 1 and rows(read.select("t.*")) == sorted(tests, key=str)
    sinks.write_metrics(metric.limit(0), str(tmp_path / "m"), "run", "abc", "main", "ci", "now")
    assert json.loads((tmp_path / "m" / file).read_text())["tests"] == [] and reports.read_tests(spark, [str(tmp_path / "m")]).count() == 0


def big_map(spark):
    name = lambda k: ["a,b", 'q"', "}]", "\\", "é", ":{["][k % 6]
    tests = [f"S{k % 7}Test#t{k}{name(k)}" for k in range(90)]
    one = lambda kind, rows: spark.createDataFrame(rows, f"test_name string, pos int, {kind} string")
    return {
        "map_meta": spark.createDataFrame([("main", "c}1", None)], "base_branch string, commit_id string, ts string"),
        "map_test": spark.createDataFrame([(t,) for t in [*tests, "None#n"]], "test_name string"),
        "cov_class": one("class_fqn", [(t, p, f"p.C{(k * 3 + p) % 11}{name(p)}") for k, t in enumerate(tests) for p in range(k % 5)] + [("Unknown#u", 0, "p.X")]),
        "cov_method": one("method_fqn", [(t, p, f"p.C{(k + p) % 11}#m{p}{name(k)}") for k, t in enumerate(tests) for p in range(k % 4)]),
        "class_metrics": spark.createDataFrame([(f"p.C{k}{name(k)}", k, 1, None, 2) for k in range(20)], "class_fqn string, line_missed int, line_covered int, branch_missed int, branch_covered int"),
    }


def same_map(spark, found, given):
    for table, column in (("cov_class", "class_fqn"), ("cov_method", "method_fqn")):
        assert rows(found[table].select("test_name", "pos", column)) == rows(given[table].select("test_name", "pos", column).where("test_name <> 'Unknown#u'"))
    assert rows(found["map_test"].select("test_name")) == rows(given["map_test"]) and rows(found["map_meta"].drop("map_id")) == [("main", "c}1", None)]
    assert rows(found["class_metrics"].drop("map_id")) == rows(given["class_metrics"])
    assert found["map_test"].rdd.getNumPartitions() > 1


def written(folder):
    import gzip

    (file,) = [x for x in os.listdir(folder) if not x.startswith((".", "_"))]
    return json.loads(gzip.open(folder / file).read() if file.endswith(".gz") else (folder / file).read_bytes())


@pytest.mark.parametrize("longest", [50, 1 << 20])
def test_a_plain_map_without_a_row_for_all(spark, tmp_path, in_splits, monkeypatch, longest):
    """cut at braces, or at commas where braces are too far apart."""
    monkeypatch.setattr(documents, "LONGEST", longest)
    given = big_map(spark)
    sinks.write_plain_map(given, str(tmp_path / "m"))
    document = written(tmp_path / "m")
    assert list(document["testMappings"]) == sorted(x for x, in rows(given["map_test"])) and document["testMappings"]["None#n"] == {"classes": [], "methods": []}
    same_map(spark, maps.read_tables(spark, str(tmp_path / "m")), given)
    twice = given | {"class_metrics": given["class_metrics"].union(given["class_metrics"])}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        sinks.write_plain_map(twice, str(tmp_path / "twice"))


def test_packed_maps_without_a_row_for_all(spark, tmp_path, in_splits):
    """the ranges of a map are packed one by one and make one file."""
    given = big_map(spark)
    sinks.write_indexed_map(given, str(tmp_path / "m"), gzip=True)
    document = written(tmp_path / "m")
    assert document["classIndex"] == sorted({r[0] for r in given["cov_class"].select("class_fqn").collect()}) and len(document["testMappings"]) == 91
    assert rows(maps.read_tables(spark, str(tmp_path / "m"))["map_test"].select("test_name")) == rows(given["map_test"])


def test_metadata_of_a_large_map(spark, tmp_path, monkeypatch):
    """the map is written as a row for each entry, an empty one too, and its metadata are read alone."""
    given, counts, write = big_map(spark), [], sinks._written
    monkeypatch.setattr(sinks, "_written", lambda lines, *rest: (counts.append(lines.count()), write(lines, *rest)))
    sinks.write_plain_map(given, str(tmp_path / "m"))
    assert counts == [91 + 20 + 3]
    assert rows(maps.read_metadata(spark, str(tmp_path / "m"))) == [("main", "c}1", None)]
    sinks.write_indexed_map({k: df.limit(0) for k, df in given.items()}, str(tmp_path / "empty"))
    assert written(tmp_path / "empty") == {"metadata": None, "testMappings": {}, "classMetrics": {}, "classIndex": [], "methodIndex": []}


def test_an_indexed_map_without_a_row_for_all(spark, tmp_path, in_splits):
    """names meet ids by a join; an id without a name, a broken file and a broken entry aren't passed over."""
    given = big_map(spark)
    sinks.write_indexed_map(given, str(tmp_path / "m"))
    same_map(spark, maps.read_tables(spark, str(tmp_path / "m")), given)
    document = written(tmp_path / "m")
    text = json.dumps(document)
    for name, bad in (("cut", text[:-900]), ("id", re.sub(r'"classes": \[\d+', '"classes": [777', text, count=1)), ("entry", re.sub(r'"methods": \[\d+', '"methods": [0 0', text, count=1))):
        (tmp_path / f"{name}.json").write_text(bad)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        maps.read_tables(spark, str(tmp_path / "id.json"))["cov_class"].collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        maps.read_tables(spark, str(tmp_path / "entry.json"))["cov_method"].collect()
    cut = maps.read_tables(spark, str(tmp_path / "cut.json"))
    assert rows(cut["map_meta"]) == [("map", None, None, None)] and cut["map_test"].count() == 0
