"""Commit distances, postings, trigrams, globs and list blocks against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from testlattice.functions.glob import glob_regex
from testlattice.operators import changes, explore, history, postings, report, selection, triggers, trigrams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made_history(rng, n, projects):
    out, parents = [], {}
    for p in projects:
        for i in range(n):
            own = sorted({max(0, i - rng.choice([1, 1, 1, 2, 3, 9])) for _ in range(rng.choice([1, 1, 1, 2, 3]))} - {i}) if i else []
            parents[p, f"c{i}"] = [f"c{k}" for k in own]
            out += [(p, f"c{i}", i, f"c{k}") for k in own] or [(p, f"c{i}", i, None)]
    return out, parents


def reached(parents, p, c):
    seen, todo = set(), [c]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents.get((p, x), [])
    return seen


@pytest.mark.parametrize("size, most", [(512, None), (7, None), (16, 5)])
def test_commit_distances(spark, size, most):
    rng = random.Random(size)
    told, parents = made_history(rng, 60, ["a", "b", "c"])
    graph = spark.createDataFrame([*told, *told[:5], ("a", "c5", 5, "beyond the clone")], "project string, commit_id string, ord long, parent_id string")
    pairs = [(p, h, c) for p in "abc" for h in ("c59", "c40") for c in ("c59", "c0", "c33", "c45", "gone")] + [("a", "gone", "c1"), ("none", "c1", "c1"), (None, "c1", "c1"), ("a", "c59", "c0")]
    got = history.commit_distances(graph, spark.createDataFrame(pairs, "project string, head_id string, commit_id string"), most, size)
    want = []
    for p, h, c in pairs:
        known = (p, h) in parents and (p, c) in parents
        n = len(reached(parents, p, h) - reached(parents, p, c)) if known else None
        want.append((p, h, c, n if n is None or most is None else min(n, most + 1)))
    assert rows(got) == sorted(want, key=str)


def test_history_of_a_log(spark):
    text = [("p", 0, "m3 m2 s1"), ("p", 1, "s1 m1"), ("p", 2, "m2 m1"), ("p", 3, " m1 "), ("p", 4, "")]
    graph = history.commit_log(spark.createDataFrame(text, "project string, line_no int, line string"))
    assert rows(graph.select("commit_id", "parent_id")) == [("m1", None), ("m2", "m1"), ("m3", "m2"), ("m3", "s1"), ("s1", "m1")]
    maps = spark.createDataFrame([("p", "remote", "m2"), ("p", "local", "m1"), ("q", "local", "m1")], "project string, slot string, commit_id string")
    heads = spark.createDataFrame([("p", "m3"), ("q", "x")], "project string, head_id string")
    assert rows(history.nearest_by_history(graph, maps, heads)) == [("p", "remote", 2), ("q", "local", 2147483647)]
    assert rows(history.known_commits(graph, maps).select("project", "commit_id")) == [("p", "m1"), ("p", "m2")]
    assert history.commit_distances(graph.limit(0), maps.withColumn("head_id", F.lit("m3"))).where("distance is not null").count() == 0
    with pytest.raises(Exception, match="before its parent"):
        history.commit_distances(graph.withColumn("ord", -F.col("ord")), maps.withColumn("head_id", F.lit("m3"))).collect()


def coverage(spark, tests=400):
    rng = random.Random(9)
    cov = []
    for t in range(tests):
        own = rng.sample([f"p.C{k}#m{m}" for k in range(12) for m in range(3)], rng.randrange(1, 9)) + (["p.All#run"] if t % 7 else []) + (["p.Rare#x"] if t == 5 else [])
        cov += [(f"T{t % 20}#t{t}", m.split("#")[0], m, i) for i, m in enumerate(own)]
    method = spark.createDataFrame(cov, "test_name string, class_fqn string, method_fqn string, pos int")
    first = {}
    for t, c, _, i in cov:
        first.setdefault((t, c), i)
    cls = spark.createDataFrame([(t, c, i) for (t, c), i in first.items()], "test_name string, class_fqn string, pos int")
    return method, cls, method.select("test_name").distinct().unionByName(spark.createDataFrame([("Empty#none",)], "test_name string"))


@pytest.mark.parametrize("few", [1, 20, 10**6])
def test_postings_give_what_rows_give(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(postings, "FEW", few)
    method, cls, tests = coverage(spark)
    ids = postings.test_numbers(tests).cache()
    assert rows(ids)[0] == ("Empty#none", 1)
    for name, df, key in (("m", method, "method_fqn"), ("c", cls, "class_fqn")):
        postings.store(postings.postings(df.unionByName(df.withColumn("pos", F.col("pos") + 100)), ids, key), str(tmp_path / name), parts=8)
    ms, cs = (postings.load(spark, str(tmp_path / x)) for x in "mc")
    assert sum(r["n"] for r in cs.select("n").collect()) == cls.count()
    changed_method = spark.createDataFrame([("p.C1#m0",), ("p.C2#m1",), ("p.C1#gone",), ("q.None#m",), (None,)], "method_fqn string")
    changed_class = spark.createDataFrame([("p.C1",), ("p.Rare",), ("p.Missing",)], "class_fqn string")
    monkeypatch.setattr(postings, "PARTS", 8)
    got = postings.select_tests(_in(ms), _in(cs), ids, changed_method, changed_class)
    assert rows(got) == rows(selection.select_tests(method, cls, changed_method, changed_class))
    for chosen in (["T3#t3", "T5#t5"], ["T0#t0", "Empty#none"], []):
        own = spark.createDataFrame([(x,) for x in chosen], "test_name string")
        assert rows(postings.closure(cs, ids, own)) == rows(report.closure(cls, own))
    plan = postings.look_up(cs, spark.createDataFrame([("p.Rare",)], "key string"), parts=8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def _in(index):
    """All folders: the look-up's own number of them is the module's."""
    return index.drop("part")


def test_buckets_beyond_the_first(spark):
    ids = spark.range(1, 100_001, 997).select(F.lit("k").alias("key"), "id").unionByName(spark.range(1, 40_000).select(F.lit("dense").alias("key"), "id"))
    index = postings.packed(ids).cache()
    sets = postings.union_of(index, "key")
    assert rows(postings.members(sets, "key")) == rows(ids) and {r["bits"] is None for r in index.collect()} == {True, False}
    assert index.groupBy("key").agg(F.max("n")).where("`max(n)` > 32768").count() == 0
    assert rows(postings.meeting(index, sets.where("key = 'k'").select("bucket", "bits"))) == [("dense",), ("k",)]


def test_trigram_search_gives_what_a_scan_gives(spark, tmp_path):
    names = ["com.acme.Order", "com.acme.ORDERS", "x", "ab", "İstanbul#go", "ΑΣΑ", "straße.Test", "ORDERORDER", "com.acme.Ord%er_", "", "日本語テスト"]
    every = spark.createDataFrame([(k, n) for k in ("test", "class") for n in names] + [("method", "com.acme.Order#run")], "kind string, name string")
    path = str(tmp_path / "names")
    trigrams.store(every, path, parts=4)
    for needle in ("order", "ORD", "Ord", "rder", "x", "", "ab", "ΑΣ", "ασα", "istanbul", "İst", "本語テ", "nothing at all", "acme.Order", "%er_", "straSSE", "orderord"):
        for case in (True, False):
            found = trigrams.search(spark, path, needle, ignore_case=case, parts=4)
            scan = every.where(F.contains(F.lower("name"), F.lower(F.lit(needle))) if case else F.contains(F.col("name"), F.lit(needle)))
            assert rows(found) == rows(scan.distinct()), needle
    assert rows(trigrams.search(spark, path, "order", "method", parts=4)) == [("method", "com.acme.Order#run")]
    plan = trigrams.candidates(spark, path, ["ord", "rde"], parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [ord,rde])" in plan and re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_suggestions_and_section_search_by_trigrams(spark, tmp_path):
    method, cls, tests = coverage(spark, 60)
    ids = postings.test_numbers(tests)
    path = str(tmp_path / "names")
    trigrams.store(trigrams.names_of(tests, cls, method), path)
    index = postings.postings(cls, ids, "class_fqn")
    for part in ("p.C1", "All", ".C", "zzz", "C"):
        assert rows(trigrams.similar_classes(spark, path, index, part, 3)) == rows(explore.similar_classes(cls, part, 3))
    table = spark.createDataFrame([("T#a", True, "Order Item", "run"), ("T#b", False, "Item", "orderAll"), ("Order#c", True, None, ""), ("T#d", True, "x", "y")], "t string, s boolean, c string, m string")
    trigrams.store(trigrams.texts_of(table), f"{path}-rows")
    for part in ("ORDER", "it", "t#", "zz"):
        for boxes in ((), ("classes",), ("tests", "methods")):
            for only in (True, False):
                ticked = {b: True for b in boxes}
                assert rows(trigrams.section_search(table, f"{path}-rows", part, *boxes, selected_only=only)) == rows(explore.section_search(table, part, selected_only=only, **ticked))


PATTERNS = ["**/pom.xml", "a/b/*.gradle", "{a,b}/c?.{txt,md}", "**", "x\\*y/*.q", "src/[ab]/**/T*.java", "a", "*.md", "**/core/**", "a/**b/c.java", "z{1,2{3,4}}.k", "[!x]/y.z", "core/*", "**/Suite77Test*.java", "LongSegm*/q?", "m/**LongSegment*"]


def test_anchored_globs(spark):
    rng = random.Random(12)
    assert triggers.alternatives("{a,b}/c?.{txt,md}") == ["a/c?.txt", "a/c?.md", "b/c?.txt", "b/c?.md"] and triggers.alternatives("z{1,2{3,4}}") == ["z1", "z23", "z24"]
    assert triggers.names("**/Suite77Test*.java") == ["^Suite77T", ".java"] and triggers.names("LongSegment?/x\\*yyyyyyyyy*") == ["^LongSegm"]
    assert triggers.names("src/[ab]/**/T*.java") == ["/src", ".java"] and triggers.names("**") == [] and triggers.names("a/**b/c.java") == ["/a", "/c.java", ".java"]
    paths = ["pom.xml", "m/pom.xml", "a/b/x.gradle", "b/c1.md", "x*y/1.q", "src/a/T.java", "src/b/q/r/T1.java", "a", "q.md", "m/core/x", "a/qb/c.java", "a/q/rb/c.java", "z23.k", "w/y.z", "core/x", "", "a/b", None, "m/Suite77Test.java", "m/Suite77Tes.java", "LongSegm/qq", "LongSegment/q1", "m/xLongSegment/y", "m/a/LongSegments"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for k in range(14):
        chosen = PATTERNS if k == 0 else rng.sample(PATTERNS, rng.randrange(0, 6))
        assert rows(triggers.first_trigger(df, chosen)) == rows(selection.trigger_match(df, chosen)), chosen
    for p in PATTERNS:
        assert rows(triggers.first_trigger(df, [p])) == rows(selection.trigger_match(df, [p])), p
        assert all(any(re.match(glob_regex(x), q or "\0") for x in triggers.alternatives(p)) == bool(re.match(glob_regex(p), q or "\0")) for q in paths)


def test_five_thousand_globs(spark):
    df = spark.range(20_000).select(F.concat(F.lit("m"), F.col("id") % 50, F.lit("/src/P"), "id", F.when(F.col("id") % 2 == 0, ".java").otherwise(".kt")).alias("path"))
    chosen = [f"**/src/P{k}.{'java' if k % 2 else 'kt'}" for k in range(0, 10_000, 2)] + ["m7/src/P?57.{kt,java}", "**/P4444.java"]
    assert rows(triggers.first_trigger(df, chosen)) == [("m7/src/P157.kt", "m7/src/P?57.{kt,java}")]


def test_one_patch_in_many_ranges(spark):
    lines, rng = [], random.Random(3)
    for k in range(3000):
        lines.append(rng.choice(["@@ -1 +1 @@ void a()", "@@ -1 +1 @@ int b(int c)", "+x", f"diff --git a/x b/src/main/java/p/C{k}.java", "diff --git a/x b/doc/x.md"]) if k % 40 else "+")
    want, now = [], None
    for n, x in enumerate(lines):
        if x.startswith("diff"):
            now = x.rsplit(" b/", 1)[1].removeprefix("src/main/java/").removesuffix(".java").replace("/", ".") if x.endswith(".java") else None
        want.append((n, now))
    df = spark.createDataFrame([(7, n, x) for n, x in enumerate(lines)] + [(None, 5, "+z"), (8, 0, "@@ -1 +1 @@ void q()")], "patch_id int, line_no int, line string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = changes.patch_classes(df).cache()
        assert sorted(tuple(r) for r in got.where("patch_id = 7").select("line_no", "class_fqn").collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(got.where("coalesce(patch_id, 8) = 8").select("line", "class_fqn")) == [("+z", None), ("@@ -1 +1 @@ void q()", None)]
    assert got.count() == len(lines) + 2 and got.columns == ["patch_id", "line_no", "line", "_head", "class_fqn"]


def test_blocks(spark):
    rng = random.Random(2)
    cov = [(f"C{rng.choice([1, 1, 1, 1, 2, 3])}", f"T#{k}") for k in range(500)]
    df = spark.createDataFrame([*cov, *cov[:20], (None, "T#x")], "class_fqn string, test_name string")
    got = report.class_test_blocks(df, 30).collect()
    joined = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["class_fqn"]), r["block"])):
        assert len(r["values"]) <= 30 and r["first"] == len(joined[r["class_fqn"]]) == r["block"] * 30
        joined[r["class_fqn"]] += r["values"]
    assert joined == {c: sorted({t for x, t in cov if x == c}) for c in ("C1", "C2", "C3")} | {None: ["T#x"]}
    assert report.class_test_blocks(df.limit(0)).count() == 0


def test_chunk_rows_of_a_test_with_very_many_classes(spark):
    many = [("T#big", f"p.{'C' * (k % 3)}{k}", k) for k in range(3000)]
    cls = spark.createDataFrame([*many, ("T#one", "p.X", 0)], "test_name string, class_fqn string, pos int").repartition(5)
    method = cls.select("test_name", F.concat("class_fqn", F.lit("#")).alias("method_fqn"), "pos")
    tests = spark.createDataFrame([("T#big",), ("T#one",), ("T#none",)], "test_name string")
    got = {r["t"]: r for r in report.chunk_rows(tests, cls, method, tests.limit(0)).collect()}
    assert (got["T#big"]["cc"], got["T#one"]["cc"], got["T#none"]["cc"], got["T#none"]["classes"]) == (3000, 1, 0, [])
    assert got["T#big"]["classes"] == [c for _, c, _ in many][:200] and got["T#big"]["c"] == " ".join(c[2:] for _, c, _ in many)[:500]
    assert got["T#big"]["m"] == " " * 500 and got["T#big"]["mc"] == 3000
