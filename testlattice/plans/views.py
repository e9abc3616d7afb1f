"""Coverage data derived from the star-schema test tables, as one SQL text for both engines ({name} stands for a table or view)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path

CLASS = "concat('com.', lower(p_type), '.', replace(p_brand, '#', ''))"

VIEWS = {
    "cov": f"SELECT DISTINCT concat('Suite', l_orderkey % 40, 'Test#t', l_orderkey) AS test_name, {CLASS} AS class_fqn, concat({CLASS}, '#m', p_size) AS method_fqn FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey",
    "cov_method": "SELECT test_name, class_fqn, method_fqn, CAST(row_number() OVER (PARTITION BY test_name ORDER BY md5(method_fqn)) AS BIGINT) AS pos FROM {cov}",
    "cov_class": "SELECT test_name, class_fqn, CAST(row_number() OVER (PARTITION BY test_name ORDER BY md5(class_fqn)) AS BIGINT) AS pos FROM (SELECT DISTINCT test_name, class_fqn FROM {cov}) AS c",
    "raw_class": "SELECT test_name, class_fqn FROM {cov_class} UNION SELECT test_name, concat('com.suite.', split_part(test_name, '#', 1)) FROM {cov_class} UNION SELECT test_name, concat('com.test.', split_part(class_fqn, '.', 3)) FROM {cov_class} WHERE class_fqn LIKE '%1'",
    "raw_method": "SELECT test_name, class_fqn, method_fqn FROM {cov_method} UNION SELECT test_name, class_fqn, concat(class_fqn, '#run') FROM {raw_class} UNION SELECT test_name, 'com.lone.LoneTest', 'com.lone.LoneTest#m' FROM {cov_class}",
    "map_test": "SELECT test_name, split_part(test_name, '#', 1) AS test_class FROM (SELECT DISTINCT test_name FROM {cov} UNION SELECT 'EmptyTest#none') AS t",
    "selected": "SELECT test_name FROM {map_test} WHERE test_name LIKE '%7' OR test_name LIKE 'Empty%'",
    "changed_method": f"SELECT DISTINCT concat({CLASS}, '#m', p_size) AS method_fqn FROM {{part}} WHERE p_partkey % 97 = 3 UNION SELECT concat({CLASS}, '#toString') FROM {{part}} WHERE p_partkey % 181 = 5 UNION SELECT 'com.none.Unknown#run'",
    "changed_class": f"SELECT DISTINCT {CLASS} AS class_fqn FROM {{part}} WHERE p_partkey % 151 = 7 UNION SELECT 'com.none.Unknown'",
    "counters": f"SELECT {CLASS} AS class_fqn, l_orderkey AS ord, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS INT) AS line_missed, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE l_linenumber * 9 END AS INT) AS line_covered, CAST(l_suppkey % 7 AS INT) AS branch_missed, CAST(l_linenumber % 3 AS INT) AS branch_covered FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey",
    "line_cov": f"SELECT {CLASS} AS class_fqn, l_orderkey AS ord, CAST(l_linenumber AS INT) AS nr, max(CAST(floor(l_quantity) AS INT)) AS ci, max(CAST(l_suppkey % 90 AS INT)) AS mi, max(CAST(l_suppkey % 3 AS INT)) AS cb, max(CAST(l_partkey % 4 AS INT)) AS mb FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "changed_path": "SELECT p_partkey AS ord, CASE p_partkey % 8 WHEN 0 THEN concat('src/main/java/com/a/P', p_partkey, '.java') WHEN 1 THEN concat('m1/src/main/kotlin/com/b/C', p_partkey, '.java') WHEN 2 THEN concat('ext/core/src/com/x/S', p_partkey, '.java') WHEN 3 THEN concat('ext/core/testsrc/com/x/S', p_partkey, 'Test.java') WHEN 4 THEN concat('m2/src/test/java/com/t/Suite', p_partkey % 70, 'Test.java') WHEN 5 THEN concat('doc/README', p_partkey, '.md') WHEN 6 THEN concat('src/com/x/Y', p_partkey, '.java') ELSE concat('m3/src/One', p_partkey, '.java') END AS path FROM {part}",
    "name_status": "SELECT ord, concat(CASE ord % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN concat('R100', chr(9), 'old/', ord, '.java') ELSE 'M' END, chr(9), path) AS line FROM {changed_path}",
    "patch": "SELECT o_orderkey % 50 AS patch_id, o_orderkey * 100 AS line_no, concat('diff --git a/x b/', path) AS line FROM {orders} JOIN {changed_path} ON ord = o_orderkey % 190 UNION SELECT l_orderkey % 50, l_orderkey * 100 + l_linenumber, concat('@@ -', l_linenumber, ',2 +', l_linenumber, ',3 @@', CASE l_linenumber % 3 WHEN 0 THEN ' public class Foo ' WHEN 1 THEN concat(' public String m', l_linenumber, '()') ELSE concat(' private static List<String> go', l_orderkey % 9, '(int x)') END) FROM {lineitem}",
    "test_metric": "SELECT concat('mod', user_id % 5) AS module, concat('T#e', event_id) AS name, CASE event_type WHEN 'purchase' THEN 'PASSED' WHEN 'error' THEN 'FAILED' ELSE 'SKIPPED' END AS status, CAST(floor(value) AS BIGINT) AS duration_ms, CASE event_type WHEN 'error' THEN 'org.opentest4j.AssertionFailedError' WHEN 'view' THEN 'java.util.concurrent.TimeoutException' WHEN 'click' THEN 'java.io.IOException' END AS failure_class FROM {events}",
    "class_file": "SELECT s_suppkey AS ord, concat('mod', s_suppkey % 4) AS module, CASE WHEN s_suppkey % 9 = 0 THEN 'pom' ELSE 'jar' END AS packaging, concat('com/t/Suite', s_suppkey % 60, 'Test', CASE s_suppkey % 11 WHEN 1 THEN '$1' ELSE '' END, '.class') AS rel_path FROM {supplier} UNION SELECT c_custkey, concat('mod', c_custkey % 4), 'jar', concat('com/acme/C', c_custkey % 300, CASE c_custkey % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'Spec' WHEN 2 THEN 'Helper' ELSE 'Tests' END, '.class') FROM {customer}",
    "prod_file": f"SELECT p_partkey AS ord, concat('mod', p_partkey % 6) AS module, CASE WHEN p_partkey % 9 = 0 THEN 'pom' ELSE 'jar' END AS packaging, concat(replace({CLASS}, '.', '/'), '.class') AS rel_path FROM {{part}}",
    "source": "SELECT class_fqn, concat('/* head', chr(10), ' * @Disabled */', chr(10), 'package com.acme;', chr(10), CASE n % 9 WHEN 0 THEN '@Disabled(\"x\")' WHEN 1 THEN '@RunWith(Enclosed.class)' WHEN 2 THEN 'class Hidden ' WHEN 3 THEN 'public class A String x = System.getenv(\"X\"); @Test void a() ' WHEN 4 THEN '  @ArchTest' WHEN 5 THEN 'public class B ' WHEN 6 THEN 'public abstract class Base @Test void a() ' WHEN 7 THEN 'public interface I @Test void a();' ELSE 'public class C @Test void a() ' END, chr(10), '  @Test void b()') AS text FROM (SELECT DISTINCT c_custkey % 300 AS n, concat('com.acme.C', c_custkey % 300, CASE c_custkey % 4 WHEN 0 THEN 'IT' WHEN 1 THEN 'Spec' WHEN 2 THEN 'Helper' ELSE 'Tests' END) AS class_fqn FROM {customer} WHERE c_custkey % 300 <> 7) AS s",
    "plain_source": "SELECT class_fqn, CASE WHEN class_fqn LIKE '%5Spec' THEN replace(replace(text, '@Test', '@T'), 'abstract', 'final') ELSE text END AS text FROM {source}",
    "commented_source": "SELECT class_fqn, CASE length(class_fqn) % 5 WHEN 0 THEN concat('/*', chr(10), replace(text, '*/', '* /'), chr(10), ' closed */ @Disabled', chr(10), 'public class Z {{', chr(10), chr(9), '@Test void z() {{}}') WHEN 1 THEN concat(text, chr(10), chr(9), '/* @Disabled', chr(10), '@Disabled', chr(10), 'class Inner x') WHEN 2 THEN concat(chr(9), '/* one line */', chr(10), chr(9), '@Ignore ', chr(10), text) WHEN 3 THEN concat('int a; /* not at the start', chr(10), text, chr(10), '/*/', chr(10), 'final  class Late') ELSE concat(replace(text, chr(10), concat(chr(13), chr(10))), chr(13), chr(10), '/**', chr(13), chr(10), ' @ArchTest Enclosed.class', chr(10), '*/') END AS text FROM {source}",
    "versions": "SELECT concat('Suite', o_orderkey % 40, 'Test#t', o_orderkey % 5000) AS test_name, concat('Suite', o_orderkey % 40, 'Test') AS test_class, o_orderkey AS file_ord, o_custkey AS payload FROM {orders}",
    "base_map": "SELECT test_name, test_class, payload FROM {versions} WHERE file_ord % 3 <> 0",
    "module_map": "SELECT test_name, test_class, payload FROM {versions} WHERE file_ord % 3 = 0 AND test_class < 'Suite3'",
    "map_slot": "SELECT concat('p', o_custkey) AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'remote' ELSE 'local' END AS slot, CASE WHEN min(o_orderkey) % 7 = 0 THEN NULL ELSE CAST(min(o_orderkey) % 5 AS INT) END AS distance FROM {orders} GROUP BY o_custkey, o_orderkey % 2",
    "unmapped": "SELECT DISTINCT concat('com.t.Suite', s_suppkey % 60, 'Test') AS class_fqn FROM {supplier} UNION SELECT DISTINCT concat('com.u.Suite', s_suppkey % 30, 'Test') FROM {supplier} WHERE s_suppkey % 2 = 0",
    "ladder_state": "SELECT concat('map', o_orderkey) AS map_id, o_orderkey % 11 <> 0 AS found, o_orderkey % 13 <> 0 AS readable, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' ELSE 'abc' END AS commit_id, o_orderkey % 23 <> 0 AS valid, CAST(o_custkey % 600 AS INT) AS distance, o_orderkey % 29 = 0 AS triggered, CAST(o_orderkey % 4 AS INT) AS changes, CAST(o_orderkey % 5 AS INT) AS tests FROM {orders}",
    "xml_file": "SELECT CASE WHEN test_name LIKE '%5%' THEN concat('session_', test_name, '.xml') ELSE concat(test_name, '.xml') END AS file_name FROM {map_test} WHERE test_name NOT LIKE '%9'",
    "src_line": "SELECT class_fqn AS key, nr, concat('line ', nr) AS text FROM (SELECT DISTINCT class_fqn FROM {line_cov}) AS a CROSS JOIN (SELECT CAST(n_nationkey AS INT) AS nr FROM {nation} WHERE n_nationkey BETWEEN 1 AND 9) AS b",
    "artifact": "SELECT concat('TEST-', test_class, '-', chr(CAST(97 + length(test_class) % 5 AS INT)), '.xml') AS file_name FROM (SELECT DISTINCT test_class FROM {map_test}) AS t UNION SELECT concat('junit_', test_class, '.txt') FROM {map_test} WHERE test_class LIKE '%5Test' UNION SELECT concat('my', test_class, '2.xml') FROM {map_test} WHERE test_class LIKE '%3Test' UNION SELECT concat('TEST-All', test_class, 'Extra_IT.xml') FROM {map_test} WHERE test_class LIKE '%2Test'",
    "one_patch": "SELECT CAST(1 AS BIGINT) AS patch_id, patch_id * 1000000000 + line_no AS line_no, line FROM {patch}",
    "history": "SELECT project, commit_id, ord, CASE WHEN ord % 5 = 0 THEN third ELSE previous END AS parent_id FROM {commit_line} UNION ALL SELECT project, commit_id, ord, sixth FROM {commit_line} WHERE ord % 7 = 0 AND sixth IS NOT NULL",
    "commit_line": "SELECT concat('p', o_custkey % 40) AS project, concat('c', o_orderkey) AS commit_id, o_orderkey AS ord, lag(concat('c', o_orderkey), 1) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS previous, lag(concat('c', o_orderkey), 3) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS third, lag(concat('c', o_orderkey), 6) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS sixth FROM {orders}",
    "suite_method": "SELECT DISTINCT concat(test_class, '#everyCase') AS test_name, class_fqn, method_fqn FROM (SELECT split_part(test_name, '#', 1) AS test_class, class_fqn, method_fqn FROM {cov}) AS c",
    "module_class": "SELECT concat('mod', CAST(substr(split_part(test_name, '#', 2), 2) AS BIGINT) % 7) AS module, test_name, class_fqn, pos FROM {cov_class}",
    "extension_class": "SELECT DISTINCT CASE ord % 6 WHEN 0 THEN 'ext/core/classes' WHEN 1 THEN 'ext/web/classes' WHEN 2 THEN '../custom/shop/classes' WHEN 3 THEN '../lone/classes' WHEN 4 THEN 'bootstrap/classes' ELSE 'ext/core/other' END AS folder, rel_path FROM {class_file}",
    "glob_number": "SELECT DISTINCT p_partkey % 5000 AS k FROM {part}",
    "head": "SELECT concat('p', o_custkey % 40) AS project, concat('c', max(o_orderkey)) AS head_id FROM {orders} GROUP BY o_custkey % 40",
    "map_commit": "SELECT concat('p', o_custkey % 40) AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'remote' ELSE 'local' END AS slot, CASE WHEN o_custkey % 40 = 3 THEN 'gone' WHEN o_custkey % 4 = 0 THEN concat('c', min(o_orderkey)) ELSE concat('c', max(CASE WHEN o_orderkey % 9 = 4 THEN o_orderkey ELSE 1 END)) END AS commit_id FROM {orders} GROUP BY o_custkey % 40, o_custkey % 4, o_orderkey % 2",
    "commits": "SELECT o_orderkey AS position, concat('c', o_orderkey) AS commit_id FROM {orders}",
}

#: Canonical tables that many queries start from: made once for a folder of test tables, and read from the shared folder after that.
STORED = ("cov", "cov_method", "cov_class")

_written: dict[tuple[str, str, str], str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents conversations pages".split()


class Views:
    """The derived views over a folder of test tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            if name in VIEWS:
                text = VIEWS[name]
                self.made[name] = self._stored(name) if name in STORED else self._derived(text)
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]

    def _derived(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs(text)})

    def _stored(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            path = shared_path(self.spark, name)
            self._derived(VIEWS[name]).write.parquet(path)
            _written[key] = path
        return self.spark.read.parquet(_written[key])


def needs(text: str) -> list[str]:
    return [n for n in (*VIEWS, *TABLES) if "{" + n + "}" in text]


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    plain = lambda text: text.format(**{n: n for n in (*VIEWS, *TABLES)})
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
