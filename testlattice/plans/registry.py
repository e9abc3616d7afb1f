"""Names of all queries over the coverage relation, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sf
from ..model import CHUNK_TESTS
from ..operators import changes, coverage, discovery, explore, history, merge, postings, report, selection, triggers, trigrams
from ..session import pinned, shared_path
from ..sources import maps, reports, sinks, store
from ..streaming import ingest
from .trees import move_parts, write_files
from .views import Views, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the derived views under ``name``, with its equivalent for the other engine."""

    def add(f: Callable[[Views], DataFrame]):
        _queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _sql[name] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- selection

MINFO = "minfo AS (SELECT DISTINCT split_part(method_fqn, '#', 1) AS class_fqn FROM {changed_method} WHERE instr(method_fqn, '#') > 1)"
CONLY = "conly AS (SELECT DISTINCT class_fqn FROM {changed_class} WHERE class_fqn NOT IN (SELECT class_fqn FROM minfo))"
HIT = "hit AS (SELECT test_name, arg_min(method_fqn, pos) AS method_fqn FROM {cov_method} WHERE method_fqn IN (SELECT method_fqn FROM {changed_method}) GROUP BY test_name)"
ESC = "esc AS (SELECT class_fqn FROM minfo WHERE class_fqn NOT IN (SELECT split_part(method_fqn, '#', 1) FROM hit))"
PICK = f"""{MINFO}, {CONLY}, {HIT}, {ESC}, every_ AS (SELECT test_name, 1 AS k FROM hit
  UNION ALL SELECT test_name, 2 FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM conly) UNION ALL SELECT test_name, 3 FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM esc)),
  picked AS (SELECT test_name, CASE min(k) WHEN 1 THEN 'METHOD' WHEN 2 THEN 'CLASS' ELSE 'ESCALATED' END AS matched_by FROM every_ GROUP BY test_name)"""


def _selected(v: Views) -> DataFrame:
    return selection.select_tests(v.cov_method, v.cov_class, v.changed_method, v.changed_class)


@query("sel_select_tests", f"WITH {PICK} SELECT test_name, matched_by FROM picked")
def _(v):
    return _selected(v)


@query("j1_w4_first_hits", f"WITH {HIT} SELECT test_name, method_fqn, split_part(method_fqn, '#', 1) AS class_fqn FROM hit")
def _(v):
    return selection.first_hits(v.cov_method, v.changed_method)


@query("j2_class_matches", f"WITH {MINFO}, {CONLY} SELECT DISTINCT test_name FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM conly)")
def _(v):
    return selection.covering(v.cov_class, selection.class_only(v.changed_class, v.changed_method))


@query("j3_u5_escalation", f"WITH {MINFO}, {HIT}, {ESC} SELECT DISTINCT test_name FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM esc)")
def _(v):
    return selection.covering(v.cov_class, selection.zero_hit_classes(selection.first_hits(v.cov_method, v.changed_method), v.changed_method))


@query("j4_u2_class_only", f"WITH {MINFO}, {CONLY} SELECT class_fqn FROM conly")
def _(v):
    return selection.class_only(v.changed_class, v.changed_method)


@query("u6_method_info_classes", f"WITH {MINFO} SELECT class_fqn FROM minfo")
def _(v):
    return selection.method_info_classes(v.changed_method)


@query("a8_hits_per_class", f"WITH {MINFO}, {HIT} SELECT minfo.class_fqn, count(hit.test_name) AS hits FROM minfo LEFT JOIN hit ON split_part(hit.method_fqn, '#', 1) = minfo.class_fqn GROUP BY 1")
def _(v):
    return selection.hits_per_class(selection.first_hits(v.cov_method, v.changed_method), v.changed_method)


@query("a9_selection_totals", f"""WITH {PICK}, t AS (SELECT count(DISTINCT test_name) AS total FROM {{map_test}}), s AS (SELECT count(*) AS selected, count(*) FILTER (matched_by = 'METHOD') AS method, count(*) FILTER (matched_by = 'CLASS') AS class, count(*) FILTER (matched_by = 'ESCALATED') AS escalated FROM picked)
  SELECT total, selected, method, class, escalated, CASE WHEN total > 0 THEN 100.0::DOUBLE * (total - selected) / total ELSE 0 END AS reduction_pct FROM t, s""")
def _(v):
    return selection.totals(v.map_test, _selected(v))


TRIGGERS = ["**/*.gradle", "doc/README?5*.md", "ext/**/{S1,S2}*.java"]


@query("p11_f33_trigger_match", """WITH m AS (SELECT path, CASE WHEN regexp_matches(path, '^.*/[^/]*[.]gradle$') THEN 0 WHEN regexp_matches(path, '^doc/README[^/]5[^/]*[.]md$') THEN 1 WHEN regexp_matches(path, '^ext/.*/(S1|S2)[^/]*[.]java$') THEN 2 END AS k FROM {changed_path})
  SELECT path, CASE k WHEN 0 THEN '**/*.gradle' WHEN 1 THEN 'doc/README?5*.md' ELSE 'ext/**/{{S1,S2}}*.java' END AS pattern FROM m WHERE k IS NOT NULL ORDER BY k, path LIMIT 1""")
def _(v):
    return selection.trigger_match(v.changed_path, TRIGGERS)


def many_globs(numbers: list[int]) -> list[str]:
    return [f"src/main/java/com/*/P{k}.java" if k % 4 == 0 else f"**/Suite{k}Tes?.java" if k % 4 == 1 else f"{{doc,docs}}/README{k}.{{txt,md}}" if k % 4 == 2 else f"ext/**/S[{k % 10}]{k}.ja*" for k in numbers]


@query("p11_many_globs", """WITH g AS (SELECT k, row_number() OVER (ORDER BY k DESC) AS place FROM {glob_number}), m AS (SELECT path, k, place FROM {changed_path} CROSS JOIN g WHERE CASE k % 4
  WHEN 0 THEN starts_with(path, 'src/main/java/com/') AND ends_with(path, concat('/P', k, '.java')) AND length(path) - length(replace(path, '/', '')) = 5
  WHEN 1 THEN contains(path, '/') AND regexp_matches(path, '/Suite[0-9]+Tes.[.]java$') AND regexp_extract(path, '/Suite([0-9]+)Tes', 1) = CAST(k AS VARCHAR)
  WHEN 2 THEN path IN (concat('doc/README', k, '.txt'), concat('doc/README', k, '.md')) ELSE starts_with(path, 'ext/') AND contains(path, concat('/S', k % 10, k, '.ja')) END)
  SELECT path, CASE k % 4 WHEN 0 THEN concat('src/main/java/com/*/P', k, '.java') WHEN 1 THEN concat('**/Suite', k, 'Tes?.java') WHEN 2 THEN concat('{{doc,docs}}/README', k, '.{{txt,md}}') ELSE concat('ext/**/S[', k % 10, ']', k, '.ja*') END AS pattern FROM m ORDER BY place, path LIMIT 1""")
def _(v):
    numbers = sorted((r["k"] for r in v.glob_number.collect()), reverse=True)  # at most 5,000
    return triggers.first_trigger(v.changed_path, many_globs(numbers))


@query("u4_runnable", f"WITH {PICK} SELECT test_name AS name FROM picked UNION SELECT class_fqn FROM {{unmapped}}")
def _(v):
    return selection.runnable(_selected(v), v.unmapped)


@query("w9_d3_nearest_map", "SELECT project, slot, coalesce(distance, 2147483647) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coalesce(distance, 2147483647), slot = 'local') AS n FROM {map_slot}) AS s WHERE n = 1")
def _(v):
    return selection.nearest_map(v.map_slot)


@query("d3_prefer_local", "SELECT project, slot, coalesce(distance, 2147483647) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY slot <> 'local') AS n FROM {map_slot}) AS s WHERE n = 1")
def _(v):
    return selection.nearest_map(v.map_slot, "LOCAL")


LADDER = "CASE WHEN NOT found THEN 1 WHEN NOT readable THEN 2 WHEN coalesce(commit_id, '') = '' THEN 3 WHEN NOT valid THEN 4 WHEN distance > 500 THEN 5 WHEN triggered THEN 6 WHEN changes = 0 THEN 7 WHEN tests = 0 THEN 8 ELSE 9 END"


@query("d1_d2_ladder", f"""SELECT map_id, CASE k WHEN 7 THEN 'NONE' WHEN 9 THEN 'SELECTED' ELSE 'FULL_SUITE' END AS status,
  CASE k WHEN 1 THEN 'Coverage map not found' WHEN 2 THEN 'Coverage map or metadata missing' WHEN 3 THEN 'No commitId in coverage map metadata' WHEN 4 THEN 'commitId is not a valid git commit' WHEN 5 THEN 'Commit distance exceeds max' WHEN 6 THEN 'Changed file matches fullSuiteTrigger pattern' WHEN 7 THEN 'No production code changes detected' WHEN 8 THEN 'Coverage map has no test mappings' ELSE 'Selected by coverage' END AS reason
  FROM (SELECT map_id, {LADDER} AS k FROM {{ladder_state}}) AS s""")
def _(v):
    return selection.ladder(v.ladder_state)


@query("d4_k5_include_lines", f"WITH {PICK} SELECT DISTINCT split_part(test_name, '#', 1) AS line FROM picked UNION SELECT concat(replace(class_fqn, '.', '/'), '.java') FROM {{unmapped}}")
def _(v):
    return selection.filter_lines("SELECTED", _selected(v), v.unmapped)


@query("d4_k6_f26_include_patterns", f"WITH {PICK} SELECT replace(test_name, '#', '.') AS line FROM picked UNION SELECT concat(class_fqn, '.*') FROM {{unmapped}}")
def _(v):
    return selection.filter_lines("SELECTED", _selected(v), v.unmapped, patterns=True)


@query("a15_selected_classes", f"WITH {PICK} SELECT DISTINCT split_part(test_name, '#', 1) AS line FROM picked")
def _(v):
    return selection.filter_lines("SELECTED", _selected(v), v.unmapped.limit(0))


# ---- changes

FQN = """CASE WHEN NOT ends_with(path, '.java') THEN NULL
  WHEN contains(path, 'src/main/java/') THEN replace(substr(path, instr(path, 'src/main/java/') + 14, length(path) - instr(path, 'src/main/java/') - 18), '/', '.')
  WHEN contains(path, 'src/main/groovy/') THEN replace(substr(path, instr(path, 'src/main/groovy/') + 16, length(path) - instr(path, 'src/main/groovy/') - 20), '/', '.')
  WHEN contains(path, 'src/main/kotlin/') THEN replace(substr(path, instr(path, 'src/main/kotlin/') + 16, length(path) - instr(path, 'src/main/kotlin/') - 20), '/', '.')
  WHEN contains(path, '/src/') AND contains(substr(path, instr(path, '/src/') + 5), '/') AND NOT starts_with(substr(path, instr(path, '/src/') + 5), 'test/') AND NOT starts_with(substr(path, instr(path, '/src/') + 5), 'testsrc/')
    THEN replace(substr(path, instr(path, '/src/') + 5, length(path) - instr(path, '/src/') - 9), '/', '.') END"""


@query("f1_p12_changed_classes", f"SELECT DISTINCT {FQN} AS class_fqn FROM {{changed_path}} WHERE ({FQN}) IS NOT NULL")
def _(v):
    return changes.changed_classes(changes.changed_files(v.changed_path.select(F.col("path").alias("line"))))


@query("u1_changed_files", "SELECT DISTINCT path FROM {changed_path}")
def _(v):
    both = v.changed_path.select(F.lit("committed").alias("origin"), F.col("path").alias("line"))
    return changes.changed_files(both.unionByName(v.changed_path.where("ord % 2 = 0").select(F.lit("worktree").alias("origin"), F.col("path").alias("line"))))


CHANGED_TEST = "ct AS (SELECT test_fqn, arg_max(status, ord) AS status FROM (SELECT ord, left(line, 1) AS status, replace(regexp_extract(line, 'src/test/java/(.*)[.]java$', 1), '/', '.') AS test_fqn FROM {name_status}) AS x WHERE test_fqn <> '' GROUP BY test_fqn)"


@query("f2_f6_p13_w7_changed_tests", f"WITH {CHANGED_TEST} SELECT test_fqn, status FROM ct")
def _(v):
    return changes.changed_tests(v.name_status)


PATCH = f"""WITH h AS (SELECT *, max(CASE WHEN starts_with(line, 'diff') THEN line_no END) OVER (PARTITION BY patch_id ORDER BY line_no) AS head FROM {{PATCH_TABLE}}),
  f AS (SELECT h.line, string_split(d.line, ' b/')[-1] AS path FROM h JOIN {{PATCH_TABLE}} AS d ON d.line_no = h.head AND d.patch_id = h.patch_id AND starts_with(d.line, 'diff') WHERE NOT starts_with(h.line, 'diff')),
  m AS (SELECT {FQN} AS class_fqn, regexp_extract(trim(regexp_extract(line, '^@@[ ]+[^@]+@@[ ]*(.*)$', 1)), '(?:public|private|protected|static|final|abstract|synchronized|native|default|[ ])*[a-zA-Z0-9_<>,\\[\\] ]+[ ]+([a-zA-Z0-9_]+)[ ]*[(]', 1) AS m FROM f)
  SELECT DISTINCT concat(class_fqn, '#', m) AS method_fqn FROM m WHERE class_fqn IS NOT NULL AND m <> ''"""


@query("w6_f3_f4_f5_changed_methods", PATCH.replace("PATCH_TABLE", "patch"))
def _(v):
    return changes.changed_methods(v.patch)


@query("w6_one_patch", PATCH.replace("PATCH_TABLE", "one_patch"))
def _(v):
    return changes.changed_methods(v.one_patch)


@query("s9_commit_distance", "SELECT count(*) AS distance FROM {commits} WHERE position > (SELECT max(position) FROM {commits} WHERE commit_id = 'c700')")
def _(v):
    return changes.commit_distance(v.commits, "c700")


REACH = """RECURSIVE reach AS (
    SELECT h.project, h.commit_id AS start, h.commit_id FROM {history} AS h WHERE h.commit_id IN (SELECT head_id FROM {head}) OR h.commit_id IN (SELECT commit_id FROM {map_commit})
    UNION SELECT r.project, r.start, h.parent_id FROM reach AS r JOIN {history} AS h ON h.project = r.project AND h.commit_id = r.commit_id WHERE h.parent_id IS NOT NULL
  ), pairs AS (SELECT m.project, slot, commit_id, head_id, commit_id IN (SELECT h.commit_id FROM {history} AS h WHERE h.project = m.project) AS known FROM {map_commit} AS m JOIN {head} AS t ON t.project = m.project
  ), dist AS (SELECT p.project, slot, p.commit_id, p.head_id, CASE WHEN known THEN (SELECT count(*) FROM reach AS r WHERE r.project = p.project AND r.start = p.head_id AND r.commit_id NOT IN (SELECT q.commit_id FROM reach AS q WHERE q.project = p.project AND q.start = p.commit_id)) END AS distance FROM pairs AS p)"""


@query("s9_commit_graph", f"WITH {REACH} SELECT project, slot, commit_id, head_id, CAST(distance AS BIGINT) AS distance FROM dist")
def _(v):
    return history.commit_distances(v.history, v.map_commit.join(v.head, "project")).select("project", "slot", "commit_id", "head_id", "distance")


@query("s9_commit_graph_to_limit", f"WITH {REACH} SELECT project, slot, CAST(least(distance, 21) AS BIGINT) AS distance FROM dist WHERE distance IS NOT NULL")
def _(v):
    near = history.commit_distances(v.history, v.map_commit.join(v.head, "project"), most=20)
    return near.where("distance is not null").select("project", "slot", "distance")


@query("s9_known_commits", "SELECT project, slot, commit_id FROM {map_commit} AS m WHERE EXISTS (SELECT 1 FROM {history} AS h WHERE h.project = m.project AND h.commit_id = m.commit_id)")
def _(v):
    return history.known_commits(v.history, v.map_commit).select("project", "slot", "commit_id")


@query("w9_nearest_by_history", f"WITH {REACH} SELECT project, slot, CAST(coalesce(distance, 2147483647) AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coalesce(distance, 2147483647), slot = 'local') AS n FROM dist) AS s WHERE n = 1")
def _(v):
    return history.nearest_by_history(v.history, v.map_commit, v.head)


# ---- discovery

KNOWN = "known AS (SELECT DISTINCT split_part(test_name, '#', 1) AS simple FROM {map_test} WHERE instr(test_name, '#') > 1)"
DISK = "disk AS (SELECT DISTINCT replace(regexp_replace(rel_path, '[.]class$', ''), '/', '.') AS class_fqn FROM {class_file} WHERE NOT contains(rel_path, '$'))"
NEW = f"{KNOWN}, {DISK}, fresh AS (SELECT class_fqn FROM disk WHERE regexp_matches(class_fqn, '(Test|Tests|Spec|IT)$') AND string_split(class_fqn, '.')[-1] NOT IN (SELECT simple FROM known))"


@query("j5_p8_p9_new_tests", f"WITH {NEW} SELECT class_fqn FROM fresh")
def _(v):
    return discovery.new_tests(v.class_file, v.map_test)


@query("p23_new_classes_of_any_name", f"WITH {KNOWN}, {DISK} SELECT class_fqn FROM disk WHERE string_split(class_fqn, '.')[-1] NOT IN (SELECT simple FROM known)")
def _(v):
    return discovery.new_tests(v.class_file, v.map_test, any_class=True)


MODIFIED = "modified AS (SELECT test_fqn AS class_fqn FROM ct WHERE string_split(test_fqn, '.')[-1] IN (SELECT string_split(test_fqn, '.')[-1] FROM ct WHERE status IN ('A', 'M')) AND string_split(test_fqn, '.')[-1] IN (SELECT simple FROM known))"


@query("j6_modified_known_tests", f"WITH {KNOWN}, {CHANGED_TEST}, {MODIFIED} SELECT class_fqn FROM modified")
def _(v):
    return discovery.modified_known(changes.changed_tests(v.name_status), v.map_test)


REASON = f"""CASE WHEN contains(text, chr(10) || '@Disabled(') THEN '{discovery.DISABLED}' WHEN contains(text, 'Enclosed.class') THEN '{discovery.ENCLOSED}' WHEN contains(text, chr(10) || 'class ') THEN '{discovery.PACKAGE_PRIVATE}'
  WHEN contains(text, 'System.getenv(') THEN '{discovery.CONDITIONAL}' WHEN contains(text, '@ArchTest') THEN '{discovery.ARCH}' WHEN NOT contains(text, '@Test') THEN '{discovery.NO_TESTS}' END"""


@query("f22_w8_source_reason", f"SELECT class_fqn, {REASON} AS reason FROM {{plain_source}}")
def _(v):
    return v.plain_source.select("class_fqn", discovery.source_reason(F.col("text")).alias("reason"))


@query("p10_not_instantiable", "SELECT class_fqn FROM {plain_source} WHERE contains(text, 'public abstract class') OR contains(text, 'public interface')")
def _(v):
    return v.plain_source.where(discovery.not_instantiable(F.col("text"))).select("class_fqn")


CODE = """split AS (SELECT class_fqn, text, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS raw, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i FROM {commented_source}),
  line AS (SELECT class_fqn, text, i, trim(raw, ' ' || chr(9)) AS x FROM split),
  state AS (SELECT *, last_value(CASE WHEN contains(x, '*/') THEN 0 WHEN starts_with(x, '/*') THEN 1 END IGNORE NULLS) OVER (PARTITION BY class_fqn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM line),
  code AS (SELECT * FROM state WHERE coalesce(inside, 0) = 0 AND NOT starts_with(x, '/*'))"""


@query("w8_f22_commented_reason", f"""WITH {CODE} SELECT s.class_fqn, CASE WHEN bool_or(x IN ('@Disabled', '@Ignore') OR starts_with(x, '@Disabled(') OR starts_with(x, '@Ignore(')) THEN '{discovery.DISABLED}' WHEN bool_or(contains(x, 'Enclosed.class')) THEN '{discovery.ENCLOSED}'
  WHEN bool_or(regexp_matches(x, '^(final +)?class +')) THEN '{discovery.PACKAGE_PRIVATE}' WHEN contains(s.text, 'System.getenv(') THEN '{discovery.CONDITIONAL}' WHEN bool_or(contains(x, '@ArchTest')) THEN '{discovery.ARCH}' WHEN NOT coalesce(bool_or(contains(x, '@Test')), false) THEN '{discovery.NO_TESTS}' END AS reason
  FROM {{commented_source}} AS s LEFT JOIN code ON code.class_fqn = s.class_fqn GROUP BY s.class_fqn, s.text""")
def _(v):
    return v.commented_source.select("class_fqn", discovery.source_reason(F.col("text")).alias("reason"))


@query("w8_p10_commented_kinds", f"""WITH {CODE}, kinds AS (SELECT class_fqn, i, CASE WHEN contains(x, 'abstract class ') OR regexp_matches(x, '\\binterface\\s+\\w+') THEN 1 WHEN starts_with(x, '@') THEN 0 WHEN contains(x, ' class ') THEN 2 ELSE 0 END AS kind FROM code WHERE NOT starts_with(x, 'package '))
  SELECT class_fqn FROM (SELECT class_fqn, arg_min(kind, i) AS kind FROM kinds WHERE kind > 0 GROUP BY class_fqn) AS f WHERE kind = 1""")
def _(v):
    return v.commented_source.where(discovery.not_instantiable(F.col("text"))).select("class_fqn")


@query("j7_d7_unmapped_reasons", f"""WITH {NEW}, {CHANGED_TEST}, {MODIFIED}, told AS (SELECT fresh.class_fqn, CASE status WHEN 'A' THEN '{discovery.NEW}' WHEN 'M' THEN '{discovery.CHANGED}' ELSE coalesce({REASON}, '{discovery.UNKNOWN}') END AS reason
  FROM fresh LEFT JOIN {{plain_source}} AS s ON s.class_fqn = fresh.class_fqn LEFT JOIN ct ON ct.test_fqn = fresh.class_fqn WHERE NOT coalesce(contains(text, 'public abstract class') OR contains(text, 'public interface'), false))
  SELECT class_fqn, reason FROM told UNION ALL SELECT class_fqn, '{discovery.MODIFIED_KNOWN}' FROM modified WHERE class_fqn NOT IN (SELECT class_fqn FROM told)""")
def _(v):
    return discovery.unmapped(v.class_file, v.map_test, changes.changed_tests(v.name_status), v.plain_source)


# ---- coverage

TEST = "(regexp_matches(split_part(string_split(class_fqn, '.')[-1], '$', 1), '(Test|Tests|Spec|IT|TestCase)$') OR starts_with(string_split(class_fqn, '.')[-1], 'Test') OR contains(class_fqn, '.test.') OR contains(class_fqn, '.tests.') OR contains(class_fqn, '.testsrc.') OR contains(class_fqn, '.testframework.'))"


@query("p3_p4_classes_without_tests", f"SELECT test_name, class_fqn FROM {{raw_class}} WHERE NOT {TEST}")
def _(v):
    return coverage.without_test_classes(v.raw_class, v.raw_method)[0]


@query("p4_methods_without_tests", f"WITH d AS (SELECT test_name, class_fqn FROM {{raw_class}} WHERE {TEST}) SELECT test_name, class_fqn, method_fqn FROM {{raw_method}} AS m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.test_name = m.test_name AND d.class_fqn = m.class_fqn)")
def _(v):
    return coverage.without_test_classes(v.raw_class, v.raw_method)[1]


@query("a1_p2_mappings", "SELECT test_name, string_agg(DISTINCT class_fqn, ',' ORDER BY class_fqn) AS classes, string_agg(DISTINCT method_fqn, ',' ORDER BY method_fqn) AS methods FROM {cov} GROUP BY test_name")
def _(v):
    return coverage.mappings(v.cov).select("test_name", F.array_join("classes", ",").alias("classes"), F.array_join("methods", ",").alias("methods"))


METRICS = "metrics AS (SELECT class_fqn, min(line_missed) AS line_missed, max(line_covered) AS line_covered, min(branch_missed) AS branch_missed, max(branch_covered) AS branch_covered FROM {counters} WHERE line_missed + line_covered > 0 GROUP BY class_fqn)"
PCT = f"{METRICS}, pct AS (SELECT class_fqn, CASE WHEN line_missed + line_covered > 0 THEN 100.0::DOUBLE * line_covered / (line_missed + line_covered) ELSE 0 END AS line_pct, CASE WHEN branch_missed + branch_covered > 0 THEN 100.0::DOUBLE * branch_covered / (branch_missed + branch_covered) ELSE 0 END AS branch_pct FROM metrics)"


def _pct(v: Views) -> DataFrame:
    return coverage.percentages(coverage.merge_metrics(v.counters))


@query("a3_p5_p6_merged_metrics", f"WITH {METRICS} SELECT * FROM metrics")
def _(v):
    return coverage.production_metrics(coverage.merge_metrics(v.counters))


@query("a6_percentages", f"WITH {PCT} SELECT * FROM pct")
def _(v):
    return _pct(v)


MERGED = "merged AS (SELECT class_fqn, nr, CAST(greatest(0, arg_min(mi + ci, ord) - max(ci)) AS INT) AS mi, max(ci) AS ci, CAST(greatest(0, arg_min(mb + cb, ord) - max(cb)) AS INT) AS mb, max(cb) AS cb FROM {line_cov} GROUP BY class_fqn, nr)"


@query("a4_merged_lines", f"WITH {MERGED} SELECT * FROM merged")
def _(v):
    return coverage.merge_lines(v.line_cov, "class_fqn")


@query("a5_line_percent", f"WITH {MERGED} SELECT class_fqn, 100.0::DOUBLE * CAST(sum(ci + cb) AS BIGINT) / CAST(sum(ci + mi + cb + mb) AS BIGINT) AS pct, count(*) FILTER (ci > 0) AS lines_hit, count(*) FILTER (ci = 0 AND mi > 0) AS lines_missed FROM merged GROUP BY class_fqn HAVING sum(ci + mi + cb + mb) > 0")
def _(v):
    return coverage.line_percent(coverage.merge_lines(v.line_cov, "class_fqn"), "class_fqn")


@query("w1_a20_method_dictionary", "SELECT method_fqn, row_number() OVER (ORDER BY method_fqn) - 1 AS id FROM (SELECT DISTINCT method_fqn FROM {cov}) AS m")
def _(v):
    return coverage.dictionary(v.cov, "method_fqn")


@query("k2_encoded_classes", "WITH d AS (SELECT class_fqn, row_number() OVER (ORDER BY class_fqn) - 1 AS id FROM (SELECT DISTINCT class_fqn FROM {cov}) AS c) SELECT test_name, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM {cov} AS v JOIN d ON d.class_fqn = v.class_fqn GROUP BY test_name")
def _(v):
    return coverage.encoded(v.cov, coverage.dictionary(v.cov, "class_fqn"), "class_fqn").select("test_name", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# ---- merging


@query("a17_last_wins", "SELECT test_name, arg_max(test_class, file_ord) AS test_class, arg_max(payload, file_ord) AS payload FROM {versions} GROUP BY test_name")
def _(v):
    return merge.last_wins(v.versions)


@query("a18_first_metadata", "SELECT commit_id, distance FROM {ladder_state} WHERE commit_id IS NOT NULL OR distance IS NOT NULL ORDER BY map_id LIMIT 1")
def _(v):
    return merge.first_metadata(v.ladder_state.select(F.col("map_id").alias("file_ord"), "commit_id", "distance"))


@query("j12_replace_test_classes", "SELECT * FROM {base_map} WHERE test_class NOT IN (SELECT test_class FROM {module_map}) UNION ALL SELECT * FROM {module_map}")
def _(v):
    return merge.replace_test_classes(v.base_map, v.module_map)


RESOLVED = "r AS (SELECT test_name, u.class_fqn FROM {map_test} AS m JOIN (SELECT string_split(class_fqn, '.')[-1] AS simple, min(class_fqn) AS class_fqn FROM {unmapped} GROUP BY 1) AS u ON u.simple = m.test_class WHERE test_name NOT IN (SELECT test_name FROM {selected}))"


VERSION = "test_name string, test_class string, payload bigint"


@query("j12_store_merge", "SELECT * FROM {base_map} WHERE test_class NOT IN (SELECT test_class FROM {module_map}) UNION ALL SELECT * FROM {module_map}")
def _(v):
    path = shared_path(v.spark, "store")
    store.merge(path, v.base_map, source="base", batch=0)
    for _ in range(2):  # the second time changes nothing
        store.merge(path, v.module_map, source="module", batch=0)
    return store.read(v.spark, path, VERSION)


@query("a17_store_by_test", "SELECT test_name, test_class, payload FROM (SELECT test_name, test_class, payload, 1 AS k FROM {module_map} UNION ALL SELECT test_name, test_class, payload, 0 FROM {base_map} WHERE test_name NOT IN (SELECT test_name FROM {module_map})) AS u")
def _(v):
    path = shared_path(v.spark, "store")
    store.merge(path, v.base_map)
    store.merge(path, v.module_map, how=store.replace_tests)
    return store.read(v.spark, path, VERSION)


@query("a3_store_of_counters", f"WITH {METRICS} SELECT * FROM metrics")
def _(v):
    path, columns = shared_path(v.spark, "store"), ["class_fqn", *coverage.FIELDS]
    for rest in range(3):
        store.merge(path, coverage.merge_metrics(v.counters.where(F.col("ord") % 3 == rest)).select(columns), key="class_fqn", how=store.merge_counters)
    return store.read(v.spark, path, "class_fqn string, " + ", ".join(f"{c} int" for c in coverage.FIELDS))


@query("j11_enriched_tests", f"WITH {RESOLVED} SELECT test_name FROM {{selected}} UNION SELECT test_name FROM r")
def _(v):
    return merge.enrich(v.selected, v.unmapped, v.map_test)[0]


@query("j11_still_unmapped", f"WITH {RESOLVED} SELECT class_fqn FROM {{unmapped}} WHERE class_fqn NOT IN (SELECT class_fqn FROM r)")
def _(v):
    return merge.enrich(v.selected, v.unmapped, v.map_test)[1]


BY_FQN = "by_fqn AS (SELECT replace(regexp_replace(rel_path, '[.]class$', ''), '/', '.') AS class_key, arg_min(module, (ord, module)) AS module FROM {class_file} WHERE packaging <> 'pom' GROUP BY 1)"
BY_NAME = "by_name AS (SELECT string_split(replace(regexp_replace(rel_path, '[.]class$', ''), '/', '.'), '.')[-1] AS class_key, arg_min(module, (ord, module)) AS module FROM {class_file} WHERE packaging <> 'pom' GROUP BY 1)"
CHANGED_MODULE = "cm AS (SELECT c.class_fqn, arg_min(module, (ord, module)) AS module FROM {changed_class} AS c JOIN {prod_file} AS f ON f.rel_path = concat(replace(c.class_fqn, '.', '/'), '.class') WHERE packaging <> 'pom' GROUP BY c.class_fqn)"


@query("j8_p22_changed_modules", f"WITH {CHANGED_MODULE} SELECT * FROM cm")
def _(v):
    return merge.changed_modules(v.changed_class, v.prod_file)


@query("j9_w5_test_modules", f"WITH {BY_NAME} SELECT * FROM by_name")
def _(v):
    return merge.test_modules(v.class_file, by_name=True)


@query("j21_first_directory", f"WITH {BY_FQN} SELECT * FROM by_fqn")
def _(v):
    return merge.test_modules(v.class_file)


@query("j10_unmapped_of_modules", f"WITH {BY_FQN} SELECT module, class_fqn FROM {{unmapped}} JOIN by_fqn ON class_key = class_fqn WHERE module IN ('mod1', 'mod2')")
def _(v):
    return merge.unmapped_of_modules(v.unmapped, v.class_file, v.class_file.where("module in ('mod1', 'mod2')"))


@query("j20_affected_modules", f"WITH {BY_FQN}, {BY_NAME}, {CHANGED_MODULE} SELECT DISTINCT module FROM {{selected}} JOIN by_name ON class_key = split_part(test_name, '#', 1) UNION SELECT module FROM {{unmapped}} JOIN by_fqn ON class_key = class_fqn WHERE module IN (SELECT module FROM cm)")
def _(v):
    return merge.affected_modules(v.selected, v.unmapped, v.changed_class, v.class_file, v.prod_file)


@query("j19_p21_pruned_selection", "SELECT test_name FROM {selected} WHERE concat(test_name, '.xml') IN (SELECT file_name FROM {xml_file}) OR concat('session_', test_name, '.xml') IN (SELECT file_name FROM {xml_file})")
def _(v):
    return merge.prune(v.selected, v.xml_file)


@query("p24_stale_artifacts", "SELECT DISTINCT file_name FROM {artifact} AS a JOIN (SELECT DISTINCT split_part(test_name, '#', 1) AS c FROM {selected}) AS s ON contains(file_name, c)")
def _(v):
    return merge.stale_artifacts(v.artifact, v.selected.select(sf.test_class(F.col("test_name")).alias("test_class")))


@query("a16_run_summary", "SELECT module, count(*) AS total, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('PASSED', 'FAILED')) AS skipped, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS duration_ms FROM {test_metric} GROUP BY module")
def _(v):
    return merge.run_summary(v.test_metric, "module")


@query("a23_status_counts", "SELECT status, count(*) AS n FROM {test_metric} GROUP BY status")
def _(v):
    return merge.status_counts(v.test_metric)


@query("f18_f19_failures", "SELECT name, CASE WHEN failure_class LIKE '%AssertionFailedError%' THEN 'ASSERTION' WHEN failure_class LIKE '%TimeoutException%' THEN 'TIMEOUT' WHEN failure_class IS NOT NULL THEN 'EXCEPTION' END AS failure, CASE WHEN failure_class IS NOT NULL THEN 'FAILED' WHEN status = 'PASSED' THEN 'PASSED' ELSE 'FAILED' END AS status FROM {test_metric}")
def _(v):
    return v.test_metric.select("name", sf.failure_type(F.col("failure_class")).alias("failure"), sf.metric_status(F.col("failure_class").isNotNull(), F.col("status") == "PASSED").alias("status"))


# ---- exploring


@query("a7_statistics", """WITH n AS (SELECT m.test_name, count(DISTINCT class_fqn) AS n FROM {map_test} AS m LEFT JOIN {cov_class} AS c ON c.test_name = m.test_name GROUP BY 1)
  SELECT count(*) AS tests, (SELECT count(DISTINCT class_fqn) FROM {cov_class}) AS classes, (SELECT count(DISTINCT method_fqn) FROM {cov_method}) AS methods, min(n) AS min_classes, max(n) AS max_classes, printf('%.1f', avg(n)) AS avg_classes FROM n""")
def _(v):
    return explore.statistics(v.map_test, v.cov_class, v.cov_method)


@query("p14_query_test", "SELECT DISTINCT class_fqn FROM {cov_class} WHERE test_name = 'Suite7Test#t7'")
def _(v):
    return explore.by_test(v.cov_class, "Suite7Test#t7", "class_fqn")


@query("p14_similar_tests", "SELECT DISTINCT test_name FROM {map_test} WHERE contains(test_name, 'Suite7')")
def _(v):
    return explore.similar_tests(v.map_test, "Suite7")


BRAND = "com.standard.Brand13"


@query("p15_t1_query_class", f"SELECT DISTINCT test_name FROM {{cov_class}} WHERE class_fqn = '{BRAND}'")
def _(v):
    return explore.by_class(v.cov_class, BRAND)


@query("p15_t3_similar_classes", "SELECT DISTINCT class_fqn FROM (SELECT test_name, arg_min(class_fqn, pos) AS class_fqn FROM {cov_class} WHERE contains(class_fqn, 'Brand1') GROUP BY 1) AS f ORDER BY class_fqn LIMIT 20")
def _(v):
    return explore.similar_classes(v.cov_class, "Brand1")


@query("p16_query_method", f"SELECT DISTINCT test_name FROM {{cov_method}} WHERE method_fqn = '{BRAND}#m7'")
def _(v):
    return explore.by_method(v.cov_method, f"{BRAND}#m7")


@query("p17_f29_grep", "SELECT DISTINCT 'test' AS kind, test_name AS name FROM {map_test} WHERE contains(lower(test_name), 't7') UNION SELECT 'class', class_fqn FROM {cov_class} WHERE contains(lower(class_fqn), 't7') UNION SELECT 'method', method_fqn FROM {cov_method} WHERE contains(lower(method_fqn), 't7')")
def _(v):
    return explore.grep(v.map_test, v.cov_class, v.cov_method, "T7")


# ---- the same questions to stored postings


def _postings(v: Views, *columns: str) -> tuple[DataFrame, ...]:
    """(ids, postings of a column, ...) of the derived coverage, stored below the shared folder."""
    path = shared_path(v.spark, "postings")
    postings.test_numbers(v.map_test).write.parquet(f"{path}/ids")
    ids = v.spark.read.parquet(f"{path}/ids")
    for c in columns:
        postings.store(postings.postings(v.cov_class if c == "class_fqn" else v.cov_method, ids, c), f"{path}/{c}")
    return ids, *(postings.load(v.spark, f"{path}/{c}") for c in columns)


def _trigrams(v: Views, names: DataFrame) -> str:
    path = shared_path(v.spark, "trigrams")
    trigrams.store(names, path)
    return path


@query("sel_by_postings", f"WITH {PICK} SELECT test_name, matched_by FROM picked")
def _(v):
    ids, classes, methods = _postings(v, "class_fqn", "method_fqn")
    return postings.select_tests(methods, classes, ids, v.changed_method, v.changed_class)


@query("j16_by_postings", "WITH k AS (SELECT DISTINCT class_fqn FROM {cov_class} WHERE test_name IN (SELECT test_name FROM {selected})) SELECT test_name, arg_min(class_fqn, pos) AS class_fqn FROM {cov_class} WHERE class_fqn IN (SELECT class_fqn FROM k) AND test_name NOT IN (SELECT test_name FROM {selected}) GROUP BY test_name")
def _(v):
    ids, classes = _postings(v, "class_fqn")
    return postings.closure(classes, ids, v.selected)


@query("p17_grep_by_trigrams", "SELECT DISTINCT 'test' AS kind, test_name AS name FROM {map_test} WHERE contains(lower(test_name), 'brand1') UNION SELECT 'class', class_fqn FROM {cov_class} WHERE contains(lower(class_fqn), 'brand1') UNION SELECT 'method', method_fqn FROM {cov_method} WHERE contains(lower(method_fqn), 'brand1')")
def _(v):
    return trigrams.search(v.spark, _trigrams(v, trigrams.names_of(v.map_test, v.cov_class, v.cov_method)), "BRAND1")


@query("p14_similar_by_trigrams", "SELECT DISTINCT test_name AS name FROM {map_test} WHERE contains(test_name, 'Suite7')")
def _(v):
    return trigrams.search(v.spark, _trigrams(v, trigrams.names_of(v.map_test, v.cov_class, v.cov_method)), "Suite7", "test", ignore_case=False).select("name")


@query("p15_similar_by_trigrams", "SELECT DISTINCT class_fqn FROM (SELECT test_name, arg_min(class_fqn, pos) AS class_fqn FROM {cov_class} WHERE contains(class_fqn, 'Brand1') GROUP BY 1) AS f ORDER BY class_fqn LIMIT 20")
def _(v):
    path = _trigrams(v, v.cov_class.select(F.lit("class").alias("kind"), F.col("class_fqn").alias("name")).distinct())
    return trigrams.similar_classes(v.spark, path, _postings(v, "class_fqn")[1], "Brand1")


# ---- report

EXPANDED = "expanded AS (SELECT test_name, test_class, CASE WHEN test_name IN (SELECT test_name FROM {selected}) THEN 'selected' ELSE 'added' END AS kind FROM {map_test} WHERE test_class IN (SELECT split_part(test_name, '#', 1) FROM {selected}))"
RELEVANT = "relevant AS (SELECT class_fqn FROM {changed_class} UNION SELECT split_part(method_fqn, '#', 1) FROM {changed_method})"
COUNTS = f"{RELEVANT}, counts AS (SELECT r.class_fqn, count(DISTINCT test_name) AS tests FROM relevant AS r LEFT JOIN {{cov_class}} AS c ON c.class_fqn = r.class_fqn GROUP BY 1)"


@query("j14_class_expansion", f"WITH {EXPANDED} SELECT * FROM expanded")
def _(v):
    return report.class_expansion(v.map_test, v.selected)


@query("a19_expansion_totals", f"WITH {EXPANDED} SELECT test_class, count(*) FILTER (kind = 'selected') AS selected, count(*) AS executed FROM expanded GROUP BY 1")
def _(v):
    return report.expansion_totals(report.class_expansion(v.map_test, v.selected))


@query("a10_f28_cards", f"""WITH {EXPANDED}, t AS (SELECT count(*) AS total FROM {{map_test}}), e AS (SELECT count(*) FILTER (kind = 'selected') AS selected, count(*) FILTER (kind = 'added') AS added FROM expanded)
  SELECT total, selected, added, total - selected - added AS skipped, printf('%.0f', CAST(100 AS DOUBLE) * (total - selected - added) / total) AS reduction, (SELECT count(*) FROM {{changed_class}}) AS changed_classes, (SELECT count(*) FROM {{changed_method}}) AS changed_methods FROM t, e""")
def _(v):
    return report.cards(v.map_test, report.class_expansion(v.map_test, v.selected), v.changed_class, v.changed_method)


@query("a11_histogram", f"WITH {PCT} SELECT count(*) FILTER (line_pct = 0) AS none, count(*) FILTER (line_pct > 0 AND line_pct < 50) AS low, count(*) FILTER (line_pct >= 50 AND line_pct < 75) AS middle, count(*) FILTER (line_pct >= 75) AS good FROM pct")
def _(v):
    return report.histogram(_pct(v))


@query("p18_metrics_filter", f"WITH {PCT} SELECT * FROM pct WHERE line_pct >= 75")
def _(v):
    return report.metrics_filter(_pct(v), "good")


@query("t4_t7_f15_worst_first", f"WITH {PCT} SELECT *, CASE WHEN line_pct > 75 THEN 'green' WHEN line_pct >= 50 THEN 'yellow' ELSE 'red' END AS colour FROM pct")
def _(v):
    return report.worst_first(_pct(v))


@query("u3_relevant_classes", f"WITH {RELEVANT} SELECT * FROM relevant")
def _(v):
    return report.relevant_classes(v.changed_class, v.changed_method)


@query("a12_covering_counts", f"WITH {COUNTS} SELECT * FROM counts")
def _(v):
    return report.covering_counts(v.cov_class, report.relevant_classes(v.changed_class, v.changed_method))


@query("t2_top_classes", f"WITH {COUNTS} SELECT * FROM counts ORDER BY tests DESC, class_fqn LIMIT 10")
def _(v):
    return report.top_classes(report.covering_counts(v.cov_class, report.relevant_classes(v.changed_class, v.changed_method)))


@query("a13_changed_code", f"WITH {RELEVANT} SELECT r.class_fqn, coalesce(string_agg(DISTINCT split_part(method_fqn, '#', 2), ',' ORDER BY split_part(method_fqn, '#', 2)), '') AS methods FROM relevant AS r LEFT JOIN {{changed_method}} AS m ON split_part(m.method_fqn, '#', 1) = r.class_fqn GROUP BY 1")
def _(v):
    return report.changed_code(v.changed_class, v.changed_method).select("class_fqn", F.array_join("methods", ",").alias("methods"))


@query("j15_matrix", "SELECT test_name, class_fqn, pos FROM {cov_class} WHERE test_name IN (SELECT test_name FROM {selected})")
def _(v):
    return report.matrix(v.cov_class, v.selected).select("test_name", "class_fqn", "pos")


@query("j16_closure", "WITH k AS (SELECT DISTINCT class_fqn FROM {cov_class} WHERE test_name IN (SELECT test_name FROM {selected})) SELECT test_name, arg_min(class_fqn, pos) AS class_fqn FROM {cov_class} WHERE class_fqn IN (SELECT class_fqn FROM k) AND test_name NOT IN (SELECT test_name FROM {selected}) GROUP BY test_name")
def _(v):
    return report.closure(v.cov_class, v.selected)


@query("a21_class_tests", "SELECT class_fqn, string_agg(DISTINCT test_name, ',' ORDER BY test_name) AS tests FROM {cov_class} GROUP BY class_fqn")
def _(v):
    return report.class_tests(v.cov_class).select("class_fqn", F.array_join("tests", ",").alias("tests"))


BLOCKS = 100


@query("a21_test_blocks", f"SELECT class_fqn, block, block * {BLOCKS} AS first, string_agg(test_name, ',' ORDER BY n) AS tests FROM (SELECT *, n // {BLOCKS} AS block FROM (SELECT class_fqn, test_name, row_number() OVER (PARTITION BY class_fqn ORDER BY test_name) - 1 AS n FROM (SELECT DISTINCT class_fqn, test_name FROM {{cov_class}}) AS d) AS r) AS b GROUP BY class_fqn, block")
def _(v):
    return report.class_test_blocks(v.cov_class, BLOCKS).select("class_fqn", "block", "first", F.array_join("values", ",").alias("tests"))


@query("a22_reason_blocks", f"""WITH {PICK}, r AS (SELECT test_name, 0 AS k, pos, concat('covers changed method ', split_part(method_fqn, '#', 2)) AS t FROM {{cov_method}} WHERE method_fqn IN (SELECT method_fqn FROM {{changed_method}})
  UNION ALL SELECT test_name, 1, pos, concat('covers changed class ', string_split(class_fqn, '.')[-1]) FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM conly)),
  n AS (SELECT p.test_name, coalesce(t, 'Selected by coverage match') AS t, row_number() OVER (PARTITION BY p.test_name ORDER BY k, pos, t) - 1 AS n FROM picked AS p LEFT JOIN r ON r.test_name = p.test_name)
  SELECT test_name, n // 2 AS block, string_agg(t, '; ' ORDER BY n) AS reason FROM n GROUP BY test_name, n // 2""")
def _(v):
    found = report.reason_blocks(v.cov_method, v.cov_class, v.changed_method, v.changed_class, _selected(v), 2)
    return found.select("test_name", "block", F.array_join("values", "; ").alias("reason"))


@query("j13_link_blocks", f"WITH {PCT}, n AS (SELECT test_name, c.class_fqn, row_number() OVER (PARTITION BY test_name ORDER BY c.class_fqn) - 1 AS n FROM (SELECT DISTINCT test_name, class_fqn FROM {{cov_class}}) AS c JOIN pct ON pct.class_fqn = c.class_fqn) SELECT test_name, n // 3 AS block, string_agg(class_fqn, ',' ORDER BY n) AS classes FROM n GROUP BY test_name, n // 3")
def _(v):
    return report.link_blocks(v.cov_class, _pct(v), "line_pct", 3).select("test_name", "block", F.array_join("values.class_fqn", ",").alias("classes"))


@query("j17_j18_source_lines", f"""WITH {MERGED} SELECT s.key, s.nr, s.text, CASE WHEN ci > 0 THEN 'hit' WHEN mi > 0 THEN 'missed' ELSE 'none' END AS hit, CASE WHEN coalesce(cb + mb, 0) = 0 THEN 'none' WHEN mb = 0 THEN 'full' WHEN cb = 0 THEN 'missed' ELSE 'partial' END AS branches
  FROM {{src_line}} AS s LEFT JOIN merged ON merged.class_fqn = s.key AND merged.nr = s.nr""")
def _(v):
    return report.source_lines(v.src_line, coverage.merge_lines(v.line_cov, "class_fqn").withColumnRenamed("class_fqn", "key"))


@query("a22_selection_reasons", f"""WITH {PICK}, r AS (SELECT test_name, 0 AS k, pos, concat('covers changed method ', split_part(method_fqn, '#', 2)) AS t FROM {{cov_method}} WHERE method_fqn IN (SELECT method_fqn FROM {{changed_method}})
  UNION ALL SELECT test_name, 1, pos, concat('covers changed class ', string_split(class_fqn, '.')[-1]) FROM {{cov_class}} WHERE class_fqn IN (SELECT class_fqn FROM conly))
  SELECT p.test_name, coalesce(string_agg(t, '; ' ORDER BY k, pos), 'Selected by coverage match') AS reason FROM picked AS p LEFT JOIN r ON r.test_name = p.test_name GROUP BY p.test_name""")
def _(v):
    return report.reasons(v.cov_method, v.cov_class, v.changed_method, v.changed_class, _selected(v))


CHUNK = f"chunk AS (SELECT test_name, row_number() OVER (ORDER BY test_name) - 1 AS row, CAST(floor((row_number() OVER (ORDER BY test_name) - 1) / {CHUNK_TESTS}) AS BIGINT) AS chunk FROM {{map_test}})"


@query("w2_chunks", f"WITH {CHUNK} SELECT * FROM chunk")
def _(v):
    return report.chunked(v.map_test)


@query("w3_page", f"WITH {CHUNK} SELECT * FROM chunk WHERE chunk = least(3, (SELECT max(chunk) FROM chunk))")
def _(v):
    return report.page(report.chunked(v.map_test), 3)


@query("w3_last_page", f"WITH {CHUNK} SELECT * FROM chunk WHERE chunk = (SELECT max(chunk) FROM chunk)")
def _(v):
    return report.page(report.chunked(v.map_test), 10**6)


@query("t6_inline_tests", "SELECT DISTINCT test_name FROM {map_test} ORDER BY test_name LIMIT 200")
def _(v):
    return report.inline(v.map_test)


INDEX = f"""{CHUNK}, c AS (SELECT test_name, count(*) AS cc, left(string_agg(string_split(class_fqn, '.')[-1], ' ' ORDER BY pos), 500) AS c FROM {{cov_class}} GROUP BY 1), m AS (SELECT test_name, count(*) AS mc, left(string_agg(split_part(method_fqn, '#', 2), ' ' ORDER BY pos), 500) AS m FROM {{cov_method}} GROUP BY 1),
  idx AS (SELECT chunk.test_name AS t, chunk.test_name IN (SELECT test_name FROM {{selected}}) AS s, CAST(coalesce(cc, 0) AS INT) AS cc, CAST(coalesce(mc, 0) AS INT) AS mc, coalesce(c, '') AS c, coalesce(m, '') AS m, chunk AS k FROM chunk LEFT JOIN c ON c.test_name = chunk.test_name LEFT JOIN m ON m.test_name = chunk.test_name)"""


@query("m14_f17_f25_search_index", f"WITH {INDEX} SELECT * FROM idx")
def _(v):
    return report.search_index(report.chunk_rows(v.map_test, v.cov_class, v.cov_method, v.selected))


@query("p19_p20_section_search", f"WITH {INDEX} SELECT * FROM idx WHERE s AND (contains(lower(c), 'brand11') OR contains(lower(m), 'brand11'))")
def _(v):
    return explore.section_search(report.search_index(report.chunk_rows(v.map_test, v.cov_class, v.cov_method, v.selected)), "Brand11", classes=True, methods=True, selected_only=True)


@query("p20_search_by_trigrams", f"WITH {INDEX} SELECT * FROM idx WHERE s AND (contains(lower(c), 'brand11') OR contains(lower(m), 'brand11'))")
def _(v):
    rows = pinned(report.search_index(report.chunk_rows(v.map_test, v.cov_class, v.cov_method, v.selected)))
    return trigrams.section_search(rows, _trigrams(v, trigrams.texts_of(rows)), "Brand11", "classes", "methods", selected_only=True)


@query("k8_t5_j13_chunk_rows", """WITH c AS (SELECT test_name, string_agg(class_fqn, ',' ORDER BY pos) AS classes FROM {cov_class} GROUP BY 1), r AS (SELECT DISTINCT class_fqn FROM {counters} WHERE line_missed + line_covered > 0),
  n AS (SELECT test_name, count(*) AS rated FROM (SELECT DISTINCT test_name, class_fqn FROM {cov_class}) AS x WHERE class_fqn IN (SELECT class_fqn FROM r) GROUP BY 1) SELECT m.test_name AS t, coalesce(classes, '') AS classes, coalesce(rated, 0) AS rated FROM {map_test} AS m LEFT JOIN c ON c.test_name = m.test_name LEFT JOIN n ON n.test_name = m.test_name""")
def _(v):
    rows = report.chunk_rows(v.map_test, v.cov_class, v.cov_method, v.selected, pcts=_pct(v).select("class_fqn", F.col("line_pct").alias("pct")))
    return rows.select("t", F.array_join("classes", ",").alias("classes"), F.coalesce(F.size("cp"), F.lit(0)).cast("long").alias("rated"))


@query("a14_ant_string", """WITH c AS (SELECT split_part(test_name, '#', 1) AS c, string_agg(DISTINCT split_part(test_name, '#', 2), '+' ORDER BY split_part(test_name, '#', 2)) AS ms FROM {selected} GROUP BY 1), t AS (SELECT 0 AS k, c, concat(c, '#', ms) AS t FROM c UNION ALL SELECT DISTINCT 1, class_fqn, class_fqn FROM {unmapped})
  SELECT string_agg(t, ',' ORDER BY k, c) AS line FROM t""")
def _(v):
    return report.ant_string(v.selected, v.unmapped)


# ---- scalar batteries


@query("f7_f8_f9_file_names", "SELECT test_name, concat('Suite#', regexp_replace(test_class, '([A-Z])', '~\\1', 'g')) AS escaped, concat('Suite#', test_class) AS back, concat(test_name, '') AS from_file FROM {map_test}")
def _(v):
    escaped = sf.escape_file_name(F.concat(F.lit("Suite#"), "test_class"))
    file = F.concat(F.lit("session_"), F.replace("test_name", F.lit("#"), F.lit("%23")), F.lit(".xml"))
    return v.map_test.select("test_name", escaped.alias("escaped"), sf.unescape_file_name(escaped).alias("back"), sf.test_of_file(file).alias("from_file"))


@query("f10_session_ids", """WITH c AS (SELECT DISTINCT class_fqn, method_fqn FROM {cov}), h AS (SELECT class_fqn, method_fqn, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(concat(class_fqn, '#', split_part(method_fqn, '#', 2)), ''), lambda x: ascii(x)::HUGEINT)), lambda a, x: (a * 31 + x) % 4294967296) & 2147483647 AS h FROM c)
  SELECT method_fqn, concat(string_split(class_fqn, '.')[-1], '#', split_part(method_fqn, '#', 2), '_', left(lpad(lower(to_hex(h::BIGINT)), 7, '0'), 7)) AS session FROM h""")
def _(v):
    return v.cov.select("class_fqn", "method_fqn").distinct().select("method_fqn", sf.session_id(sf.short_class(F.col("class_fqn")), F.substring_index("method_fqn", "#", -1), F.col("class_fqn")).alias("session"))


@query("f11_f12_f13_f14_f24_names", "SELECT DISTINCT method_fqn, split_part(method_fqn, '#', 1) AS class_fqn, string_split(class_fqn, '.')[-1] AS short, left(class_fqn, length(class_fqn) - length(string_split(class_fqn, '.')[-1])) AS package, split_part(method_fqn, '#', 2) AS method, replace(class_fqn, '.', '/') AS path, left(class_fqn, 7) AS seven FROM {cov}")
def _(v):
    package, short, method = sf.test_parts(F.col("method_fqn"))
    return v.cov.select("method_fqn", sf.class_of_method(F.col("method_fqn")).alias("class_fqn"), short.alias("short"), package.alias("package"), method.alias("method"), sf.to_slashes(F.col("class_fqn")).alias("path"), sf.short_commit(F.col("class_fqn")).alias("seven")).distinct()


@query("f17_f21_f16_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS message, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, printf('%.1f', n_chars / 7) AS shown FROM {documents}")
def _(v):
    return v.documents.select("doc_id", sf.shortened(F.col("text"), 200, "...").alias("message"), sf.html_escape(F.col("text")).alias("html"), sf.one_decimal(F.col("n_chars") / 7).alias("shown"))


@query("f27_pruned_reason", "SELECT map_id, concat(changes, ' tests selected out of ', distance, ' total (', tests, ' removed: no longer in source)') AS reason FROM {ladder_state}")
def _(v):
    old = F.concat(F.col("distance").cast("string"), F.lit(" tests selected out of "), F.col("distance").cast("string"), F.lit(" total"))
    return v.ladder_state.select("map_id", sf.pruned_reason(old, F.col("changes"), F.col("tests")).alias("reason"))


@query("f23_contexts", "SELECT map_id, CASE WHEN NOT (tests = 1 OR tests = 2) THEN 'local' WHEN changes = 1 OR changes = 2 THEN 'ci-pr' ELSE 'ci-main' END AS context FROM {ladder_state}")
def _(v):
    set_if = lambda column, at, name: F.when(F.col(column) == at, F.array(F.struct(F.lit(name).alias("k"), F.lit("").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    given = (("tests", 1, "CI"), ("tests", 2, "JENKINS_URL"), ("changes", 1, "CHANGE_ID"), ("changes", 2, "GITHUB_PR_NUMBER"), ("changes", 0, "PATH"))
    return v.ladder_state.select("map_id", sf.context_of(F.map_from_entries(F.concat(*(set_if(*x) for x in given)))).alias("context"))


@query("f34_prefer_modes", "SELECT map_id, CASE WHEN tests = 0 THEN 'REMOTE' WHEN tests = 1 THEN 'LOCAL' ELSE 'NEAREST' END AS prefer FROM {ladder_state}")
def _(v):
    text = F.element_at(F.array(F.lit(" remote"), F.lit("Local "), F.lit("nearest"), F.lit("other"), F.lit(None).cast("string")), F.col("tests") + 1)
    return v.ladder_state.select("map_id", sf.prefer_of(text).alias("prefer"))


@query("f20_json_strings", "SELECT doc_id, CAST(to_json(concat(source, chr(9), '\"', text, '\\')) AS VARCHAR) AS json FROM {documents}")
def _(v):
    return v.documents.select("doc_id", sf.json_string(F.concat("source", F.lit("\t\""), "text", F.lit("\\"))).alias("json"))


@query("k13_answers", """WITH a AS (SELECT 'test' AS kind, test_name AS name FROM {selected} UNION SELECT 'test', class_fqn FROM {unmapped} UNION SELECT 'class', class_fqn FROM {changed_class} UNION SELECT 'method', method_fqn FROM {changed_method}),
  f AS (SELECT 'test' AS kind, m.test_name AS name, count(DISTINCT class_fqn) AS n FROM {map_test} AS m LEFT JOIN {cov_class} AS c ON c.test_name = m.test_name GROUP BY 2 UNION ALL SELECT 'class', class_fqn, count(DISTINCT test_name) FROM {cov_class} GROUP BY 2 UNION ALL SELECT 'method', method_fqn, count(DISTINCT test_name) FROM {cov_method} GROUP BY 2)
  SELECT a.kind, a.name, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS exit_code FROM a LEFT JOIN f ON f.kind = a.kind AND f.name = a.name""")
def _(v):
    ask = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    asked = ask("test", v.selected, "test_name").unionByName(ask("test", v.unmapped, "class_fqn")).unionByName(ask("class", v.changed_class, "class_fqn")).unionByName(ask("method", v.changed_method, "method_fqn"))
    return explore.answers(asked, v.map_test, v.cov_class, v.cov_method)


# ---- files: written to the shared folder and read back


def _map_tables(v: Views) -> dict[str, DataFrame]:
    meta = v.commits.agg(F.max_by("commit_id", "position").alias("commit_id")).select(F.lit("main").alias("base_branch"), "commit_id", F.lit("2024-01-01T00:00:00Z").alias("ts"))
    return {"map_meta": meta, "map_test": v.map_test, "cov_class": v.cov_class, "cov_method": v.cov_method, "class_metrics": coverage.merge_metrics(v.counters)}


def _stored_map(v: Views, write, gzip: bool = False) -> dict[str, DataFrame]:
    path = shared_path(v.spark, "map")
    write(_map_tables(v), path, gzip)
    return maps.read_tables(v.spark, path)


@query("s3_k1_plain_map", "SELECT test_name, class_fqn, method_fqn, pos FROM {cov_method}")
def _(v):
    return _stored_map(v, sinks.write_plain_map)["cov_method"].select("test_name", "class_fqn", "method_fqn", (F.col("pos") + 1).cast("long").alias("pos"))


@query("s4_k2_indexed_map", "SELECT test_name, class_fqn, pos FROM {cov_class}")
def _(v):
    return _stored_map(v, sinks.write_indexed_map)["cov_class"].select("test_name", "class_fqn", (F.col("pos") + 1).cast("long").alias("pos"))


@query("s5_k3_gzip_map", "SELECT test_name, test_class FROM {map_test}")
def _(v):
    return _stored_map(v, sinks.write_indexed_map, gzip=True)["map_test"].select("test_name", "test_class")


@query("s6_map_metadata", "SELECT 'main' AS \"baseBranch\", arg_max(commit_id, position) AS \"commitId\", '2024-01-01T00:00:00Z' AS \"timestamp\" FROM {commits}")
def _(v):
    path = shared_path(v.spark, "map")
    sinks.write_plain_map(_map_tables(v), path)
    return maps.read_metadata(v.spark, path)


@query("s7_k4_selection", "SELECT 'SELECTED' AS status, test_name FROM {selected} UNION ALL SELECT 'UNMAPPED', class_fqn FROM {unmapped}")
def _(v):
    path = shared_path(v.spark, "selection")
    tests = v.selected.agg(F.array_sort(F.collect_list("test_name")).alias("selectedTests"))
    unmapped = v.unmapped.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_fqn", F.lit("new"))))).alias("unmappedTests"))
    sinks.write_selection(tests.crossJoin(unmapped).select(F.lit("SELECTED").alias("status"), F.lit("").alias("reason"), "selectedTests", "unmappedTests", F.array().cast("array<string>").alias("changedClasses")), path)
    read = reports.read_selection(v.spark, path)
    return read.select("status", F.explode("selectedTests").alias("test_name")).unionByName(read.select(F.lit("UNMAPPED").alias("status"), F.explode(F.map_keys("unmappedTests")).alias("test_name")))


@query("s13_k12_f31_metrics", "SELECT module, name, status, duration_ms, failure_class AS failure_type FROM {test_metric}")
def _(v):
    path = shared_path(v.spark, "metrics")
    metric = v.test_metric.select("module", "name", "status", "duration_ms", F.col("failure_class").alias("failure_type"), F.lit(None).cast("string").alias("failure_message"))
    sinks.write_metrics(metric, path, "run-1", "abc1234", "main", "local", "2024-01-01T00:00:00Z")
    return reports.read_tests(v.spark, [path]).select("t.module", "t.name", "t.status", F.col("t.durationMs").alias("duration_ms"), F.col("t.failureType").alias("failure_type"))


def _report_trees(v: Views) -> DataFrame:
    """A report a test: a class for each that the map has, with a method of as many covered instructions as its number, less those divisible by 3."""
    counter = lambda kind, n: F.array(F.struct(F.lit(kind).alias("_type"), F.lit(0).alias("_missed"), n.cast("int").alias("_covered")))
    number = F.regexp_extract("method_fqn", "#m([0-9]+)$", 1).cast("int")
    methods = v.cov_method.select("test_name", "class_fqn", F.struct(F.element_at(F.split("method_fqn", "#"), 2).alias("_name"), F.lit("()V").alias("_desc"), F.lit(1).alias("_line"), counter("INSTRUCTION", F.when(number % 3 == 0, 0).otherwise(number)).alias("counter")).alias("m"), number.alias("n"))
    classes = methods.groupBy("test_name", "class_fqn").agg(F.array_sort(F.collect_list("m")).alias("method"), F.max(F.when(F.col("n") % 3 == 0, 0).otherwise(1)).alias("hit"))
    own = classes.select("test_name", F.struct(F.translate("class_fqn", ".", "/").alias("_name"), F.lit("A.java").alias("_sourcefilename"), "method", counter("LINE", F.col("hit")).alias("counter")).alias("c"))
    package = own.groupBy("test_name").agg(F.array(F.struct(F.lit("com").alias("_name"), F.array_sort(F.collect_list("c")).alias("class"))).alias("package"))
    return package.select(F.lit("report").alias("_name"), F.array(F.struct(F.col("test_name").alias("_id"), F.lit(0).cast("long").alias("_start"), F.lit(0).cast("long").alias("_dump"))).alias("sessioninfo"), "package")


def _stored_reports(v: Views, trees: DataFrame) -> DataFrame:
    """Report trees written and read; many share a file, so that the test comes from the session in place of the file's name."""
    path = shared_path(v.spark, "reports")
    sinks.write_reports(trees.withColumn("test_name", F.lit("")), path)
    return reports.read_reports(v.spark, path).withColumn("test_name", F.col("sessioninfo")[0]["_id"])


@query("s1_k11_p1_a2_covered_methods", "SELECT test_name, class_fqn, method_fqn, CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) AS covered FROM {cov_method} WHERE CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) % 3 <> 0")
def _(v):
    return coverage.covered_methods(_stored_reports(v, _report_trees(v)))


@query("p7_classes_with_covered_lines", "SELECT DISTINCT test_name, class_fqn FROM {cov_method} WHERE CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) % 3 <> 0")
def _(v):
    return coverage.classes(_stored_reports(v, coverage.with_covered_lines(_report_trees(v)))).select("test_name", "class_fqn")


@query("d5_report_mode", "SELECT count(*) AS tests, CASE WHEN count(*) > 50 THEN 'chunked' ELSE 'inline' END AS mode FROM {map_test}")
def _(v):
    return report.report_mode(v.map_test)


@query("k9_page_lines", "SELECT key, nr, text FROM {src_line}")
def _(v):
    path = shared_path(v.spark, "pages")
    sinks.write_pages(v.src_line, path)
    return v.spark.read.schema("key string, nr int, text string").json(path).select("key", "nr", "text")


@query("s8_change_scans", "SELECT 'committed' AS origin, line FROM {name_status} WHERE ord % 2 = 0 UNION ALL SELECT 'worktree', line FROM {name_status} WHERE ord % 2 = 1")
def _(v):
    path = shared_path(v.spark, "changes")
    for origin, rest in (("committed", 0), ("worktree", 1)):
        v.name_status.where(F.col("ord") % 2 == rest).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("value")).coalesce(1).write.text(f"{path}/{origin}.statuses")
    # Spark names files itself: the folder says which scan a file is
    parts = [reports.change_lines_of(v.spark, f"{path}/{origin}.statuses", origin) for origin in ("committed", "worktree")]
    return parts[0].unionByName(parts[1]).select("origin", "line")


# ---- readers that go by file names, one scan for many paths


def _suite_reports(v: Views) -> str:
    """A report a suite, in a file named after the suite's test as the capture does it; with an empty file, a broken one and one that is no XML beside them."""
    path = shared_path(v.spark, "named")
    counter = lambda kind, n: F.array(F.struct(F.lit(kind).alias("_type"), F.lit(0).alias("_missed"), n.cast("int").alias("_covered")))
    number = F.regexp_extract("method_fqn", "#m([0-9]+)$", 1).cast("int")
    method = F.struct(F.substring_index("method_fqn", "#", -1).alias("_name"), F.lit("()V").alias("_desc"), F.lit(1).alias("_line"), counter("INSTRUCTION", F.when(number % 3 == 0, 0).otherwise(number)).alias("counter"))
    classes = v.suite_method.groupBy("test_name", "class_fqn").agg(F.array_sort(F.collect_list(method)).alias("method"))
    tree = F.struct(F.translate("class_fqn", ".", "/").alias("_name"), F.lit("A.java").alias("_sourcefilename"), "method")
    package = classes.groupBy("test_name").agg(F.array(F.struct(F.lit("com").alias("_name"), F.array_sort(F.collect_list(tree)).alias("class"))).alias("package"))
    named = package.select(F.lit("report").alias("_name"), "package", sf.escape_file_name(F.col("test_name")).alias("file"))
    named.repartition("file").write.partitionBy("file").format("xml").option("rootTag", "reports").option("rowTag", "report").save(f"{path}/written")
    move_parts(v.spark, f"{path}/written", f"{path}/reports", lambda key: f"session_{key}.xml")
    write_files(v.spark, f"{path}/reports", [("session_Empty#none.xml", ""), ("session_Broken#one.xml", "<report><package name="), ("notes.txt", "<report/>")])
    return f"{path}/reports"


@query("s1_f9_reports_by_file_name", "SELECT test_name, class_fqn, method_fqn, CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) AS covered FROM {suite_method} WHERE CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) % 3 <> 0")
def _(v):
    return coverage.covered_methods(reports.read_reports(v.spark, _suite_reports(v)))


@query("s1_j12_ingested_reports", "SELECT test_name, split_part(test_name, '#', 1) AS test_class, class_fqn, method_fqn, CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS BIGINT) AS covered FROM {suite_method} WHERE CAST(regexp_extract(method_fqn, '#m([0-9]+)$', 1) AS INT) % 3 <> 0")
def _(v):
    path = shared_path(v.spark, "ingest")
    ingest.ingest_reports(v.spark, _suite_reports(v), f"{path}/map", f"{path}/checkpoint", files_a_batch=20).awaitTermination()
    return store.read(v.spark, f"{path}/map", ingest.COVERED)


@query("s15_modules_in_one_scan", "SELECT module, test_name, class_fqn, pos FROM {module_class}")
def _(v):
    path = shared_path(v.spark, "modules")
    # modules of even numbers are plain, others indexed; a module's tests are dealt out to documents
    split = v.module_class.withColumn("document", F.pmod(F.xxhash64("test_name"), F.lit(4)))
    own = split.groupBy("module", "document", "test_name").agg(F.array_sort(F.collect_list(F.struct("pos", "class_fqn"))).alias("x")).select("module", "document", "test_name", F.col("x.class_fqn").alias("classes"))
    index = own.groupBy("module", "document").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classIndex"))
    none = F.array().cast("array<string>")
    tests = F.map_from_entries(F.collect_list(F.struct("test_name", F.struct("classes", none.alias("methods")))))
    ids = F.map_from_entries(F.collect_list(F.struct("test_name", F.struct(F.transform("classes", lambda c: F.array_position("classIndex", c).cast("int") - 1).alias("classes"), F.array().cast("array<int>").alias("methods")))))
    even = F.right("module", F.lit(1)).isin("0", "2", "4", "6")
    plain = own.where(even).groupBy("module", "document").agg(tests.alias("testMappings")).select("module", F.to_json(F.struct("testMappings")).alias("value"))
    coded = own.where(~even).join(index, ["module", "document"]).groupBy("module", "document", "classIndex").agg(ids.alias("testMappings")).select("module", F.to_json(F.struct("classIndex", none.alias("methodIndex"), "testMappings")).alias("value"))
    _write_documents(plain.unionByName(coded), path)
    modules = [r["module"] for r in v.module_class.select("module").distinct().collect()]
    found = maps.read_modules(v.spark, {m: f"{path}/of={m}" for m in modules})["cov_class"]
    return found.select(F.col("map_id").alias("module"), "test_name", "class_fqn", (F.col("pos") + 1).cast("long").alias("pos"))


def _write_documents(rows: DataFrame, path: str) -> None:
    """(module, value) rows as files of one document each, in a folder for each module."""
    rows.select("value", F.col("module").alias("of")).write.option("maxRecordsPerFile", 1).partitionBy("of").text(path)


@query("s13_metrics_by_module", "SELECT module, name, status, duration_ms, failure_class AS failure_type FROM {test_metric}")
def _(v):
    path = shared_path(v.spark, "metrics")
    test = F.struct("name", "status", F.col("duration_ms").alias("durationMs"), F.col("failure_class").alias("failureType"))
    # a file for each run of a module, as each virtual machine writes its own; the tests of a file don't name their module
    runs = v.test_metric.withColumn("run", F.pmod(F.xxhash64("name"), F.lit(8))).groupBy("module", "run").agg(F.collect_list(test).alias("tests"))
    _write_documents(runs.select("module", F.to_json(F.struct("tests")).alias("value")), path)
    modules = [r["module"] for r in v.test_metric.select("module").distinct().collect()]
    return reports.read_metrics(v.spark, {m: f"{path}/of={m}" for m in modules}).drop("failure_message")


def _platform(v: Views) -> str:
    """A platform's tree: extensions below ``ext``, below a folder named as path, one named itself, folders that are missing, and a bootstrap folder; classes and sources."""
    home = f"{shared_path(v.spark, 'tree')}/bin/platform"
    xml = '<config><extensions><path dir="${PLATFORM_BIN_DIR}/custom"/><path dir="${PLATFORM_BIN_DIR}/missing"/><extension name="core"/><extension dir="${PLATFORM_BIN_DIR}/lone"/><extension dir="/nowhere/e"/></extensions></config>'
    rows = v.extension_class.distinct().collect()  # some hundred file names
    files = [(f"{r['folder']}/{r['rel_path']}", "compiled") for r in rows]
    sources = [(f"{r['folder'].removesuffix('classes')}src/{r['rel_path'].removesuffix('.class')}.java", f"class {r['rel_path']}\n  // {r['folder']}") for r in rows if r["folder"].endswith("classes")]
    write_files(v.spark, home, [("extensions.xml", xml), *files, *sources])
    return home


ORDER = "CASE folder WHEN 'ext/core/classes' THEN 0 WHEN 'ext/web/classes' THEN 1 WHEN '../custom/shop/classes' THEN 2 WHEN '../lone/classes' THEN 3 WHEN 'bootstrap/classes' THEN 4 END"


@query("s14_s10_platform_classes", f"SELECT rel_path, CAST(min({ORDER}) AS INT) AS ord FROM {{extension_class}} WHERE folder <> 'ext/core/other' GROUP BY rel_path")
def _(v):
    roots = reports.platform_roots(v.spark, _platform(v))
    return reports.class_files(v.spark, *roots).groupBy("rel_path").agg(F.min("ord").alias("ord"))


@query("s14_s11_platform_sources", f"WITH f AS (SELECT replace(rel_path, '.class', '.java') AS rel_path, min({ORDER}) AS ord, arg_min(folder, {ORDER}) AS folder, rel_path AS was FROM {{extension_class}} WHERE folder NOT IN ('ext/core/other', 'bootstrap/classes') GROUP BY rel_path) SELECT rel_path, concat('class ', was, chr(10), '  // ', folder) AS text FROM f")
def _(v):
    roots = reports.platform_roots(v.spark, _platform(v), "src")
    own = reports.source_files(v.spark, *roots).groupBy("rel_path").agg(F.min(F.struct("ord", "text")).alias("x"))
    return own.select("rel_path", "x.text")
