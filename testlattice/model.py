"""Schemas of files, and the canonical tables that every operator works on.

    map_meta       map_id, base_branch, commit_id, ts
    map_test       map_id, test_name, test_class
    cov_class      map_id, test_name, pos, class_fqn
    cov_method     map_id, test_name, pos, method_fqn, class_fqn
    class_metrics  map_id, class_fqn, line_missed, line_covered, branch_missed, branch_covered
    line_cov       test_name, pkg, sourcefile, nr, mi, ci, mb, cb
    changed_class / changed_method / changed_test / changed_file

``pos`` is the place of an entry in its test's list: which changed method a test is credited with depends on it.
"""

from __future__ import annotations

METADATA = "struct<baseBranch:string,commitId:string,timestamp:string>"
COUNTERS = "struct<lineMissed:int,lineCovered:int,branchMissed:int,branchCovered:int>"
METRICS = f"map<string,{COUNTERS}>"
LISTS = "struct<classes:array<string>,methods:array<string>>"
#: Plain and indexed maps alike: the ids of an indexed one are read as text.
ANY_MAP = f"metadata {METADATA}, classIndex array<string>, methodIndex array<string>, testMappings map<string,{LISTS}>, classMetrics {METRICS}"
COUNTER = "array<struct<_type:string,_missed:int,_covered:int>>"
REPORT = (
    "_name string, sessioninfo array<struct<_id:string,_start:bigint,_dump:bigint>>, package array<struct<_name:string,"
    f"class:array<struct<_name:string,_sourcefilename:string,method:array<struct<_name:string,_desc:string,_line:int,counter:{COUNTER}>>,counter:{COUNTER}>>,"
    "sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int,_mb:int,_cb:int>>>>>>"
)
SELECTION = "status string, reason string, selectedTests array<string>, unmappedTests map<string,string>, changedClasses array<string>"
TEST = "struct<module:string,name:string,status:string,durationMs:bigint,failureType:string,failureMessage:string>"
TEST_METRICS = f"runId string, commitId string, branch string, context string, timestamp string, tests array<{TEST}>"

#: Fixed values of the domain.
STATUSES = ("FULL_SUITE", "SELECTED", "NONE")
PREFER = ("NEAREST", "REMOTE", "LOCAL")
MAX_COMMIT_DISTANCE, CHUNK_TESTS, LIST_CAP, INLINE_CAP, SUGGESTIONS, TOP_CLASSES = 500, 50, 200, 200, 20, 10
