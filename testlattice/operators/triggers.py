"""Many path globs over many paths: each glob is looked for by a name that its paths must hold, and checked only where that name occurs.

A glob is taken apart into literal path segments, the first ``HEAD`` characters of segments that begin with as many literal ones, and the literal ending of
its last segment; groups in braces give a glob each. A path has its own segments, their beginnings and its ending. Of a glob's names the one that the fewest paths hold is its anchor, so the join of anchors with the names of paths gives few candidates, and
a glob with a name that no path holds is done with. Globs without any literal name are checked on every path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import glob_regex

#: Characters of a segment's begin.
HEAD = 8


def alternatives(pattern: str) -> list[str]:
    """The globs that a glob with groups in braces stands for; groups may hold others."""
    depth, start = 0, -1
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "{":
            start, depth = (at if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                inner, cuts, level, k = pattern[start + 1 : at], [-1], 0, 0
                while k < len(inner):
                    if inner[k] == "\\":
                        k += 1
                    elif inner[k] == "," and not level:
                        cuts.append(k)
                    else:
                        level += (inner[k] == "{") - (inner[k] == "}")
                    k += 1
                cuts.append(len(inner))
                parts = [inner[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
                return [x for p in parts for x in alternatives(pattern[:start] + p + pattern[at + 1 :])]
        at += 1
    return [pattern]


def names(pattern: str) -> list[str]:
    """Names that every path of a glob without groups holds: ``/segment`` for a literal segment, ``^begin`` for the literal begin of another, ``.ending`` for what follows the last dot."""
    opaque = re.sub(r"\\.|\[[^\]]*\]", lambda m: "*" if "/" not in m.group() else "*" * len(m.group()), pattern)
    if re.search(r"\[[^\]]*/", pattern) or "{" in opaque or "}" in opaque:
        return []  # a class that holds a slash: segments cannot be told
    segments = opaque.split("/")
    out = [f"/{s}" for s in segments if s and not re.search(r"[*?\[\]]", s)]
    begins = (re.match(r"[^*?\[\]]*", s).group() for s in segments if re.search(r"[*?\[\]]", s))
    out += [f"^{b[:HEAD]}" for b in begins if len(b) >= HEAD]
    tail = re.search(r"\.([^.*?\[\]/]+)$", segments[-1])
    return out + ([f".{tail.group(1)}"] if tail else [])


def path_names(path: F.Column) -> F.Column:
    """All names of a path, as ``names`` writes them."""
    parts = F.split(path, "/")
    segments = F.transform(parts, lambda s: F.concat(F.lit("/"), s))
    begins = F.transform(F.filter(parts, lambda s: F.length(s) >= HEAD), lambda s: F.concat(F.lit("^"), F.left(s, F.lit(HEAD))))
    return F.array_distinct(F.concat(segments, begins, F.array(F.concat(F.lit("."), F.substring_index(path, ".", -1)))))


def globs(spark: SparkSession, triggers: list[str]) -> DataFrame:
    """(at, pattern, regex, names) of the triggers in their order, a row for each alternative."""
    rows = [(i, t, glob_regex(x), names(x)) for i, t in enumerate(triggers) for x in alternatives(t)]
    return spark.createDataFrame(rows, "at int, pattern string, regex string, names array<string>")


def first_trigger(changed_file: DataFrame, triggers: list[str]) -> DataFrame:
    """As ``selection.trigger_match``, for any number of triggers: the first pattern, in their order, that a path matches, with its smallest path."""
    spark = changed_file.sparkSession
    told = globs(spark, triggers)
    paths = changed_file.where("path is not null").select("path").distinct()
    held = paths.select("path", F.explode(path_names(F.col("path"))).alias("name"))
    wanted = told.select("at", "pattern", "regex", F.explode("names").alias("name"))
    often = held.join(wanted.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # a glob whose rarest name no path holds has no candidates
    rarest = wanted.join(often, "name", "left").groupBy("at", "pattern", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "name")).alias("x"))
    anchored = held.join(rarest.where("x.n > 0").select("at", "pattern", "regex", F.col("x.name").alias("name")), "name").select("at", "pattern", "path", "regex")
    hits = anchored.where(F.expr("path rlike regex")).select("at", "pattern", "path")
    loose = [(i, t, glob_regex(x)) for i, t in enumerate(triggers) for x in alternatives(t) if not names(x)]
    if loose:
        # of the globs without a name the first that a path matches is enough
        first = F.coalesce(*(F.when(F.col("path").rlike(expression), F.struct(F.lit(i).alias("at"), F.lit(t).alias("pattern"))) for i, t, expression in loose))
        hits = hits.unionByName(paths.select(first.alias("x"), "path").where("x is not null").select("x.at", "x.pattern", "path"))
    return hits.agg(F.min(F.struct("at", "path", "pattern")).alias("x")).where("x is not null").select("x.path", "x.pattern")
