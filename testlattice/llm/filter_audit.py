"""Filter interaction audit: what each filter removes alone, after others, and in every order, by packed bitmaps.

Every document gets a bit for each filter that it fails, for each label that it has, and for the part it belongs to. Inside a
task the rows of a part take up 64-bit words of their own, so that the bitset of a part is a run of words; for each of the
2^k sets of filters the words are and-notted and their bits counted by run. Only those counts leave a task, 2^k rows for
each part that it met; sums of them answer every order of the filters.

The texts are read once, where they lie: what goes on is a row of an id, a part, the bits of the filters that see one text,
and a digest. A text fails the filter on repeated texts if a smaller id has the same one, so every row but those of the
smallest id fails: the smallest ids are found with map-side combine, and rows meet them by digest and id together, which
divides a group of copies, however large, among all tasks.

Defined results: a null text or part is empty. Rows with a null id have no smaller id and no label, and make no row fail.
Rows that repeat an id are documents of their own and never fail because of each other. Of several labels of an id it has
those that any of them gives. A part without rows has no result, so an empty table has none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, map_batches, ready, utf8

FILTERS = "ABCDE"
SHORT, VARIED, CAPITAL, MARKED, REPEATED = (1 << i for i in range(5))
# Fixed values of the filters on characters.
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Longer texts are split into words a piece at a time; a task sends its counts on when it knows so many parts.
PIECE, MOST_PARTS = 1 << 20, 2000
_COUNTS = ("kept", "good", "toxic")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (maximal runs without ASCII white space), in pieces that end where a word does."""
    at, rest = 0, b""
    while len(text) - at > PIECE:
        words = (rest + text[at : at + PIECE]).split()
        at += PIECE
        if text[at - 1] in b" \t\n\x0b\x0c\r":
            rest = b""
        else:
            rest = words.pop() if words else b""
        yield words
    yield (rest + text[at:]).split()


def failed(text: bytes, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> int:
    """Bits of the filters that a text fails by itself."""
    words, known = 0, set()
    for some in _pieces(text):
        words += len(some)
        known.update(some)
    points = len(text.decode("utf-8", "surrogatepass"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    marks = len(text) - len(text.translate(None, _MARKS))
    return SHORT * (words < min_words) | VARIED * (100 * len(known) < distinct_percent * words) | CAPITAL * (100 * capitals > capital_percent * points) | MARKED * (marks > 0)


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(_id, _part, _bits, _digest) of every row; the bits don't tell of repeated texts yet."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.col(text_col).alias("_text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch, "_text")
        bits, digests = [failed(x) for x in texts], [hashlib.sha256(x).digest() for x in texts]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["_id", "_part", "_bits", "_digest"])

    return map_batches(rows, work, f"_id {rows.schema['_id'].dataType.simpleString()}, _part string, _bits int, _digest binary")


class Bitmaps:
    """Counts of a task: for each part, and each set of filters, the rows that pass all filters of the set, and those of them with a label."""

    def __init__(self, filters: int = len(FILTERS), labels: int = 2):
        self.filters, self.labels = filters, labels
        self.counts: dict[str, np.ndarray] = {}

    def add(self, parts: list[str], codes: np.ndarray, bits: np.ndarray, labels: list[np.ndarray]) -> None:
        """Rows with the place of their part in ``parts``, the bits they fail, and their labels."""
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")
        codes, bits = codes[order], bits[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        lengths = np.diff(np.r_[starts, len(codes)])
        words = -(-lengths // 64)
        first = np.r_[0, np.cumsum(words)[:-1]]
        place = np.arange(len(codes)) - np.repeat(starts, lengths) + np.repeat(first * 64, lengths)
        size = int(words.sum())

        def packed(flags: np.ndarray) -> np.ndarray:
            out = np.zeros(size * 64, bool)
            out[place[flags]] = True
            return np.packbits(out).view(np.uint64)

        fails = [packed((bits >> f & 1).astype(bool)) for f in range(self.filters)]
        rows = packed(np.ones(len(codes), bool))
        wanted = [rows, *(packed(x[order]) for x in labels)]
        found = np.empty((len(starts), 1 << self.filters, 1 + self.labels), np.int64)
        passing: dict[int, np.ndarray] = {0: rows}
        for subset in range(1 << self.filters):
            if subset:
                low = subset & -subset
                passing[subset] = passing[subset ^ low] & ~fails[low.bit_length() - 1]
            for k, label in enumerate(wanted):
                found[:, subset, k] = np.add.reduceat(np.bitwise_count(passing[subset] & label).astype(np.int64), first)
        for code, own in zip(codes[starts].tolist(), found, strict=True):
            name = parts[code]
            self.counts[name] = self.counts[name] + own if name in self.counts else own

    def batch(self) -> pa.RecordBatch:
        """The counts as rows of (_part, _subset, kept, good, toxic); none are held afterwards."""
        names, sets = list(self.counts), 1 << self.filters
        table = np.concatenate(list(self.counts.values())) if names else np.empty((0, 1 + self.labels), np.int64)
        self.counts = {}
        columns = [pa.array(np.repeat(np.array(names, object), sets), pa.string()), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(names)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(1 + self.labels))], ["_part", "_subset", *_COUNTS])


def subset_counts(rows: DataFrame) -> DataFrame:
    """(_part, _subset, kept, good, toxic) summed over all partitions of (_part, _bits, _good, _toxic)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmaps()
        for batch in batches:
            part = batch.column("_part").dictionary_encode()
            own.add(part.dictionary.to_pylist(), part.indices.to_numpy(zero_copy_only=False), batch.column("_bits").to_numpy(zero_copy_only=False), [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_good", "_toxic")])
            if len(own.counts) >= MOST_PARTS:
                yield own.batch()
        yield own.batch()
        give_back()

    ready(rows.sparkSession)
    found = rows.mapInArrow(work, "_part string, _subset int, kept long, good long, toxic long")
    return found.groupBy("_part", "_subset").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def steps(filters: str = FILTERS) -> list[dict]:
    """The filter's place and bit, and the sets of filters before and after, of every step of every order."""
    out = []
    for order in permutations(filters):
        sets = [0]
        for f in order:
            sets.append(sets[-1] | 1 << filters.index(f))
        out += [{"filter_order": "".join(order), "step": k + 1, "f": filters.index(order[k]), "bit": before ^ after, "before": before, "after": after} for k, (before, after) in enumerate(pairwise(sets))]
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, out of the counts of all sets; a part is one row with 2^k counts until its steps are laid out."""
    full = (1 << len(filters)) - 1
    part = counts.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_subset", F.struct(*_COUNTS)))).alias("c"))
    weight = [factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()) for s in range(full)]
    at = lambda s, name: F.element_at("c", s)[name]

    def shapley(f: int) -> Column:
        outside = [s for s in range(full) if not s >> f & 1]
        return reduce(Column.__add__, ((at(F.lit(s), "kept") - at(F.lit(s | 1 << f), "kept")) * weight[s] for s in outside))

    plan = F.from_json(F.lit(json.dumps(steps(filters))), "array<struct<filter_order:string,step:int,f:int,bit:int,before:int,after:int>>")
    known = part.select("_part", "c", F.array(*(shapley(f) for f in range(len(filters)))).alias("shares"))
    laid = known.select("_part", "c", "shares", F.inline(plan))
    one = F.col("bit")
    removed = at(F.col("before"), "kept") - at(F.col("after"), "kept")
    return laid.select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        at(F.col("after"), "kept").alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0), "kept") - at(one, "kept") - removed).alias("redundant"),
        (at(F.lit(full) - one, "kept") - at(F.lit(full), "kept")).alias("unique_fails"),
        (at(F.col("before"), "good") - at(F.col("after"), "good")).alias("good_lost"),
        (at(F.col("before"), "toxic") - at(F.col("after"), "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("f") + 1).alias("shapley"),
    )


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, _part, _bits, _good, _toxic) of every row, with the bit of repeated texts and the labels."""
    rows = cut_lineage(facts(docs, id_col, text_col, part_col))
    some = rows.where("_id is not null")
    least = some.groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    bits = F.when(F.col("_first"), F.col("_bits")).otherwise(F.col("_bits").bitwiseOR(F.lit(REPEATED)))
    no = F.lit(False)
    known = some.join(least, ["_id", "_digest"], "left").join(told, "_id", "left").select("_id", "_part", bits.alias("_bits"), F.coalesce("_good", no).alias("_good"), F.coalesce("_toxic", no).alias("_toxic"))
    return known.unionByName(rows.where("_id is null").select("_id", "_part", "_bits", no.alias("_good"), no.alias("_toxic")))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; the last is the sum over all orders of what the step's filter removes."""
    return audit(subset_counts(flagged(docs, labels, id_col, text_col, part_col)))
