"""Source divergence audit: how the sources of a language differ in the terms they use, by mergeable radix tries.

Terms are the maximal runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each task counts the terms of
its texts and sends them on as byte tries, one for each language and prefix of ``STEM`` bytes, whose leaves hold the number of
documents and a counter for each source: a term that every document holds leaves a task as one leaf.
Spark deals out the subtries by ranges of (language, prefix), sorted, so a task merges the subtries of one prefix after
another, drops the leaves of terms in too few documents, and keeps the merged tries. Their counters give the sums by group
and the number of kept terms by language. Last, the merged tries are walked in byte order, which is the order of UTF-8: a
matrix of counts, terms by sources, gives the terms' share of each pair of sources, and the first terms of each source,
where of equal values the earlier term stays.

All arithmetic is exact: quotients are made in three steps of a thousand, so nothing passes 2^63 while a group holds fewer
than 9 * 10^15 occurrences. A task holds the trie of one prefix, and the sums of the pairs of one language.

Defined results: null text, language or source is the empty one; every row is a document, repeated rows and null ids
included; a group without terms has counts of 0 and its rows of pairs; a language with one source has no pairs; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, ready, salted_join, utf8
from .radix_trie import Trie, packed_sorted

#: Bytes of the prefixes that subtries are dealt out by; leaves after which a task sends its tries on; leaves of a merged trie; cells of a matrix.
STEM, MOST_LEAVES, MERGED_LEAVES, CELLS = 4, 400_000, 20_000, 1 << 20
#: Longer texts are counted a piece at a time.
PIECE = 1 << 20
SCALE = 10**9
# Bytes that terms are made of stay or become lower case, all others part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at, rest = 0, b""
    while len(text) - at > PIECE:
        terms = (rest + text[at : at + PIECE].translate(_TERMS)).split(b" ")
        at += PIECE
        rest = terms.pop()
        yield [x for x in terms if x]
    yield [x for x in (rest + text[at:].translate(_TERMS)).split(b" ") if x]


class Counting:
    """The terms that a task has met, by language and source, and the tries that they leave it in."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def add(self, texts: list[bytes], langs: list[str], sources: list[str]) -> None:
        for text, lang, source in zip(texts, langs, sources, strict=True):
            counts, docs = self.counts.setdefault(lang, {}).setdefault(source, Counter()), self.docs.setdefault(lang, Counter())
            if len(text) <= PIECE:
                terms = text.translate(_TERMS).split()
                counts.update(terms)
                docs.update(set(terms))
            else:
                own: set[bytes] = set()
                for terms in _pieces(text):
                    counts.update(terms)
                    own.update(terms)
                docs.update(own)

    def size(self) -> int:
        return sum(map(len, self.docs.values()))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was counted, as a trie for each language and prefix; nothing is held afterwards.

        Equal terms of a task are one leaf before a trie is made, and sorted terms make their tries without a walk from the root for each.
        """
        docs, counts, self.docs, self.counts = self.docs, self.counts, {}, {}
        for lang, held in docs.items():
            names = list(counts[lang])
            leaves: dict[bytes, list[int]] = {term: [] for term in held}  # a source and its counter in turn
            for source, name in enumerate(names):
                for term, n in counts[lang].pop(name).items():
                    leaves[term] += (source, n)
            rows = []
            for stem, some in groupby(sorted(leaves), key=lambda x: x[:STEM]):
                terms = list(some)
                data, known = packed_sorted([t[len(stem) :] for t in terms], [held[t] for t in terms], [leaves[t] for t in terms])
                rows.append((lang, stem, data, [names[i] for i in known]))
                if len(rows) == 2000:
                    yield _rows(rows, ["lang", "stem", "trie", "sources"])
                    rows = []
            yield _rows(rows, ["lang", "stem", "trie", "sources"])


_TYPES = {"lang": pa.string(), "stem": pa.binary(), "trie": pa.binary(), "sources": pa.list_(pa.string()), "sums": pa.list_(pa.int64()), "terms": pa.int64(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[n]) for i, n in enumerate(names)], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Counting()
    for batch in batches:
        own.add(utf8(batch, "text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        if own.size() >= MOST_LEAVES:
            yield from own.batches()
    yield from own.batches()
    give_back()


def merging(min_docs: int):
    """Merge sorted subtries, a prefix at a time, into tries of one language without the terms of fewer documents."""

    def finished(lang: str, trie: Trie, names: list[str]) -> pa.RecordBatch:
        data, known = trie.packed()
        sums = dict.fromkeys(known, 0)
        for _, leaf in trie.walk():
            for source, n in leaf.counts.items():
                sums[source] += n
        return _rows([(lang, data, [names[i] for i in known], [sums[i] for i in known], trie.size)], ["lang", "trie", "sources", "sums", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, whole, sources = None, Trie(), Trie(), {}
        for batch in batches:
            for lang, stem, data, names in zip(*(batch.column(c).to_pylist() for c in ("lang", "stem", "trie", "sources")), strict=True):
                if at is not None and at != (lang, stem):
                    part.keep(min_docs)
                    whole.merge(part, at[1])
                    part = Trie()
                    if at[0] != lang or whole.size >= MERGED_LEAVES:
                        if whole.size:
                            yield finished(at[0], whole, list(sources))
                        whole, sources = Trie(), {}
                at = (lang, stem)
                part.merge(Trie.unpacked(data, [sources.setdefault(x, len(sources)) for x in names]))
        if at is not None:
            part.keep(min_docs)
            whole.merge(part, at[1])
            if whole.size:
                yield finished(at[0], whole, list(sources))
        give_back()

    return run


def scaled(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / totals), exactly, for counts that don't pass their totals."""
    rest, out = counts, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); neither passes 10^9 + 1, so the square stays below 2^63."""
    return (p - q) ** 2 // (p + q)


class Comparing:
    """Sums over pairs of sources, and the first terms of each, of one language."""

    def __init__(self, names: list[str], sums: list[int], terms: int, most: int):
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        self.names, self.most = [names[i] for i in order], most
        self.places = {n: i for i, n in enumerate(self.names)}
        own = np.array([sums[i] for i in order], np.int64)
        self.totals, self.total = own + 2 * terms, int(own.sum()) + 2 * terms
        self.pairs = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in names]

    def add(self, trie: Trie) -> None:
        size, block = max(1, CELLS // max(1, len(self.names))), []
        for term, leaf in trie.walk():
            block.append((term, leaf))
            if len(block) == size:
                self._block(block)
                block = []
        if block:
            self._block(block)

    def _block(self, block: list) -> None:
        counts = np.zeros((len(self.names), len(block)), np.int64)
        for k, (_, leaf) in enumerate(block):
            for source, n in leaf.counts.items():
                counts[source, k] = n
        p = scaled(counts + 2, self.totals[:, None])
        q = scaled(counts.sum(axis=0) + 2, np.int64(self.total))
        for g in range(len(self.names)):
            if g + 1 < len(self.names):
                self.pairs[g, g + 1 :] += distance(p[g], p[g + 1 :]).sum(axis=1)
            some = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            if len(some):
                value = distance(p[g, some], q[some])
                first = np.argsort(-value, kind="stable")[: self.most]  # of equal values the earlier term
                # values fall and terms rise in both lists, so sorting is stable merging
                self.best[g] = sorted(self.best[g] + [(int(value[i]), block[some[i]][0]) for i in first], key=lambda x: (-x[0], x[1]))[: self.most]

    def rows(self, lang: str) -> list[tuple]:
        pairs = [(lang, a, "pair", b, int(self.pairs[min(i, j), max(i, j)])) for i, a in enumerate(self.names) for j, b in enumerate(self.names) if i != j]
        return pairs + [(lang, s, "term", t.decode(), v) for s, best in zip(self.names, self.best, strict=True) for v, t in best]


def comparing(most: int):
    columns = ["lang", "source", "part", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Comparing] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("lang", "trie", "sources", "names", "totals", "kept")}
                if row["lang"] not in known:
                    for lang, own in known.items():
                        yield _rows(own.rows(lang), columns)
                    known = {row["lang"]: Comparing(row["names"], row["totals"], row["kept"], most)}
                own = known[row["lang"]]
                own.add(Trie.unpacked(row["trie"], [own.places[x] for x in row["sources"]]))
        for lang, own in known.items():
            yield _rows(own.rows(lang), columns)
        give_back()

    return run


def merged_tries(docs: DataFrame, min_docs: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, trie, sources, sums, terms): tries of the kept terms, each of one language and a range of terms, with its occurrences by source."""
    ready(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.col(text_col).alias("text"))
    counted = cut_lineage(rows.mapInArrow(_count, "lang string, stem binary, trie binary, sources array<string>"))
    dealt = counted.repartitionByRange("lang", "stem").sortWithinPartitions("lang", "stem")
    return cut_lineage(dealt.mapInArrow(merging(min_docs), "lang string, trie binary, sources array<string>, sums array<long>, terms long"))


def source_audit(docs: DataFrame, min_docs: int = 10, most_terms: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: the distance of a source from every other of its language ("pair"), and the terms it overuses most ("term")."""
    spark, empty = docs.sparkSession, F.lit("")
    tries = merged_tries(docs, min_docs, text_col, lang_col, source_col)
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.lit(0).cast("long").alias("n"))
    sums = tries.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("sums").alias("n"))))
    totals = groups.distinct().unionByName(sums).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = tries.groupBy("lang").agg(F.sum("terms").alias("kept"))
    langs = cut_lineage(totals.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("g")).join(kept, "lang", "left").select("lang", F.col("g.source").alias("names"), F.col("g.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    # a trie's bytes tell tries of one language apart
    known = salted_join(tries, langs, ["lang"], "trie", "inner").sortWithinPartitions("lang")
    found = known.mapInArrow(comparing(most_terms), "lang string, source string, part string, item string, value long")
    none = langs.select("lang", "names", F.explode("names").alias("source")).select("lang", "source", F.lit("pair").alias("part"), F.explode(F.array_remove("names", F.col("source"))).alias("item"), F.lit(0).cast("long").alias("value"))
    values = found.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = values.withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms))
