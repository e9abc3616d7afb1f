"""Suffix-array dedup: remove every byte of a LENGTH-byte string that also starts anywhere else.

The idea is prefix doubling: positions are ranked by ever longer prefixes, and a position leaves as soon as its rank is unique. Rank pairs of every position,
sorted by Spark at every offset, would be dozens of times the input (README has figures). Here ranks are names, hashes of 32 and of LENGTH bytes that
workers compute by doubling within a text; Spark counts equal names and drops unique ones, in three rounds; ordinals are never made, and bytes are not compared again:

1. the 32-byte rank of *anchors*. Every LENGTH-byte window has one, the position in it whose rank is least, so equal windows have
   equal anchors at equal places, and a window whose anchor's rank is unique is unique. About one position in 70 is an anchor; rows for every
   position would be dozens of times the input.
2. the rank of an anchor's *block*, the stretch of all windows that belong to it. A block that occurs twice is removed whole. Blocks that
   are alone with their anchor's rank are unique.
3. the LENGTH-byte rank of every window of the other blocks, each different block once.

Names stand for ordinals. Windows of blocks that differ are equal under a 64-bit rank of their anchor and two 64-bit ranks of their own, which come from
different tables; blocks are equal under the rank of their anchor and one 64-bit hash of their bytes, so a removal of whole blocks rests on 64 bits among the
blocks of one anchor rank. A text of a short period would have an anchor for every period: a run of equal blocks is one anchor, and of blocks that a text has
several times, close together or not, one goes on, while the text's own spans are merged where it lies. So a text sends a row for each different block, at
most one in about 70 bytes, and the spans of a text that meet in one row are fewer than that. Classes of an anchor with up to
``crowd`` different blocks are sorted side by side inside a task; larger ones, such as a passage in ever new surroundings, are sorted by Spark
as rows of windows with map-side combine.

Texts are known by the MD5 of their bytes. Defined results: null counts as empty; texts under LENGTH bytes keep everything; texts that occur
twice and have LENGTH bytes lose everything; rows may repeat ids or have none. Cutting may leave bytes that are not UTF-8: ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, ready, release, utf8
from .suffix_ranks import FIRST, LENGTH, SECOND, anchors, ranks

CROWD, SORTED_BLOCKS = 8192, 2000


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def own_repeats(first: np.ndarray, size: np.ndarray, count: np.ndarray, gram: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a text's anchors one for each different block, and the spans of blocks that the text has more than once."""
    order = np.lexsort((block, gram))
    new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (block[order][1:] != block[order][:-1])) if len(order) else np.zeros(0, bool)
    times = np.add.reduceat(count[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    twice = np.zeros(len(order), bool)
    twice[order] = np.repeat(times, np.diff(np.append(np.flatnonzero(new), len(order)))) > 1
    kept = np.sort(order[new])
    return kept, merged(list(zip(first[twice].tolist(), (first + size * count + LENGTH - 1)[twice].tolist(), strict=True)))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(gram, block, doc, first, size) of each different block of each text, and rows without a block for the spans that a text repeats itself, merged; their gram only deals them out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, names, counts = [], [], []
        for text in utf8(batch, "_text"):
            gram, block, first, size, count = anchors(text)
            kept, spans = own_repeats(first, size, count, gram, block)
            n = len(kept)
            a, b = (np.array([x[i] for x in spans], np.int64) for i in (0, 1))
            known = np.append(np.ones(n, bool), np.zeros(len(spans), bool))
            names.append(hashlib.md5(text).digest())
            dealt = np.frombuffer(names[-1][:8], np.uint64) + a.view(np.uint64)
            parts.append((known, np.append(gram[kept], dealt), np.append(block[kept], dealt), np.append(first[kept], a), np.append(size[kept], b - a)))
            counts.append(n + len(spans))
        known, gram, block, first, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = pa.array(np.repeat(np.arange(len(names)), counts))
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(block.view(np.int64), mask=~known), pa.array(names, pa.binary()).take(at), pa.array(first, pa.int64()), pa.array(size.astype(np.int64))], ["gram", "block", "doc", "first", "size"])

    return map_batches(texts.where(F.octet_length("_text") >= LENGTH).select("_text"), work, "gram long, block long, doc binary, first long, size long")


def repeated_windows(classes: list[int], pieces: list[bytes]) -> list[list[tuple[int, int]]]:
    """For every piece the spans of bytes in windows that another piece of its class has too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    counts = np.array([len(p) - LENGTH + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank, second = (ranks(data, LENGTH, table)[starts[piece] + offset] for table in (FIRST, SECOND))
    own = np.unique(np.asarray(classes, np.int64), return_inverse=True)[1][piece]
    order = np.lexsort((rank, own))
    same = (rank[order][1:] == rank[order][:-1]) & (second[order][1:] == second[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _runs(piece[twice], offset[twice], len(pieces))


def _runs(piece: np.ndarray, offset: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(piece):
        cut = np.flatnonzero((np.diff(piece) != 0) | (np.diff(offset) != 1)) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(piece)), strict=True):
            out[piece[a]].append((int(offset[a]), int(offset[b - 1]) + LENGTH))
    return out


FOUND = "gram long, block long, start int, stop int"


def _sorted_in_task(blocks: DataFrame) -> DataFrame:
    """Round 3 for classes of bounded size: (gram, block, start, stop) of repeated windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def flush(upto: int) -> pa.RecordBatch:
            part = held[:upto]
            del held[:upto]
            spans = repeated_windows([x[0] for x in part], [x[2] for x in part])
            rows = [(g, b, s, t) for (g, b, _), found in zip(part, spans, strict=True) for s, t in found]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "block", "start", "stop"])

        for batch in batches:
            held += zip(batch.column("gram").to_pylist(), batch.column("block").to_pylist(), batch.column("piece").to_pylist(), strict=True)
            if len(held) >= SORTED_BLOCKS:
                upto = len(held)
                while upto and held[upto - 1][0] == held[-1][0]:  # the last class may go on in the next batch
                    upto -= 1
                if upto:
                    yield flush(upto)
        if held:
            yield flush(len(held))

    return blocks.select("gram", "block", "piece").repartition("gram").sortWithinPartitions("gram").mapInArrow(work, FOUND)


def _sorted_by_spark(blocks: DataFrame) -> DataFrame:
    """Round 3 for classes of any size, as rows of windows."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = [np.frombuffer(p, np.uint8) for p in batch.column("piece").to_pylist()]
        got, more = ([ranks(p, LENGTH, table).view(np.int64) for p in pieces] for table in (FIRST, SECOND))
        at = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
        return pa.RecordBatch.from_arrays([batch.column("gram").take(at), batch.column("block").take(at), pa.array(np.concatenate([np.arange(len(x)) for x in got]).astype(np.int32)), pa.array(np.concatenate(got)), pa.array(np.concatenate(more))], ["gram", "block", "at", "rank", "second"])

    rows = map_batches(blocks.select("gram", "block", "piece"), spread, "gram long, block long, at int, rank long, second long")
    twice = rows.groupBy("gram", "rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "rank", "second")
    found = rows.join(twice, ["gram", "rank", "second"], "left_semi").groupBy("gram", "block").agg(F.array_sort(F.collect_list("at")).alias("ats"))

    def join_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for ats in batch.column("ats").to_pylist():
            spans.append(_runs(np.zeros(len(ats), int), np.array(ats), 1)[0])
        at = pa.array(np.repeat(np.arange(len(spans)), [len(s) for s in spans]))
        flat = [x for s in spans for x in s]
        return pa.RecordBatch.from_arrays([batch.column("gram").take(at), batch.column("block").take(at), pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], ["gram", "block", "start", "stop"])

    return map_batches(found, join_runs, FOUND)


def _spans(texts: DataFrame, crowd: int) -> DataFrame:
    """(_doc, cut): the spans to remove from each text, from rows of (doc, _text)."""
    every = _anchor_rows(texts)
    names = cut_lineage(every.where("block is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", F.lit(True).alias("twice")))  # a table of its own, so that Spark can split a frequent rank in the join
    held = cut_lineage(every.join(names, "gram", "left").where("twice or block is null").drop("twice"))
    round1, own = held.where("block is not null"), held.where("block is null")

    blocks = cut_lineage(round1.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "size")).alias("r")).select("gram", "block", "n", "r.*"))
    several = blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    wanted = blocks.join(several, "gram").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("gram", "block", "different", "first", "size")).alias("want"))

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(w["gram"], w["block"], w["different"], text[w["first"] : w["first"] + w["size"] + LENGTH - 1]) for text, want in zip(utf8(batch, "_text"), batch.column("want").to_pylist(), strict=True) for w in want]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["gram", "block", "different", "piece"])

    with_text = texts.where(F.octet_length("_text") >= LENGTH).select("doc", "_text").join(wanted, F.col("doc") == F.col("_doc"))
    found_pieces = map_batches(with_text.select("_text", "want"), pieces, "gram long, block long, different long, piece binary")
    open_blocks = cut_lineage(found_pieces.dropDuplicates(["gram", "block"]))
    found = _sorted_in_task(open_blocks.where(F.col("different") <= crowd)).unionByName(_sorted_by_spark(open_blocks.where(F.col("different") > crowd)))

    whole = blocks.where("n > 1").select("gram", "block", F.lit(0).alias("start"), (F.col("size") + LENGTH - 1).alias("stop"))
    spans = round1.join(whole.unionByName(found), ["gram", "block"]).select(F.col("doc").alias("_doc"), F.struct((F.col("first") + F.col("start")).alias("a"), (F.col("first") + F.col("stop")).alias("b")).alias("span"))
    own = own.select(F.col("doc").alias("_doc"), F.struct(F.col("first").alias("a"), (F.col("first") + F.col("size")).alias("b")).alias("span"))
    return spans.unionByName(own).groupBy("_doc").agg(F.collect_set("span").alias("cut"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, spans (removed runs)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    keyed = rows.withColumn("doc", F.unhex(F.md5(F.col("_text").cast("binary"))))

    by_doc = cut_lineage(_spans(keyed, crowd))
    release(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, count, kept, digest, runs = [], [], [], [], [], []
        for text, found_ in zip(utf8(batch, "_text"), batch.column("cut").to_pylist(), strict=True):
            own = merged([(s["a"], s["b"]) for s in found_ or ()])
            left = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)], strict=True))
            total.append(len(text))
            removed.append(len(text) - len(left))
            count.append(len(own))
            kept.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
            runs.append([{"a": a, "b": b} for a, b in own])
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string()), pa.array(runs, span)], ["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])

    joined = keyed.join(by_doc, F.col("doc") == F.col("_doc"), "left").select("_id", "_text", "cut")
    return map_batches(joined, cut, f"_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<a:long,b:long>>").withColumnRenamed("_id", id_col)
