"""Line dedup: drop lines that many documents share.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Each document sends every
distinct key once, as a 128-bit hash, so the number of documents that hold a key is a plain count with map-side
combine; a line found in a third of all rows costs one counter a task. Frequent keys go back to the documents that
hold them, a key's documents being dealt out to several tasks, and the text is put together again in its own order.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points never drop;
every row is a document of its own, repeated rows included; rows with a null id are kept and treated like others that
share an id: a key that is frequent goes from all of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, salted_join, utf8

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z alone


def _code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "surrogatepass"))


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row a document: ``id_col``, ``kept_text``, ``n_lines`` (before), ``n_dropped``, ``kept_sha256``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, text in enumerate(utf8(batch, "_text")):
            found = {k for k in map(line_key, set(text.split(b"\n"))) if len(k) >= min_chars and (min_chars <= 1 or _code_points(k) >= min_chars)}
            out += map(_hash, found)
            at += [i] * len(found)
        return pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int32())), pa.array(out, pa.binary())], ["_id", "key"])

    held = cut_lineage(map_batches(rows, keys, f"_id {id_type}, key binary"))
    frequent = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("key")
    drops = salted_join(held, frequent, ["key"], "_id", "left_semi").groupBy(F.col("_id").alias("_drop_id")).agg(F.collect_set("key").alias("_drop"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, dropped, digests = [], [], [], []
        for text, drop in zip(utf8(batch, "_text"), batch.column("_drop").to_pylist(), strict=True):
            every = text.split(b"\n")
            gone = set(drop or ())
            kept = [x for x in every if _hash(line_key(x)) not in gone] if gone else every
            texts.append(b"\n".join(kept).decode("utf-8", "replace"))
            lines.append(len(every))
            dropped.append(len(every) - len(kept))
            digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], ["_id", "kept_text", "n_lines", "n_dropped", "kept_sha256"])

    joined = rows.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")), "left").select("_id", "_text", "_drop")
    return map_batches(joined, cut, f"_id {id_type}, kept_text string, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("_id", id_col)
