"""Exact dedup with composable polynomial fingerprints.

A text's fingerprint is its UTF-8 bytes read as a polynomial at a fixed point, modulo four 31-bit primes. The
fingerprint of a concatenation follows from its parts, ``H(xy) = H(x) * r^|y| + H(y)``, so chunks are hashed apart:
inside one task for ordinary texts, and as rows of their own, on any executor, for texts above ``huge_bytes``.

Rows with equal fingerprint and length are candidates. They are then compared chunk by chunk: for every chunk
position of a group the smallest and the largest chunk are kept, which agree exactly if all members agree. That is an
aggregation with map-side combine, so a group that holds a third of all rows is compared as a stream in each task and
only two chunks a task and position are shuffled. A group in which some position disagrees (a fingerprint collision)
is divided by SHA-256 and length instead.

Defined results: null counts as the empty text; the row with the largest id stays (null ids sort below all others);
rows that repeat an id and a text are one group and each has its row in the result, ``kept`` being true for all rows with the
id that stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, salted_join, utf8

# The four largest primes below 2^31 and the points at which the polynomials are taken.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
POINTS = (1000003, 1299709, 15485863, 32452843)
CHUNK_BYTES = 65536

_powers: dict[tuple, np.ndarray] = {}


def _power_table(point: int, prime: int) -> np.ndarray:
    """r^(CHUNK_BYTES-1), ..., r, 1 modulo the prime."""
    if (point, prime) not in _powers:
        out = np.ones(CHUNK_BYTES, np.int64)
        done = 1
        while done < CHUNK_BYTES:  # out[-1-i] = r^i, doubled
            step = pow(point, done, prime)
            out[CHUNK_BYTES - 2 * done : CHUNK_BYTES - done] = out[CHUNK_BYTES - done :] * step % prime
            done *= 2
        _powers[point, prime] = out
    return _powers[point, prime]


def chunk_hash(chunk: bytes, primes: tuple = PRIMES) -> tuple:
    """Residues of one chunk of at most CHUNK_BYTES bytes; 1 is added to each byte so that leading zero bytes count."""
    data = np.frombuffer(chunk, np.uint8).astype(np.int64) + 1
    return tuple(int(np.dot(data, _power_table(r, p)[CHUNK_BYTES - len(data) :]) % p) for r, p in zip(POINTS, primes, strict=False))


def combine(left: tuple, right: tuple, right_bytes: int, primes: tuple = PRIMES) -> tuple:
    """The fingerprint of x followed by y, from those of x and y and the length of y."""
    return tuple((a * pow(r, right_bytes, p) + b) % p for a, b, r, p in zip(left, right, POINTS, primes, strict=False))


def fingerprint(data: bytes, primes: tuple = PRIMES) -> tuple:
    out = (0,) * len(primes)
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        out = combine(out, chunk_hash(part, primes), len(part), primes) if at else chunk_hash(part, primes)
    return out


def _packed(residues: tuple) -> bytes:
    return b"".join(x.to_bytes(4, "big") for x in residues)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, primes: tuple = PRIMES, huge_bytes: int = 8 << 20) -> DataFrame:
    """``_id``, ``_fp`` binary, ``_bytes``, ``text_sha256`` for each row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def direct(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch, "_text")
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([_packed(fingerprint(t, primes)) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            ["_id", "_fp", "_bytes", "text_sha256"],
        )

    small = map_batches(rows.where(F.octet_length("_text") <= huge_bytes), direct, f"_id {id_type}, _fp binary, _bytes long, text_sha256 string")
    huge = rows.where(F.octet_length("_text") > huge_bytes).withColumn("text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    parts = huge.select("text_sha256", F.octet_length("_text").alias("_bytes"), F.posexplode(chunks(F.col("_text").cast("binary"))).alias("_no", "_chunk")).dropDuplicates(["text_sha256", "_no"])

    def hash_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = utf8(batch, "_chunk")
        return pa.RecordBatch.from_arrays([batch.column("text_sha256"), batch.column("_no"), pa.array([len(x) for x in got], pa.int64()), pa.array([_packed(chunk_hash(x, primes)) for x in got], pa.binary())], ["text_sha256", "_no", "_len", "_h"])

    hashed = map_batches(parts, hash_parts, "text_sha256 string, _no int, _len long, _h binary")

    def together(part: pd.DataFrame) -> pd.DataFrame:
        out: tuple = (0,) * len(primes)
        for h, n in part.sort_values("_no")[["_h", "_len"]].itertuples(index=False):
            out = combine(out, tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, len(h), 4)), int(n), primes)
        return pd.DataFrame({"_sha": [part["text_sha256"].iloc[0]], "_fp": [_packed(out)], "_bytes": [int(part["_len"].sum())]})

    whole = hashed.groupBy("text_sha256").applyInPandas(together, "_sha string, _fp binary, _bytes long")
    large = huge.join(whole, F.col("text_sha256") == F.col("_sha")).select("_id", "_fp", "_bytes", "text_sha256")
    return small.unionByName(large)


def chunks(data: F.Column, size: int = CHUNK_BYTES) -> F.Column:
    """A binary column as an array of chunks; an empty one has one empty chunk."""
    last = F.greatest(F.floor((F.length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple = PRIMES, huge_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    marks = cut_lineage(fingerprints(docs, id_col, text_col, primes, huge_bytes))
    several = marks.groupBy("_fp", "_bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_fp", "_bytes")
    suspects = salted_join(marks, several, ["_fp", "_bytes"], "_id", "left_semi").select("_id", "_fp", "_bytes", "text_sha256")
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    pieces = (
        texts.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))
        .join(suspects.distinct(), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256")))
        .select("_fp", "_bytes", F.posexplode(chunks(F.col("_text").cast("binary"))).alias("_no", "_chunk"))
    )
    differ = pieces.groupBy("_fp", "_bytes", "_no").agg(F.min("_chunk").alias("_least"), F.max("_chunk").alias("_most")).where("_least <> _most").select("_fp", "_bytes").distinct().withColumn("_split", F.lit(True))
    keyed = salted_join(marks, differ, ["_fp", "_bytes"], "_id", "left").withColumn("_part", F.when(F.col("_split"), F.col("text_sha256")).otherwise(F.lit("")))
    groups = keyed.groupBy("_fp", "_bytes", "_part").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = salted_join(keyed, groups, ["_fp", "_bytes", "_part"], "_id", "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")))
    return out.select(F.col("_id").alias(id_col), "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
