"""Toxicity: non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and a sample of texts of any kind (U); no text is taken as clean. With class
prior ``pi`` and logistic loss, the risk of a linear classifier is ``pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))``; where
the second part turns negative, the step goes up it instead of down (the non-negative estimator). The prior is the share of toxic
rows among all labelled training rows.

Features are present or absent: a text's distinct lower-cased words, whole and as prefixes of 4 to 8 letters, so that a
rare ending doesn't hide a known stem, and the length of a text doesn't add to its score. Words are counted on the executors over
every training row: those in at least 3 toxic rows stay that are more frequent there than in all rows by a two-proportion z test.

The gradient steps see the ``max_positive`` toxic and ``max_unlabelled`` other training rows with the smallest hash of their id; these bounds
keep what the driver holds small at every input size. A word that none of them has, too rare for the sample, gets its weight from the counts: the
logarithm of its ratio in toxic and in all rows, divided by the forms of a word, as these occur together.
What reaches the driver is at most ``max_features`` words and the sampled rows' places in that list. Every row of the table is scored, from its whole text.

Defined results: null counts as empty; a text without known words gets the classifier's bias; without labels or
positives the score is the prior for all rows; a doc_id with several labels is toxic if any says so.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, map_batches, ready, utf8

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)

#: Flags of words that toxic rows have; workers send no other word. Words that share a flag cost rows, not results.
PLACES = 1 << 20


def features(text: str) -> set[str]:
    words = set(WORDS.findall(text.lower()))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) >= k} for k in PREFIXES)) if words else words


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear classifier on sets of feature numbers below ``n``; the last weight is the bias."""

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0)]).astype(np.int64), len(rows)

    sets = sparse(positive), sparse(unlabelled)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)

    def margin(rows):
        at, col, size = rows
        return np.bincount(at, w[col], size) + w[n]

    def gradient(rows, slope):
        at, col, _ = rows
        out = np.bincount(col, slope[at], n + 1)
        out[n] += slope.sum()
        return out

    for step in range(1, rounds + 1):
        fp, fu = margin(sets[0]), margin(sets[1])
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        second = gradient(sets[1], uu / len(uu)) - prior * gradient(sets[0], up / len(up))
        g = prior * gradient(sets[0], (up - 1) / len(up)) + second if negative >= 0 else -second
        g[:n] += decay * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def held_out(id_col: F.Column) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def _smallest(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` ids with the smallest hash. Hashes that cannot be among them are left out first, so that the sort sees about twice as many rows as it keeps."""
    n = ids.count()
    if n > 4 * most:
        ids = ids.where(F.xxhash64("_id") <= F.lit(int(-(2**63) + 2**64 * 2 * most / n)))
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(most)


def word_counts(rows: DataFrame, places: bytes | None = None, most: int = 100_000) -> DataFrame:
    """(word, n): how many rows of ``rows`` (_text) have a word. A task adds up before it sends, at most about ``most`` words at a time.

    With ``places``, PLACES flags, words whose place isn't set are left out.
    """
    ready(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = [w for w in counts if places is None or places[zlib.crc32(w.encode("utf-8")) % PLACES]]
            for at in range(0, len(words), 20_000):
                own = words[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([counts[w] for w in own], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in utf8(batch, "_text"):
                counts.update(features(text.decode("utf-8", "replace")))
                if len(counts) > most:
                    yield from flush()
        yield from flush()
        give_back()

    return rows.select("_text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _flags(words: DataFrame) -> bytes:
    """PLACES flags, set where a word of ``words`` has its CRC-32; they come to the driver as bitmaps."""
    at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(PLACES)).cast("long") + 1  # Spark counts buckets from 1, and their places from 0
    maps = words.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    flags = np.zeros(PLACES, np.uint8)
    for r in maps.collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        flags[(r["bucket"] - 1) * len(own) :][: len(own)] = own
    return flags.tobytes()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 5000, max_unlabelled: int = 10000, max_features: int = 20000, least_z: float = 4.0) -> tuple[dict[str, float], float]:
    """Weights of words and the bias, learnt from rows that aren't held out."""
    ready(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    marks = labels.select(F.col(id_col).alias("_id"), "toxic").where(F.col("_id").isNotNull() & ~held_out(F.col("_id")) & F.col("toxic").isNotNull()).groupBy("_id").agg((F.max("toxic") >= 1).alias("toxic"))
    counts = marks.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).first()
    prior = min(0.9, max(1e-4, counts["toxic"] / counts["n"])) if counts["n"] else 1e-4
    bad = marks.where("toxic").select("_id", F.lit(True).alias("p"))
    # Toxic ids grow with the input: never broadcast.
    toxic_rows = own.join(bad.hint("merge"), "_id")
    n_p, n_u = toxic_rows.select("_id").count(), own.count()
    if not n_p:
        return {}, float(np.log(prior / (1 - prior)))
    in_p = cut_lineage(word_counts(toxic_rows).where("n >= 3").withColumnRenamed("n", "in_p"))
    in_u = word_counts(own, _flags(in_p)).withColumnRenamed("n", "in_u")
    a, b = F.col("in_p") / n_p, F.col("in_u") / n_u
    pooled = (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + F.lit(1e-12))
    top = in_p.join(in_u, "word").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(max_features).select("word", F.log(a / b).alias("ratio")).toArrow()
    words, ratios = top.column("word").to_pylist(), top.column("ratio").to_pylist()
    positive = _smallest(own.select("_id").join(bad, "_id", "left_semi").distinct(), max_positive).withColumn("p", F.lit(True))
    unlabelled = _smallest(own.select("_id").distinct(), max_unlabelled).withColumn("u", F.lit(True))
    chosen = positive.join(unlabelled, "_id", "full").select("_id", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("u", F.lit(False)).alias("u"))
    sample = own.join(chosen, "_id")
    number = {w: i for i, w in enumerate(words)}

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sorted(number[w] for w in features(x.decode("utf-8", "replace")) & number.keys()) for x in utf8(batch, "_text")]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("p"), batch.column("u"), batch.column("_id").cast(pa.string())], ["rows", "p", "u", "_key"])

    # As Arrow: row objects with a Python number for each word took several times the memory, here and in the driver's JVM.
    got = map_batches(sample, place, "rows array<int>, p boolean, u boolean, _key string").toArrow()
    rows, keys = [np.asarray(x.values, np.int32) for x in got.column("rows")], got.column("_key").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (keys[i], rows[i].tolist()))
    in_p, in_u = got.column("p").to_pylist(), got.column("u").to_pylist()
    w = train([rows[i] for i in order if in_p[i]], [rows[i] for i in order if in_u[i]], len(words), prior)
    seen = np.zeros(len(words), bool)
    seen[np.concatenate([*rows, np.zeros(0, np.int32)])] = True
    del got, rows, keys, order, in_p, in_u
    give_back()
    return {x: float(w[i]) if seen[i] else ratios[i] / (1 + len(PREFIXES)) for x, i in number.items()}, float(w[-1])


def score_text(text: str, weights: dict[str, float], bias: float) -> float:
    total = bias + sum(weights[w] for w in sorted(features(text) & weights.keys()))
    return float(1 / (1 + np.exp(-max(-500.0, min(500.0, total)))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **bounds) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names give way."""
    weights, bias = fit(docs, labels, id_col, text_col, **bounds)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*kept)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score_text(x.decode("utf-8", "replace"), weights, bias) for x in utf8(batch, text_col)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, "score"])

    schema = rows.withColumn("score", F.lit(0.0)).schema
    return map_batches(rows, work, schema).select(*kept, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
