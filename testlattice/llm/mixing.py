"""Mixing sources to target weights, with DataFrame operations alone.

Source weights are token shares raised to an exponent and normalised. The exponent is bisected: every pass over the
(small) table of source totals evaluates the 31 inner points of the present interval, which are five bisection steps
at once. The exponent is the largest one that reaches the target entropy, raised as far as the repetition limit asks.

Each source gets ``weight * budget`` tokens. It is read in hash order, epoch after epoch with a new order each time,
until its tokens are used; the document that crosses the end still counts. The mix is cut into blocks: a document's
block follows from its place in its source's quota, so that each block holds every source in its weight, and the
inside of a block is permuted by hash.

Running sums of a source are taken in slices of the hash range, as many as the square root of its documents, so
that a source with a third of all rows is shared among many tasks.

Defined results: a null source counts as the source '' and a null text as empty; documents without words use no
tokens and are not drawn; an empty table gives an empty mix; repeated rows are drawn apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
PASSES, POINTS = 9, 31  # 5 bisection steps a pass


def source_totals(docs: DataFrame) -> DataFrame:
    """``source``, ``n_docs``, ``n_tokens`` from rows of (source, n_tokens)."""
    return docs.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _bisect(totals: DataFrame, holds: F.Column, low: float, high: float, largest: bool) -> float:
    """The largest (or smallest) exponent in [low, high] at which ``holds``, a condition on (entropy, most, spread), is true."""
    for _ in range(PASSES):
        step = (high - low) / (POINTS + 1)
        grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(POINTS)), lambda i: F.struct(i.alias("i"), (F.lit(low) + i * F.lit(step)).alias("a"))))
        power = F.pow(F.col("share"), F.col("g.a"))
        found = (
            totals.select("share", grid.alias("g"))
            .groupBy("g.i")
            .agg(F.sum(power).alias("z"), F.sum(power * F.col("g.a") * F.ln("share")).alias("zl"), F.max(power / F.col("share")).alias("ratio"), F.min(power / F.col("share")).alias("least"))
            .select("i", (F.ln("z") - F.col("zl") / F.col("z")).alias("entropy"), (F.col("ratio") / F.col("z")).alias("most"), (F.col("ratio") / F.col("least")).alias("spread"))
            .agg(F.max(F.when(holds, F.col("i"))).alias("last"), F.min(F.when(holds, F.col("i"))).alias("first"))
            .first()
        )
        if largest:
            k = found["last"] or 0
            low, high = low + k * step, low + (k + 1) * step
        else:
            k = found["first"] or POINTS + 1
            low, high = low + (k - 1) * step, low + k * step
    return round(low if largest else high, 6)


def temperature_weights(totals: DataFrame, entropy_ratio: float = 0.98, max_repeats: float = 4.0, budget: int | str | None = None) -> tuple[DataFrame, float]:
    """Weights of the sources and the exponent.

    ``entropy_ratio``: target entropy as a part of the largest possible, ln(number of sources). ``max_repeats``: how many times
    over a source may be read at most. ``budget``: tokens of the mix; all tokens once if None; "cover" for the least budget with which
    every source is read whole at least once. ``max_repeats`` is at least budget / all tokens, as no exponent could meet less.
    """
    whole = totals.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = whole["t"] or 0, whole["n"]
    cover = budget == "cover"
    budget = total if budget is None or cover else budget
    shares = cut_lineage(totals.withColumn("share", F.col("n_tokens") / F.lit(float(max(total, 1)))))
    alpha = 1.0
    if n > 1:
        alpha = _bisect(shares, F.col("entropy") >= F.lit(entropy_ratio * math.log(n)), 0.0, 1.0, largest=True)
        limit = max(max_repeats, budget / total)
        repeats = F.col("spread") if cover else F.col("most") * F.lit(budget / total)
        floor = _bisect(shares, repeats <= F.lit(limit * (1 + 1e-9)), 0.0, 1.0, largest=False)
        alpha = max(alpha, floor)
    power = F.pow(F.col("share"), F.lit(alpha))
    found = shares.agg(F.sum(power).alias("z"), F.min(power / F.col("share")).alias("least")).first()
    z = found["z"] or 1.0
    budget = math.ceil(total * z / found["least"]) if cover and found["least"] else budget
    weight = F.round(power / F.lit(z), 9)
    return shares.select("source", "n_docs", "n_tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + F.lit(0.5)).cast("long").alias("quota")), alpha


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_ratio: float = 0.98, max_repeats: float = 4.0, budget: int | str | None = None, block_tokens: int = 100_000, seed: int = 0) -> DataFrame:
    """The mix, one row for each document drawn: block, slot, ``id_col``, source, epoch, n_tokens, weight, alpha."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")).where("n_tokens > 0"))
    weights, alpha = temperature_weights(source_totals(rows), entropy_ratio, max_repeats, budget)
    weights = cut_lineage(weights.where("quota > 0").withColumn("slices", F.ceil(F.sqrt("n_docs")).cast("long")))
    sums = weights.agg(F.sum("quota").alias("quota"), F.sum("n_docs").alias("docs")).first()
    blocks = max(1, math.ceil((sums["quota"] or 0) / block_tokens))
    salts = math.ceil((sums["docs"] or 1) ** (1 / 3))  # a source's documents meet its weight in so many places
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    drawn = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .join(weights.withColumnRenamed("n_tokens", "have").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["source", "salt"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("have")).cast("long"))))
        .withColumn("key", key)
        .withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("slices") / F.lit(4294967296.0)).cast("long"))
    )
    within = W.partitionBy("source", "epoch", "slice").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source", "epoch").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = drawn.groupBy("source", "epoch", "slice").agg(F.sum("n_tokens").alias("t")).withColumn("slice_start", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    placed = (
        drawn.withColumn("in_slice", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(starts, ["source", "epoch", "slice"])
        .withColumn("start", F.col("epoch") * F.col("have") + F.col("slice_start") + F.col("in_slice"))
        .where("start < quota")
        .withColumn("block", F.floor(F.col("start").cast("double") / F.col("quota") * F.lit(float(blocks))).cast("long"))
    )
    slot = F.row_number().over(W.partitionBy("block").orderBy(F.md5(F.concat_ws("|", F.col("key"), F.col("source"))), "id")) - 1
    return placed.select("block", slot.cast("long").alias("slot"), F.col("id").alias(id_col), "source", "epoch", "n_tokens", "weight", F.lit(alpha).alias("alpha"))
