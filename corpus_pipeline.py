"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and all but the last return the columns of ``docs``.

toxicity: documents that the classifier rejects go. exact dedup: of equal texts the one with the largest id stays. near dedup: of each group of
near duplicates the smallest id stays. mixing: sources are brought to tempered weights by reading small ones more often, to ENTROPY_RATIO of the largest entropy if
MAX_REPEATS times are enough; every document stays at least once, so that no clean text is lost. sentencepiece: ids, as counts and checksums, and whether decoding gives the text back.

Defined results: rows with a null id pass the filters that need ids to compare and are never a duplicate's representative unless all its copies lack ids too;
null texts count as empty; empty tables stay empty; documents without words are not repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from testlattice.llm import exact_dedup as exact
from testlattice.llm import mixing, near_dedup, queries, sentencepiece_codec
from testlattice.llm import toxicity as toxic
from testlattice.llm.common import ready, table

ENTROPY_RATIO, MAX_REPEATS = 0.88, 1.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxic.toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.where("predicted = 0").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = exact.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    own = docs.withColumn("_own", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return own.join(stays, (F.col("_own") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "_own"]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = near_dedup.near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn, by a key of id, source and text: rows that share an id are drawn apart, and rows equal in all three share their draws."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    own = docs.withColumn("_key", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), text)))
    mix = mixing.mix_sources(own, id_col="_key", entropy_ratio=ENTROPY_RATIO, max_repeats=MAX_REPEATS, budget="cover")
    times = mix.groupBy("_key").agg(F.count(F.lit(1)).alias("_times"))
    rows = own.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    turn = F.when(F.col("_rows").isNull(), F.lit(0)).otherwise(F.row_number().over(W.partitionBy("_key").orderBy("doc_id")) - 1)
    counted = own.join(rows, "_key", "left").join(times, "_key", "left").withColumn("_turn", turn)
    share = F.floor(F.col("_times") / F.coalesce("_rows", F.lit(1))) + F.when(F.col("_turn") < F.col("_times") % F.coalesce("_rows", F.lit(1)), 1).otherwise(0)
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(share, F.lit(1)), F.lit(1)).cast("int")))).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(docs, queries.tokenizer_file(spark, "piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Training a classifier and MinHash have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; every result is written to the shared folder and read again."""
    from testlattice.llm.token_file import shared_path

    docs = table(ready(spark), sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
