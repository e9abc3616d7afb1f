import pytest

cp = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    from collections import Counter

    from test_near_dedup import brute

    stages = dict(cp.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    clean = cp.toxicity_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    gone = rows.keys() - left
    assert sum(labels.get(i, 1) for i in gone) >= 0.9 * len(gone) and len(left) > 0.8 * len(rows)

    exact = stages["exact_dedup"](spark, docs, SF)
    best = {}
    for i, r in rows.items():
        best[r["text"]] = max(best.get(r["text"], i), i)
    assert exact.columns == docs.columns and {r["doc_id"] for r in exact.collect()} == set(best.values())

    near = stages["near_dedup"](spark, docs, SF)
    want = {i for i, (_, _, kept) in brute([(i, r["text"]) for i, r in rows.items()]).items() if kept}
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == want

    mixed = stages["source_mixing"](spark, docs, SF)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and times.keys() == rows.keys() and max(times.values()) <= 2


def test_run_and_odd_tables(spark, tmp_path):
    import sentencepiece

    odd = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (None, "one two three four five six", "en", "", 3), (4, "", "en", "s", 0), (4, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = {(r["doc_id"], r["n_tokens"]) for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == {(2, len(own.encode("a b c d e f"))), (4, 0), (None, len(own.encode("one two three four five six")))}
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert cp.run(spark, str(empty)).count() == 0


def test_mixing_of_rows_that_share_an_id(spark):
    """Rows of one id are drawn apart; nothing is doubled by its namesakes."""
    from collections import Counter

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "d e f", "en", "s", 5), (2, "g h i", "en", "s", 5)]
    got = Counter(tuple(r) for r in cp.mixing_stage(spark, spark.createDataFrame(rows, schema), SF).collect())
    assert got == Counter(rows)
    rows += [(1, "a b c", "de", "s", 5)] * 2 + [(None, "j k l", "en", None, 5), (None, None, "en", None, 0)]
    got = Counter(tuple(r) for r in cp.mixing_stage(spark, spark.createDataFrame(rows, schema), SF).collect())
    assert got.keys() == set(rows) and all(got[r] >= n for r, n in Counter(rows).items()) and sum(n for r, n in got.items() if r[3]) <= 8


def test_sentencepiece_stage_against_the_library(spark):
    import zlib

    import numpy as np
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = own.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in cp.sentencepiece_stage(spark, docs, SF).collect()} == want


def test_driver_keeps_little_of_training(spark, monkeypatch):
    """The training sample comes as Arrow and the words' flags as bitmaps, not as a row object for each; freed native memory goes back."""
    import zlib

    from pyspark.sql.classic.dataframe import DataFrame

    from testlattice.llm import common, toxicity

    came, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (came.append(len(rows)), rows)[1])(collect(self)))
    docs = spark.createDataFrame([(i, f"word{'abcdefgh'[i % 8]} {'nasty' if i % 5 == 0 else 'kind'} thing") for i in range(3000)], "doc_id long, text string")
    weights, _ = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 5 = 0) toxic"))
    assert weights["nasty"] > 0 and max(came) <= 64
    words = ["a", "bc", "d\u00e9f", *map(str, range(500))]
    flags = toxicity._flags(spark.createDataFrame([(w,) for w in words], "word string"))
    assert len(flags) == toxicity.PLACES and {i for i, x in enumerate(flags) if x} == {zlib.crc32(w.encode()) % toxicity.PLACES for w in words}
    trimmed = []
    monkeypatch.setattr(common, "trim_driver", lambda s, own=common.trim_driver: trimmed.append(own(s)))
    common.release(spark)
    assert trimmed == [True]
