"""Repeated rows, ties, several labels and very long texts."""

import hashlib
import random
import zlib
from collections import Counter

from testlattice.llm import line_dedup as ld
from testlattice.llm import media as md
from testlattice.llm import mixing as mx
from testlattice.llm import toxicity as tx


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "d e", "x"), (2, "d e", "y"), (None, "f", "y"), (None, "f", "y")] + [(k, "w", "y") for k in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mx.mix_sources(docs.repartition(3), entropy_ratio=0.5, max_repeats=4.0, block_tokens=4).collect()
    once = Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0)
    held = Counter((i, s) for i, _, s in rows)
    assert all(n <= held[k] for k, n in once.items()) and {r["source"] for r in out} == {"x", "y"}
    blocks = Counter((r["block"], r["slot"]) for r in out)
    assert max(blocks.values()) == 1
    again = mx.mix_sources(docs.repartition(5), entropy_ratio=0.5, max_repeats=4.0, block_tokens=4).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_media_of_repeated_rows_and_a_very_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc é\n") for _ in range(1_500_000))
    rows = [(1, "same"), (2, "same"), (2, "same"), (None, None), (None, ""), (3, long)]
    out = md.media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6
    same = {tuple(r)[1:6] for r in out if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and len({tuple(r)[1:6] for r in out if r["doc_id"] is None}) == 1
    (big,) = [r for r in out if r["doc_id"] == 3]
    data = long.encode()
    payload = data.ljust(-(-len(data) // 64) * 64, b"\0")
    assert (big["n_bytes"], big["payload_bytes"], big["payload_sha256"], big["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert big["shots"][-1]["end_frame"] == len(payload) // 64 and hashlib.sha256(big["media"]).hexdigest() == big["media_sha256"]


def test_toxicity_of_repeated_rows_and_several_labels(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["sun", "rain", "wind", "tree"], k=6) + (["vileword"] if i % 4 == 0 else []))) for i in range(160)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(160)]
    plain = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), threshold=0.5).collect()}
    doubled = spark.createDataFrame(labels + [(i, 0) for i in range(160)] + labels[:9] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = tx.toxicity(docs, doubled, threshold=0.5).collect()
    assert len(out) == 190 and all(abs(r["score"] - plain[r["doc_id"]]) < 1e-9 for r in out)
    scores = {}
    for r in out:
        scores.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in scores.values())
    assert min(s for i, s in plain.items() if i % 4 == 0) > max(s for i, s in plain.items() if i % 4)


def test_line_dedup_of_many_null_ids(spark):
    rows = [(None, f"common\nown {k}") for k in range(300)] + [(k, "common\nalone") for k in range(5)]
    out = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert len(out) == 305 and {r["n_dropped"] for r in out} == {1} and {r["kept_text"] for r in out} == {f"own {k}" for k in range(300)} | {"alone"}
