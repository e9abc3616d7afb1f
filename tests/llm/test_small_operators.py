import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from testlattice.llm import exact_dedup as ex
from testlattice.llm import line_dedup as ld
from testlattice.llm import mixing as mx
from testlattice.llm import sentencepiece_codec as sp
from testlattice.llm import toxicity as tx

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_fingerprints_compose():
    data = random.Random(0).randbytes(3 * ex.CHUNK_BYTES + 77)
    want = tuple(0 for _ in ex.PRIMES)
    for b in data[:500]:
        want = tuple((w * r + b + 1) % p for w, r, p in zip(want, ex.POINTS, ex.PRIMES, strict=True))
    assert ex.fingerprint(data[:500]) == want
    for k in (0, 1, 65536, 100_000, len(data)):
        assert ex.combine(ex.fingerprint(data[:k]), ex.fingerprint(data[k:]), len(data) - k) == ex.fingerprint(data)
    assert ex.fingerprint(b"\0a") != ex.fingerprint(b"a")


@pytest.mark.parametrize("primes, huge", [(ex.PRIMES, 8 << 20), (ex.PRIMES, 10), ((2, 2, 2, 2), 8 << 20)])
def test_exact_dedup(spark, primes, huge):
    texts = ["a", "b", "a", "", None, "c" * 70_000, "c" * 70_000, "c" * 69_999 + "d", "é", "é", "b "] + ["x"] * 30
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, keep_id int")
    got = {r["doc_id"]: tuple(r)[1:] for r in ex.exact_dedup(df, primes=primes, huge_bytes=huge).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (5, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((tuple(r)[:4] for r in ex.exact_dedup(df).collect()), key=str) == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True)], key=str)
    assert ex.exact_dedup(df.limit(0)).count() == 0


def test_line_dedup(spark):
    common, rng = "  Terms of USE\t", random.Random(1)
    texts = ["\n".join(rng.sample([f"l{k}" for k in range(30)], 5) + [common, ""]) for _ in range(30)] + [None, "", "x\r\n  x", "terms of use", "ÉCLAIR\néclair"]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for least, chars in ((10, 1), (3, 1), (2, 3)):
        docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
        got = {r["doc_id"]: r for r in ld.line_dedup(df, min_docs=least, min_chars=chars).collect()}
        for i, t in enumerate(texts):
            every = (t or "").split("\n")
            kept = [x for x in every if docs[key(x)] < least or len(key(x)) < chars]
            r = got[i]
            assert (r["kept_text"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) == ("\n".join(kept), len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert ld.line_dedup(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "a\nb")] * 2 + [(1, "a")] * 2, "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in ld.line_dedup(repeated, min_docs=4).collect()) == [1, 1, 1, 1]


def mixed(spark, rows, **options):
    return mx.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), **options).collect()


def test_mixing_weights_and_budget(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["big"] * 12 + ["mid"] * 4 + ["small"])) for i in range(900)]
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    out = mixed(spark, rows, entropy_ratio=0.9, max_repeats=3.0, block_tokens=500)
    alpha, total = out[0]["alpha"], sum(tokens.values())
    power = {s: (t / total) ** alpha for s, t in tokens.items()}
    weights = {s: p / sum(power.values()) for s, p in power.items()}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert abs(entropy - 0.9 * math.log(3)) < 1e-4 or max(weights[s] * total / tokens[s] for s in tokens) == pytest.approx(3.0, rel=1e-4)
    drawn, epochs = Counter(), defaultdict(Counter)
    for r in out:
        assert r["weight"] == pytest.approx(weights[r["source"]], abs=1e-8)
        drawn[r["source"]] += r["n_tokens"]
        epochs[r["source"]][r["doc_id"]] += 1
    for s, t in tokens.items():
        quota = weights[s] * total
        assert quota - 1 <= drawn[s] < quota + 31
        assert max(epochs[s].values()) - (min(epochs[s].values()) if len(epochs[s]) == sum(x[2] == s for x in rows) else 0) <= 1 and max(epochs[s].values()) <= math.ceil(quota / t)
    blocks = defaultdict(list)
    for r in out:
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in blocks.values()) and len(blocks) == math.ceil(total / 500)


def test_mixing_covers_everything_on_request(spark):
    rows = [(i, "w w w", f"s{min(9, int(i**0.5) // 2)}") for i in range(400)]
    out = Counter(r["doc_id"] for r in mixed(spark, rows, budget="cover", max_repeats=2.0))
    assert out.keys() == set(range(400)) and max(out.values()) == 2


def test_mixing_of_odd_tables(spark):
    assert {(r["doc_id"], r["source"]) for r in mixed(spark, [(1, "a", None), (2, None, "x"), (3, " ", "x"), (None, "b", "")])} == {(1, ""), (None, "")}
    assert mixed(spark, []) == [] and mixed(spark, [(1, None, "x")]) == []


def test_sentencepiece_parity(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  a  b "), (-4, "▁x ▁"), (-5, "\U0001f600\x00é"), (-6, "a" * 3000), (-7, "<s> </s>")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.unionByName(odd).collect()}
    whole = {r["doc_id"]: r for r in sp.encode(docs.unionByName(odd), MODEL, verify=True).collect()}
    short = {r["doc_id"]: r for r in sp.encode_digest(docs.unionByName(odd), MODEL).collect()}
    for i, t in texts.items():
        want = own.encode(t)
        assert whole[i]["ids"] == want and whole[i]["round_trip"] and whole[i]["decoded"] == t.replace("▁", " ")
        assert (short[i]["n_tokens"], short[i]["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert short[i]["decoded_sha256"] == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest() and short[i]["round_trip"]
    assert sp.encode_digest(docs.limit(0), MODEL).count() == 0


def test_unigram_models_are_rebuilt():
    model = sp.PieceModel(pieces=["<unk>", "▁a", "▁ab", "b", "c", "▁"], scores=[0.0, -1.0, -1.5, -2.0, -3.0, -4.0], types=[sp.UNKNOWN] + [sp.NORMAL] * 5, kind=sp.UNIGRAM, squeeze=True)
    assert sp.rebuild(model).encode(" ab  ac ", add_special_tokens=False).ids == [2, 1, 4]


def test_positive_unlabelled_training():
    rng = np.random.default_rng(0)
    row = lambda toxic: np.unique(np.concatenate([rng.integers(5, 60, 8), rng.integers(0, 5, 2) if toxic else np.zeros(0, int)])).astype(int)
    positive, unlabelled = [row(True) for _ in range(200)], [row(i % 8 == 0) for i in range(800)]
    w = tx.train(positive, unlabelled, 60, 1 / 8)
    score = lambda r: 1 / (1 + np.exp(-w[r].sum() - w[-1]))
    assert np.mean([score(row(True)) >= 0.7 for _ in range(300)]) > 0.9 and np.mean([score(row(False)) >= 0.7 for _ in range(300)]) < 0.02


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = tx.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    own = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught, false = sum(p for p, y in own if y), sum(p for p, y in own if not y)
    assert caught >= 0.7 * sum(y for _, y in own) and false <= 0.03 * sum(1 - y for _, y in own)


def test_toxicity_counts_words_over_all_training_rows(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"wörd{chr(97 + i)}" for i in rng.integers(0, 20, rng.integers(0, 30))) for _ in range(120)] + [None, "", "wörda WÖRDA wörd"]
    rows = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    want = {}
    for t in texts:
        for w in tx.features(t or ""):
            want[w] = want.get(w, 0) + 1
    for most in (3, 100_000):
        assert {r["word"]: r["n"] for r in tx.word_counts(rows, most=most).collect()} == want
    places = bytearray(tx.PLACES)
    places[spark.sql(f"SELECT pmod(crc32(CAST('wörda' AS BINARY)), {tx.PLACES}) AS at").first()["at"]] = 1
    assert {r["word"]: r["n"] for r in tx.word_counts(rows, bytes(places)).collect()} == {"wörda": want["wörda"]}


def test_toxicity_knows_words_too_rare_for_the_sample(spark):
    plain = [f"calm river stone {i % 7} meadow" for i in range(900)]
    docs = spark.createDataFrame([(i, t + (" vilewords" if i % 60 == 0 else " nastier" if i % 6 == 0 else "")) for i, t in enumerate(plain)], "doc_id long, text string")
    labels = docs.select("doc_id", (docs.doc_id % 6 == 0).cast("int").alias("toxic"))
    weights, _ = tx.fit(docs, labels, max_positive=6, max_unlabelled=12, least_z=2.0)
    assert weights["vilewords"] > 0 and weights["nastier"] > 0


def test_toxicity_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (None, None, 0.1), (2, "", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tx.toxicity(docs, none).collect()
    assert len(out) == 3 and {r["predicted"] for r in out} == {0} and len({r["score"] for r in out}) == 1
    assert tx.toxicity(docs.limit(0), none).count() == 0


def test_sentencepiece_digests_check_every_text():
    own = sp.Codec(MODEL)
    texts = ["one two three", "", "a  b\n"]
    assert [x[0] for x in sp.digests(own, texts)] == [len(own.plain.encode(x)) for x in texts]
    unit = next(u for u in own.memo.now if "three" in u)
    own.memo.now[unit] += b"\5\0\0\0"  # a text on which the rebuilt tokenizer is wrong
    with pytest.raises(AssertionError, match="differs"):
        sp.digests(own, ["none here", "one two three"])


def test_sentencepiece_checks_every_new_unit():
    own = sp.Codec(MODEL)
    from tokenizers import Tokenizer, models

    merges = sp.merges_of(own.model)[::-1]  # merges in a wrong order
    own.units = Tokenizer(models.BPE({p: i for i, p in enumerate(own.model.pieces)}, merges, unk_token="<unk>", fuse_unk=True, byte_fallback=True))
    with pytest.raises(AssertionError, match="differs"):
        sp.digests(own, ["an extraordinarily misunderstood internationalisation"], whole=False)


def test_sentencepiece_with_repeats_clashing_columns_and_long_texts(spark):
    long = "words and more  words\n" * 50_000
    rows = [(1, "a b", 3, "x"), (1, "a b", 3, "x"), (2, long, 0, "y"), (None, None, 1, "z")]
    got = [tuple(r) for r in sp.encode_digest(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded_sha256 string"), MODEL).collect()]
    own = sp.Codec(MODEL).plain
    want = [(i, len(ids := own.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_memo_keeps_frequent_words():
    made = []
    memo = sp.Memo(lambda words: made.extend(words) or [w * 2 for w in words], 3)
    for k in range(20):
        get = memo.learn([["often", f"rare{k}"]])
        assert (get("often"), get(f"rare{k}")) == ("oftenoften", f"rare{k}" * 2)
        assert len(memo.now) + len(memo.before) <= 10
    assert made.count("often") == 1 and len(made) == 21


def brute_train(positive, unlabelled, n, prior, rounds=400, rate=0.1, decay=1e-4):
    """The non-negative estimator with dense rows, loops over rows, and Adam written out."""
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)

    def dense(rows):
        out = np.zeros((len(rows), n + 1))
        out[:, n] = 1
        for i, r in enumerate(rows):
            for c in r:
                out[i, c] += 1
        return out

    p, u = dense(positive), dense(unlabelled)
    for step in range(1, rounds + 1):
        risk_u = np.mean([np.log1p(np.exp(x @ w)) for x in u])
        risk_p = np.mean([np.log1p(np.exp(x @ w)) for x in p])
        sigma = lambda x: 1 / (1 + np.exp(-(x @ w)))  # noqa: B023, E731
        of_u = sum(sigma(x) * x for x in u) / len(u)
        of_p = sum(sigma(x) * x for x in p) / len(p)
        to_p = sum((sigma(x) - 1) * x for x in p) / len(p)
        g = prior * to_p + of_u - prior * of_p if risk_u - prior * risk_p >= 0 else prior * of_p - of_u
        g[:n] += decay * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def test_training_against_brute_force():
    rng = np.random.default_rng(4)
    for prior in (0.05, 0.5):
        rows = lambda k: [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(k)]
        positive, unlabelled = rows(15), rows(40)
        assert np.allclose(tx.train(positive, unlabelled, 12, prior, rounds=60), brute_train(positive, unlabelled, 12, prior, rounds=60), atol=1e-6)


def test_very_long_texts_and_clashing_columns(spark):
    long = "idle words go on\n" * 150_000
    docs = spark.createDataFrame([(1, long, "s", 0.5, 3), (2, "x", "s", 0.5, 3), (3, "x", "s", 0.5, 3)], "doc_id long, text string, source string, score double, n_lines int")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels).collect()}
    assert len(scored) == 3 and all(0 <= s <= 1 for s in scored.values()) and scored[2] == scored[3]
    from testlattice.llm import line_dedup, mixing

    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs, min_docs=2).collect()}
    assert got == {1: (150_001, 0), 2: (1, 1), 3: (1, 1)}
    mix = mixing.mix_sources(docs.withColumn("block", F.lit("b")).withColumn("alpha", F.lit("a"))).collect()
    assert sorted(r["doc_id"] for r in mix) == [1, 2, 3] and {r["n_tokens"] for r in mix} == {600_000, 1}
