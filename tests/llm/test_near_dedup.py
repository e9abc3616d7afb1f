import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from testlattice.llm import near_dedup as nd
from testlattice.llm.graph import components


def brute(docs):
    """(n_shingles, component_id, kept) of each id, from tuples of words and all pairs that share a shingle."""
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\x0b", " ")
        for c in "\t\n\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), i == root(i)) for i, s in sets.items()}


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 8, 20, 70, 90, 300]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(" ".join(own))
    for _ in range(50):  # the passage in ever new surroundings
        docs.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([8, 16, 30]))]))
    docs += ["", None, "  \n", "one", "ONE", "One two", "one  two", docs[0], docs[0].upper()]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("crowd", [32, 2])
def test_same_as_brute_force(spark, crowd):
    docs = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(df, crowd=crowd).collect()}
    assert got == brute(docs)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(df).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True)], key=str)
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for n, share in ((400, 0.8), (5000, 0.5), (20000, 0.9)):
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64) * np.uint64(2)])) for _ in "ab")
        both, either = nd.similarity(a, b)
        got, _ = nd.estimate(nd.sketch(a), nd.sketch(b), len(a), len(b))
        assert abs(got - both / either) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def border_family(seed=3, families=6):
    """Short texts of 60 shingles, in 80, in 100, and hot third texts that hold the last ones but aren't linked with them."""
    rng = random.Random(seed)
    docs = []
    for f in range(families):
        words = lambda n, f=f: [f"f{f}x{rng.randrange(10**6)}" for _ in range(n)]
        v = words(104)
        docs += [v, v[:84], v[:64]]
        for _ in range(12):  # near copies make the short text a pivot
            own = v[:64]
            own[rng.randrange(1, 63)] = words(1)[0]
            docs.append(own)
        for _ in range(24):
            hot = v + words(36)
            docs.append(hot)
            for _ in range(6):
                own = list(hot)
                own[rng.randrange(len(own))] = words(1)[0]
                docs.append(own)
    docs = [" ".join(x) for x in docs]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_size_border_with_hot_texts(spark):
    docs = border_family()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(df).collect()}
    assert got == brute(docs)


def test_ids_with_several_texts_in_any_order(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(60), words(60), words(60)
    text = " ".join
    rows = [(1, text(a)), (1, text(b)), (2, text(a + ["m"])), (3, text(b + ["cc"])), (0, text(c)), (7, text(c)), (7, text(a[:58])), (9, text(c[:57])), (11, text(words(40))), (11, ""), (12, text(words(9))), (None, text(a))]
    links = {1: 0, 2: 0, 3: 0, 0: 0, 7: 0, 9: 0, 11: 11, 12: 12, None: 0}
    for k in range(3):
        rng.shuffle(rows)
        got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + k), crowd=(2048, 1, 3)[k]).collect()
        assert len(got) == len(rows) and all(r["component_id"] == links[r["doc_id"]] for r in got), got
    first = [r for r in rows if r[0] in (1, 2, 3)]
    got = nd.near_dedup(spark.createDataFrame(first, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False)}


def test_blocks_join_the_same_components(spark):
    """Blocks of any size find links that join what is linked, and no others."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k : k + 150]) for k in (0, 0, 4, 8, 12, 28, 44, 200)]
    docs = [(i, t + f" end{i}") for i, t in enumerate(texts)]
    rows = spark.createDataFrame(docs, "node long, _text string")
    nodes = nd._marks(rows.withColumnRenamed("node", "_id")).withColumnRenamed("_id", "node").join(nd._sets(rows), "node")
    held = nd._groups(nodes)
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    sets = {i: set(nd.shingles(t.encode()).tolist()) for i, t in docs}
    for crowd in (1, 2, 3, 100):
        links = [(r["a"], r["b"]) for r in nd._apart(held, labels, nodes, crowd).collect()]
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (0, 1)], "a long, b long")).collect()}
        assert {i: got.get(i, i) for i, _ in docs} == {i: c for i, (_, c, _) in brute(docs).items()}


def test_very_long_text_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words), 5, "x"), (2, " ".join(words[:140_000]), 6, "y"), (3, " ".join(words[:90_000]), 7, "z"), (4, "short", 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(df).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])
