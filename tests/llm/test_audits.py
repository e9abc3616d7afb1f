"""Filter interaction audit, source divergence audit and byte-level BPE against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import tiktoken

from testlattice.llm import byte_bpe as bb
from testlattice.llm import filter_audit as fa
from testlattice.llm import radix_trie as rt
from testlattice.llm import source_audit as sa
from testlattice.llm.radix_trie import Leaf, Trie

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- filter audit


def plain_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 200) | 2 * (100 * len(set(words)) < 50 * len(words)) | 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) | 8 * bool(re.search(r"[#$%&*|]", text))


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    bits = [plain_bits(t or "") | 16 * (i is not None and i > smallest[t or ""]) for i, t, _ in rows]
    out, removed_by = {}, Counter()
    for order in permutations("ABCDE"):
        gone = [False] * len(rows)
        for step, f in enumerate(order, 1):
            bit = 1 << "ABCDE".index(f)
            now = defaultdict(Counter)
            for k, (i, _, part) in enumerate(rows):
                own = now[part or ""]
                fails = bool(bits[k] & bit)
                own["removed"] += fails and not gone[k]
                own["redundant"] += fails and gone[k]
                own["unique"] += bits[k] == bit
                own["good"] += fails and not gone[k] and i in good and i is not None
                own["toxic"] += fails and not gone[k] and i in toxic and i is not None
                gone[k] |= fails
                own["kept"] += not gone[k]
            for part, own in now.items():
                out[part, "".join(order), step] = [own[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic")]
                removed_by[part, f] += own["removed"]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, part int, c string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = fa.filter_audit(docs, told).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in out}
    assert len(found) == len(out)
    return found


def test_filter_audit(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "c#", "delta", "É", "x|y", "LOUD"] + [f"w{k}" for k in range(400)]
    texts = [None, "", " \t\n", "a b", "A" * 50, "#"] + [rng.choice(" \n\t\r\x0b").join(rng.choices(words[: rng.choice([3, 20, 400])], k=rng.choice([1, 150, 199, 200, 201, 500]))) for _ in range(60)]
    rows = [(rng.choice([None, *range(200)]), t, rng.choice(["web", "web", None, "", "bé"])) for t in texts * 2]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [*range(0, 200, 2), 4, 4, None]]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)
    assert audited(spark, [], labels) == {}
    assert audited(spark, [(1, "a", "s"), (1, "a", "s"), (2, "a", "t")], []) == plain_audit([(1, "a", "s"), (1, "a", "s"), (2, "a", "t")], [])


def test_bits_of_long_texts(monkeypatch):
    text = ("one two  three\n" * 40 + "x" * 50 + " ") * 3
    want = plain_bits(text)
    for piece in (1, 3, 7, 64):
        monkeypatch.setattr(fa, "PIECE", piece)
        assert fa.failed(text.encode()) == want
        assert [w for some in fa._pieces(text.encode()) for w in some] == text.encode().split()


def test_bitmaps_of_many_parts():
    rng = np.random.default_rng(1)
    codes, bits, labels = rng.integers(0, 300, 5000), rng.integers(0, 32, 5000), [rng.random(5000) < 0.5, rng.random(5000) < 0.1]
    own = fa.Bitmaps()
    for at in range(0, 5000, 700):
        own.add([f"p{k}" for k in range(300)], codes[at : at + 700], bits[at : at + 700], [x[at : at + 700] for x in labels])
    for k in (0, 17, 299):
        for subset in (0, 5, 31):
            passing = (codes == k) & (bits & subset == 0)
            assert own.counts[f"p{k}"][subset].tolist() == [passing.sum(), (passing & labels[0]).sum(), (passing & labels[1]).sum()]
    assert own.batch().num_rows == 300 * 32 and not own.counts and own.batch().num_rows == 0


# ---- tries and source audit


def test_trie_against_a_dict():
    rng = random.Random(5)
    keys = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(500)]
    whole, parts, want = Trie(), [Trie() for _ in range(3)], defaultdict(Counter)
    for n, k in enumerate(keys):
        leaf = parts[n % 3].leaf(k)
        leaf.docs += 1
        leaf.add(Leaf(0, {n % 7: n}))
        want[k]["docs"] += 1
        want[k][n % 7] += n
    for p in parts:
        again = Trie.of_sorted((k, Leaf(x.docs, dict(x.counts))) for k, x in p.walk())
        assert again.packed() == p.packed() and again.size == p.size
        whole.merge(Trie.unpacked(*p.packed()))
    for stem in {k[:2] for k in want}:  # once more, by prefix
        part = Trie.of_sorted((k[len(stem) :], Leaf(0, {})) for k in sorted(want) if k[:2] == stem)
        whole.merge(Trie.unpacked(*part.packed()), stem)
    got = list(whole.walk())
    assert [k for k, _ in got] == sorted(want) and whole.size == len(want)
    assert all(leaf.docs == want[k]["docs"] and leaf.counts == {s: n for s, n in want[k].items() if s != "docs"} for k, leaf in got)
    whole.keep(3)
    assert [k for k, _ in whole.walk()] == sorted(k for k, c in want.items() if c["docs"] >= 3)
    none = Trie()
    none.leaf(b"a")
    none.keep(1)
    assert list(none.walk()) == [] and none.size == 0 and not none.root.edges and list(Trie.unpacked(*none.packed()).walk()) == []


def test_sorted_terms_are_packed_without_nodes(monkeypatch):
    rng = random.Random(8)
    for size in (1, 2, 30, 400):
        keys = sorted({bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(0, 9))) for _ in range(size)})
        docs = [rng.choice([1, 2, 200, 70_000]) for _ in keys]
        counts = [[x for s in rng.sample(range(300), rng.randrange(4)) for x in (s, rng.choice([1, 127, 128, 1 << 40]))] for _ in keys]
        want = Trie.of_sorted((k, Leaf(d, dict(zip(c[::2], c[1::2], strict=True)))) for k, d, c in zip(keys, docs, counts, strict=True))
        assert rt.packed_sorted(keys, docs, counts) == want.packed()
        again = [(k, x.docs, x.counts) for k, x in Trie.unpacked(*want.packed()).walk()]
        assert again == [(k, d, dict(zip(c[::2], c[1::2], strict=True))) for k, d, c in zip(keys, docs, counts, strict=True)]
    nodes = []
    monkeypatch.setattr(rt, "Node", lambda *x: nodes.append(x))
    own = sa.Counting()
    own.add([b"one two twofold", b"two", b""], ["en", "en", "de"], ["a", "b", "a"])
    assert sum(b.num_rows for b in own.batches()) == 3 and not nodes  # a task made a node for each term and fork before


def test_exact_quotients():
    rng = random.Random(2)
    totals = [rng.randrange(1, 10**k) for k in range(2, 16)]
    counts = [rng.randrange(0, t + 1) for t in totals]
    assert sa.scaled(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]
    p, q = np.array([10**9 + 1, 10**9 + 1, 5, 7]), np.array([1, 10**9 + 1, 9, 2])
    assert sa.distance(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q, strict=True)]


def plain_source_audit(rows, least, most):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def chances(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        every = chances(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: chances(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((-f(p[s][t], every[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > every[t])[:most]
            out |= {(lang, s, part, item.decode(), -v, rank) for part, found in (("pair", pairs), ("term", over)) for rank, (v, item) in enumerate(found, 1)}
    return out


def source_audit(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, item string, stem int")
    out = sa.source_audit(docs, **options).collect()
    found = {tuple(r) for r in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("leaves, merged, cells, piece", [(400_000, 20_000, 1 << 20, 1 << 20), (5, 3, 4, 5)])
def test_source_audit(spark, monkeypatch, leaves, merged, cells, piece):
    # executors take the module's figures from the pickled functions' globals only in one process, so the classes are tried here
    for name, value in (("MOST_LEAVES", leaves), ("MERGED_LEAVES", merged), ("CELLS", cells), ("PIECE", piece)):
        monkeypatch.setattr(sa, name, value)
    rng = random.Random(8)
    words = ["the", "The", "a", "é", "Éa", "日本", "x1y", "don't", "straße", "\u007f\u0080z", "\U0001f600", "th", "there"] + [f"{a}{b}" for a in "abcxyz" for b in ("", "bc", "cde", "zzzzzzzz")]
    rows = [(" ".join(rng.choices(words[: rng.choice([4, 20, len(words)])], k=rng.randrange(0, 40))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "lone", "s"), ("1 2 3", "lone", "t"), ("only one here", "one", "s")] + [("same words", "tie", s) for s in "abc"] * 4
    assert source_audit(spark, rows, min_docs=3, most_terms=4) == plain_source_audit(rows, 3, 4)
    task = sa.Counting()
    for at in range(0, len(rows), 7):
        task.add(*([(r[k] or "").encode() if k == 0 else r[k] or "" for r in rows[at : at + 7]] for k in range(3)))
    merged_rows = sorted((r for b in task.batches() for r in b.to_pylist()), key=lambda r: (r["lang"].encode(), r["stem"]))
    found = [r for b in sa.merging(3)(iter([sa._rows([tuple(r.values()) for r in merged_rows], ["lang", "stem", "trie", "sources"])])) for r in b.to_pylist()]
    for lang in ("en", "tie"):
        own = [r for r in found if r["lang"] == lang]
        names = sorted({s or "" for _, x, s in rows if (x or "") == lang})
        sums = [sum(n for r in own for s, n in zip(r["sources"], r["sums"], strict=True) if s == name) for name in names]
        compared = sa.Comparing(names, sums, sum(r["terms"] for r in own), 4)
        for r in own:
            compared.add(Trie.unpacked(r["trie"], [compared.places[s] for s in r["sources"]]))
        assert {x[:5] for x in plain_source_audit(rows, 3, 4) if x[0] == lang} == set(compared.rows(lang))


def test_source_audit_of_odd_tables(spark):
    assert source_audit(spark, [], min_docs=1) == set()
    rows = [(None, None, None), ("a" * 70_000, None, None), ("a" * 70_000 + " b", "", "s")]
    assert source_audit(spark, rows, min_docs=1, most_terms=10) == plain_source_audit(rows, 1, 10)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def both():
    ranks = bb.read_ranks(RANKS)
    return bb.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABETS = ["abcdefgh ", "aab", "-", "- =", " \n\t", "the and ing tion ", "ÃÂ", "0123456789", "éüßñ日本語한국😀", "".join(map(chr, range(1, 0x250))), "<|endoftext|>'s'll"]


def test_ids_are_those_of_the_library(both):
    own, library = both
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(0, 60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()
    for _ in range(1500):
        piece = bytes(rng.choices(b"abcdet in\xc3\x82\xe2\x80\x93--==\x00\xff", k=rng.randrange(1, 80)))
        assert ([own.ranks[piece]] if piece in own.ranks else own.backtrack(piece)) == library._encode_single_piece(piece)


def test_windows_and_long_texts(both, monkeypatch):
    own, library = both
    text = "".join(random.Random(6).choices(["a", "b", "the", " ", "Â", "-", "ing", "\n"], k=900)) + "ab" * 150 + " word" * 50
    want = library.encode_ordinary(text)
    for window, piece in ((1, 10), (3, 1), (64, 100)):
        monkeypatch.setattr(bb, "WINDOW", window)
        monkeypatch.setattr(bb, "PIECE", piece)
        assert own.encode(text) == want
        assert bb.digest(own, text) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    monkeypatch.undo()
    run = "a" * 200_000
    assert own.decode(own.encode(run)) == run.encode() and own.encode("a" * 2000) == library.encode_ordinary("a" * 2000)


def test_tokens_that_merging_does_not_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301, b"abab": 302}
    own, library = bb.Codec(ranks, r"\S+|\s+"), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    assert 301 not in own.halves
    for text in ("xyz", "xyzz", "axyz", "abc", "abcabc", "ababab", "aabbcc", "bcbc"):
        assert own.encode(text) == library.encode_ordinary(text), text
    with pytest.raises(ValueError):
        bb.Codec({b"a": 0}, r"\S+")


class CountedMatches:
    """An automaton that counts the matches it hands out."""

    def __init__(self, automaton):
        self.automaton, self.matches = automaton, 0

    def __getattr__(self, name):
        def found(*given):
            for x in getattr(self.automaton, name)(*given):
                self.matches += 1
                yield x

        return found


def test_few_matches_an_id(both, monkeypatch):
    """Longest matches alone are asked for, once for each piece, also for pieces that return."""
    own, library = both
    counted = CountedMatches(own.automaton)
    monkeypatch.setattr(own, "automaton", counted)
    words = ["".join(random.Random(k).choices(["th", "er", "in", "tion", "èa", "qu", "Ou"], k=6)) + "xq" for k in range(500)]
    assert own.encode(" ".join(words)) == library.encode_ordinary(" ".join(words))
    n = sum(len(library.encode_ordinary(" " * (k > 0) + w)) for k, w in enumerate(words))
    assert 0 < counted.matches <= 3 * n
    before = counted.matches
    assert own.encode(" ".join(words)) == library.encode_ordinary(" ".join(words))
    assert counted.matches == before


def test_pieces_outlive_their_generation(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bb, "MOST_PIECES", 30)
    rng, made = random.Random(8), []
    own = bb.Codec(own.ranks, public_tokenizers.PATTERN)
    piece = own.piece
    monkeypatch.setattr(own, "piece", lambda x: made.append(x) or piece(x))
    for _ in range(50):
        text = "every text has these words" + "".join(f" {rng.choice('abcdef')}x{rng.choice('uvw')}q{rng.randrange(1000)}é" for _ in range(12)) + " " + "long" * 60
        assert own.encode(text) == library.encode_ordinary(text)
        assert len(own.memo) <= 30 + 60 and len(own.memo.before) <= 30 + 60
    assert made.count(" these") == 1 and made.count(" " + "long" * 60) == 50 and len(made) > 300


def test_long_pieces_are_held_by_their_bytes(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bb, "MOST_HELD", 10_000)
    own, rng = bb.Codec(own.ranks, public_tokenizers.PATTERN), random.Random(3)
    for _ in range(40):
        text = " ".join("".join(rng.choices("日本語한국ab", k=190)) for _ in range(3))
        assert own.encode(text) == library.encode_ordinary(text)
        assert sum(4 * len(a) + len(b) for a, b in own.memo.items()) == own.memo.held <= 10_000 + 3 * 8_000
        assert len(own.memo.before) <= 20


def test_backtracking_across_windows(both, monkeypatch):
    """Places before a window are taken back too, and places that nothing goes through aren't tried again."""
    own, library = both
    rng = random.Random(12)
    pieces = [bytes(rng.choices(rng.choice([b"-= ", b"aab", b"thertion", b"\xc3\xa8\xc3\xa9ou", bytes(range(256))]), k=rng.randrange(1, 300))) for _ in range(400)]
    for window in (1, 2, 7, 50, 1 << 16):
        monkeypatch.setattr(bb, "WINDOW", window)
        for x in pieces:
            if x not in own.ranks:
                assert own.backtrack(x) == library._encode_single_piece(x)


def test_byte_bpe_of_tables(spark, both):
    own, library = both
    texts = [None, "", " ", "a\r\nb", "\x00é", "It's 12 o'clock", "It's 12 o'clock", "x" * 5000]
    df = spark.createDataFrame([(i if i else None, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    short = {r["doc_id"]: tuple(r)[1:] for r in bb.encode_digest(df, RANKS, public_tokenizers.PATTERN).collect()}
    ids = bb.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in bb.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want, key = library.encode_ordinary(t or ""), i if i else None
        assert back[key] == (want, (t or "").encode())
        assert short[key] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bb.encode_digest(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["ids_sha256"] for r in bb.encode_digest(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == hashlib.sha256(" ".join(map(str, both[1].encode_ordinary(r["text"] or ""))).encode()).hexdigest()
