import random
import zlib

import numpy as np
import pytest

from testlattice.llm import token_coder as tc
from testlattice.llm import token_file as tf

PATH = "/opt/tokenizers/word_bpe_49k.json"


def test_coder_round_trip_and_gain():
    rng = np.random.default_rng(0)
    blocks = [np.zeros(0, int), np.array([65535]), np.array([0, 0, 0]), rng.integers(0, 65536, 5000), np.full(4000, 7), np.tile(rng.integers(0, 49000, 50), 60), np.arange(300)]
    coded = tc.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, tc.decode(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[4]) * 8 < 0.2 * len(blocks[4]) and len(coded[5]) * 8 < 6 * len(blocks[5]) and len(coded[3]) < 2.5 * len(blocks[3])
    assert [tc.encode([b])[0] for b in blocks] == coded  # blocks do not depend on each other


def test_checksum_finds_damage():
    row = tf.pack([[np.arange(500), np.array([2])]])[0]
    assert [x.tolist() for x in tf.unpack([row])[0]] == [list(range(500)), [2]]
    with pytest.raises(ValueError):
        tf.unpack([row[:-30] + bytes([row[-30] ^ 1]) + row[-29:]])


def test_words_apart_are_the_whole_text():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = ["", " ", "It's 12345 o'clock\tnow\nÀé ́x y z \x1c\x85 ΣΟΦΟΣ ΟΣ", "<|startoftext|>a<|endoftext|> b <|endoftext|>", "́́ é 한", "日本 語 \x00 😀😀"]
    assert [x.tolist() for x in tf.Encoder(PATH).encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf, "SEGMENT", 2000)
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma!", "42", "idiot"]) for _ in range(rng.choice([0, 1, 30, 900]))) for _ in range(60)] + [None, ""]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["token_ids"]) for r in tf.token_file(df, PATH).collect()}
    whole, start = Tokenizer.from_file(PATH), 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        start += len(want)
    assert tf.token_file(df.limit(0), PATH).count() == 0
    repeated = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in tf.token_file(repeated, PATH).collect())
    assert [g[2] for g in got] == [None, None, 1, 1] and [g[0] for g in got] == [sum(g[1] for g in got[:k]) for k in range(4)]


def test_tokenizers_that_look_across_blanks_get_whole_texts():
    from tokenizers import Tokenizer

    path = PATH.replace("word_bpe_49k", "byte_bpe_50k")
    own, whole = tf.Encoder(path), Tokenizer.from_file(path)
    assert tf.Encoder(PATH).apart and not own.apart
    texts = ["hello big world", "", " a  b\n"]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_above_the_coder_are_an_error():
    with pytest.raises(ValueError, match="65535"):
        tf.pack([[np.array([1, 65536])]])


def test_random_words_apart():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(PATH), random.Random(3)
    letters = "aZé 'x9.́\t\nßſ한日😀\x00\x1c­​İ�"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 3000]))) for _ in range(300)]
    assert [x.tolist() for x in tf.Encoder(PATH).encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_clashing_columns_and_a_very_long_text(spark):
    from tokenizers import Tokenizer

    long = "very long words here " * 60_000
    df = spark.createDataFrame([(2, long, "s", 1), (1, "one", "t", 2)], "doc_id long, text string, start string, n_tokens int")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in tf.token_file(df, PATH).orderBy("doc_id").collect()]
    n = len(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids)
    assert got == [(1, 0, 2), (2, 2, n + 1)]


def test_model_learns_by_stretches(monkeypatch):
    steps, learn = [], tc.Model.learn
    monkeypatch.setattr(tc.Model, "learn", lambda self, *x: (steps.append(1), learn(self, *x))[1])
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.geometric(0.01, n), 65535) for n in (1, 2, 3, 17, 1023, 1024, 1025, 9000, 300_000)]  # the last has more lanes than teach
    coded = tc.encode(blocks)
    assert len(steps) <= len(tc.EDGES)
    assert [x.tolist() for x in tc.decode(coded, [len(b) for b in blocks])] == [b.tolist() for b in blocks]
    assert len(coded[-1]) * 8 < 8.6 * len(blocks[-1])  # 8.1 bits of entropy
    with pytest.raises(ValueError, match="long"):
        tc.decode([coded[-1][:-4]], [300_000])


def test_library_meets_a_word_once_whatever_its_case_and_tail():
    class Counting:
        def __init__(self, own):
            self.own, self.words = own, 0

        def __getattr__(self, name):
            def call(texts, **options):
                self.words += sum(len(t.split()) for t in ([texts] if isinstance(texts, str) else texts))
                return getattr(self.own, name)(texts, **options)

            return call

    encoder = tf.Encoder(PATH)
    assert encoder.apart and not tf.Encoder(PATH.replace("word_bpe_49k", "byte_bpe_50k")).folds
    encoder.own = Counting(encoder.own)
    words = ["".join(random.Random(k).choices("abcdefgh", k=8)) for k in range(40)]
    texts = [" ".join(f(w) + tail for w in words) for f in (str, str.upper, str.title) for tail in ("", ".", ",", "?!", "$$$")]
    got = [x.tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert encoder.own.words <= 3 * len(words)  # 600 forms
    assert got == [encoder.own.own.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_forms_of_words():
    from tokenizers import Tokenizer

    whole, rng, own = Tokenizer.from_file(PATH), random.Random(9), tf.Encoder(PATH)
    letters, tails = "abZÉéßÿÀÞµªº×÷ÅøIİıſΣ", ".,;:!?$%&*()[]{}<>|/\\~`^_=+-@#\"'’—…́̇"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(5))) + "".join(rng.choices(tails, k=rng.choice([0, 0, 1, 3]))) + rng.choice(["", "", "a", "9"]) for _ in range(60)) for _ in range(200)]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_outlive_their_generation(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf, "MEMO", 50)
    monkeypatch.setattr(tf, "PIECES", 30)
    whole, rng, own = Tokenizer.from_file(PATH), random.Random(2), tf.Encoder(PATH)
    for _ in range(12):
        texts = [" ".join(f"w{chr(97 + rng.randrange(26))}{rng.choice('xyz')}{rng.choice(['', '.', '9'])}" for _ in range(40)), ""]
        assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_kept_not_words():
    """Forms of a word share its pieces, also beside words that aren't cut, punctuation alone and text that is not UTF-8."""
    own = tf.Encoder(PATH)
    words = ["".join(random.Random(k).choices("abcdefghé", k=8)) for k in range(200)]
    text = " ".join(f(w) + tail for w in words for f in (str, str.upper, str.title) for tail in ("", ".", ",", "?!", "$$$")).encode() + b" . ,a 9x ?! o'clock a\xffb. \xe9\x00. \xc3\x89T\xc3\x89."
    got = own.encode([text, b"", text])
    assert got[0].tolist() == got[2].tolist() == own.own.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids and not len(got[1])
    assert len(own.now.places) + len(own.before.places) <= len(words) + 12  # 3,000 forms
