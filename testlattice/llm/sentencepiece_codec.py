"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is read here: pieces with score and type, the model type, and the normaliser's settings.
From them a tokenizers pipeline is rebuilt: the normaliser (character map, extra white space, dummy prefix, the metaspace
marker for a blank), a BPE or unigram model with byte fallback, and the matching decoder. Batches are encoded by the
library's own threads. Before a worker encodes anything it compares the rebuilt tokenizer with the sentencepiece
library on fixed probe texts, and fails if one differs; ``encode_digest`` compares all that it encodes, and ``encode`` with ``verify=True`` every text.

Where no piece holds the marker after another character, no merge can cross from a word to a following marker. The
text is cut there, which changes no id, and a worker hands only words that it has not met to the library, as one batch. Where the model does not normalise,
each of them is compared with sentencepiece as it is met, and the first batch of every task is compared as whole texts; with other models every text is.

Defined results: null counts as empty; the empty text has no ids; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, give_back, map_batches, ready, utf8

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the format
UNIGRAM, BPE = 1, 2
UNIT = f"{MARK}*[^{MARK}]+|{MARK}+"
MEMO, AT_ONCE = 120_000, 1 << 21  # words known at most (twice that many), characters in a batch for the library
PROBES = ("", " ", "a", "Hello  world\n\tü", " leading and trailing ", "12345 67.8%", "<s> </s> <unk> <pad>", "\U0001d50a zero\x00byte", "ein Straßenfest — déjà vu, ¿qué tal? ñandú", MARK + " mark " + MARK * 3 + "x", "aaa aaaa aaaaa" * 5, "日本語のテキスト", "a\r\nb c　d")


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    suffix_mark: bool = False

    @property
    def unk_id(self) -> int:
        return self.types.index(UNKNOWN)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers for varints, bytes for everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> PieceModel:
    model = PieceModel()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0" * 4, 3: NORMAL} | dict(fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0])
            model.types.append(piece[3])
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback, model.suffix_mark = spec.get(3, UNIGRAM), bool(spec.get(35)), bool(spec.get(24))
        elif number == 3:
            spec = dict(fields(value))
            model.char_map, model.dummy_prefix, model.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if model.suffix_mark or model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker before the word are supported")
    return model


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best pieces first: SentencePiece joins the pair whose piece scores best."""
    ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t in (NORMAL, UNUSED)}
    found = []
    for piece, at in ids.items():
        ways = [(ids[a], ids[b], a, b) for k in range(1, len(piece)) if (a := piece[:k]) in ids and (b := piece[k:]) in ids]
        found += [(-model.scores[at], *way) for way in sorted(ways)]
    return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[0])]


def splits(model: PieceModel) -> bool:
    """Whether no piece crosses from another character to a marker, and no piece must be found before all others."""
    return not any(MARK in p.lstrip(MARK) for p, t in zip(model.pieces, model.types, strict=True) if t == NORMAL) and USER not in model.types


def rebuild(model: PieceModel):
    """The tokenizers pipeline that is equal to the SentencePiece model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, merges_of(model), unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if splits(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(UNIT), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    out.add_tokens([AddedToken(p, normalized=False) for p, t in zip(model.pieces, model.types, strict=True) if t == USER])
    return out


class Codec:
    """A rebuilt tokenizer beside the library it must agree with."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = read_model(path)
        self.whole = rebuild(self.model)
        self.plain = sentencepiece.SentencePieceProcessor(model_file=path)
        self.exact = not (self.model.char_map or self.model.squeeze)  # texts are taken as they are
        self.units = Tokenizer(self.whole.model) if splits(self.model) else None
        self.memo = Memo(self._learn, MEMO)
        self.odd: dict[str, bytes] = {}  # bytes of units that decode to something other than themselves
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(self.model.pieces, self.model.types, strict=True)]
        self.check(list(PROBES))
        ids = self.encode(list(PROBES))
        assert self.decode(ids) == self.whole.decode_batch(ids, skip_special_tokens=False), "the decoders differ"

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each unit; where the model does not normalise they are checked against sentencepiece."""
        got = [x.ids for x in self.units.encode_batch_fast(units, add_special_tokens=False)]
        if self.exact:
            want = self.plain.encode([u[1:] for u in units] if self.model.dummy_prefix else units, num_threads=1)
            want = [[self.plain.piece_to_id(MARK)] if u == MARK else x for u, x in zip(units, want, strict=True)]  # sentencepiece sees it at a text's end alone
            if got != want:
                at = next(i for i, (x, y) in enumerate(zip(got, want, strict=True)) if x != y)
                raise AssertionError(f"the rebuilt tokenizer differs from sentencepiece on {units[at][:80]!r}: {got[at][:20]} and {want[at][:20]}")
        spelled = self.bytes
        for unit, ids in zip(units, got, strict=True):
            data = b"".join([spelled[i] for i in ids])
            if data != unit.replace(MARK, " ").encode():
                self.odd[unit] = data
        return [struct.pack(f"<{len(x)}I", *x) for x in got]

    def packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and spelled bytes of each text, from batches of AT_ONCE characters."""
        out, at, size = [], 0, 0
        for i, text in enumerate(texts, 1):
            size += len(text)
            if size >= AT_ONCE or i == len(texts):
                out += self._packed(texts[at:i])
                at, size = i, 0
        return out

    def _packed(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if self.units is None:
            ids = [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return [(np.array(x, "<u4").tobytes(), b"".join([self.bytes[i] for i in x])) for x in ids]
        if self.exact:
            first = MARK if self.model.dummy_prefix else ""
            parts = [re.findall(UNIT, first + x.replace(" ", MARK)) if x else [] for x in texts]
        else:
            parts = [re.findall(UNIT, self.whole.normalizer.normalize_str(x)) if x else [] for x in texts]
        if len(self.odd) > MEMO:
            self.odd, self.memo = {}, Memo(self._learn, MEMO)
        get, odd = self.memo.learn(parts), self.odd
        out = []
        for x in parts:
            plain = not odd or odd.keys().isdisjoint(x)
            data = "".join(x).replace(MARK, " ").encode() if plain else b"".join([odd[u] if u in odd else u.replace(MARK, " ").encode() for u in x])
            out.append((b"".join(map(get, x)), data))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x, _ in self.packed(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.spelled(np.array(x, "<u4").tobytes(), b"".join([self.bytes[i] for i in x])) for x in ids]

    def spelled(self, ids: bytes, data: bytes) -> str:
        """The text of pieces whose bytes are ``data``; where they are not UTF-8 the library decodes, which marks each such byte."""
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.whole.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def check(self, texts: list[str], packed: list[tuple[bytes, bytes]] | None = None) -> list[list[int]]:
        """Ids of the texts, which must be those of the library."""
        ids = [np.frombuffer(x, "<u4").tolist() for x, _ in packed or self.packed(texts)]
        for text, got, want in zip(texts, ids, self.plain.encode(texts, num_threads=1), strict=True):
            if got != want:
                raise AssertionError(f"the rebuilt tokenizer differs from sentencepiece on {text[:80]!r}: {got[:20]} and {want[:20]}")
        return ids

    def decoded(self, text: str) -> str:
        """What decoding has to give back: the text after normalisation; a marker in the text comes back as a blank."""
        return (self.plain.normalize(text).removeprefix(MARK) if self.model.char_map or self.model.squeeze else text).replace(MARK, " ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # of each worker; every core of an executor has one
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """``id_col``, ``ids`` array<int>, ``decoded`` string and ``round_trip``: whether ``decoded`` is the normalised text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path)
        texts = [x.decode("utf-8", "replace") for x in utf8(batch, "_text")]
        ids = own.check(texts) if verify else own.encode(texts)
        back = own.decode(ids)
        same = [own.decoded(t) == b for t, b in zip(texts, back, strict=True)]
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["_id", "ids", "decoded", "round_trip"])

    return map_batches(rows, work, f"_id {id_type}, ids array<int>, decoded string, round_trip boolean").withColumnRenamed("_id", id_col)


def crc_of_ids(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def digests(own: Codec, texts: list[str], whole: bool = True) -> list[tuple[int, int, str, bool]]:
    """(n_tokens, ids_crc32, decoded_sha256, round_trip) of each text of a batch; ``whole``: texts are checked against sentencepiece, not their units alone."""
    packed, out = own.packed(texts), []
    if whole or not own.exact or own.units is None:
        own.check(texts, packed)
    for text, (ids, data) in zip(texts, packed, strict=True):
        back = own.spelled(ids, data)
        out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), own.decoded(text) == back))
    return out


def encode_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), decoded_sha256, round_trip; all that is encoded is checked."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = digests(codec(model_path), [x.decode("utf-8", "replace") for x in utf8(batch, "_text")], first)
            first = False
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])
        give_back()

    return rows.mapInArrow(work, f"_id {id_type}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("_id", id_col)
