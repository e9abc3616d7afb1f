"""Token ids in binary files: documents in ascending id order, coded by an adaptive context-mixing range coder.

Documents are dealt out by ranges of their id and sorted, encoded by the tokenizers library, and laid end to end, each with an end id. A file row holds a
*segment* of whole documents:

    magic "TLTS2\\0\\0\\0" | u32 number of documents | u32 number of blocks | u64 length of each document in ids ...
    for each block: u32 number of ids | u32 CRC-32 of the ids (u32, little-endian) | u32 bytes of code
    the blocks' code, one after the other

Blocks are coded independently (see token_coder) and checked by their CRC on reading. Rows are (shard, segment, doc ids, data) in Parquet,
written and committed by Spark, so a lost task is simply run again; no document is divided between rows, and a row is read without any other.

Defined results: null counts as empty, and has the end id alone; null ids come first; equal ids keep all their rows, in the order of their text.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import token_coder
from .common import give_back, ready

MAGIC = b"TLTS2\0\0\0"
SEGMENT, SIDE_BY_SIDE = 1 << 20, 4 << 20
#: Ids of a block; bytes of the batches whose words are numbered at once.
BLOCK, GATHERED = 1 << 20, 6 << 20
#: What a generation keeps before the next begins: pieces of words, or words of a tokenizer that doesn't show that they can be cut.
PIECES, MEMO = 300_000, 300_000


#: Texts on which a tokenizer is tried before words are handed to it apart.
PROBES = ("hello big world", "It's 12345 o'clock\tnow\nno", " a  b ", "x\x0by\x0cz\r\nend.", "\u00c0\u00e9 \u0301x \u03a3\u039f\u03a6\u039f\u03a3 .", "<|startoftext|>a<|endoftext|> b", "don 't we 'll")


#: A word of Latin letters and the ASCII punctuation at its end, without apostrophes: such letters have no combining forms, and each has one lower case.
_LETTERS, _TAIL = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "!-&(-/:-@\\[-`{-~"
_folded = re.compile(f"([{_LETTERS}]+)([{_TAIL}]*)").fullmatch
_CUT = f"^(?P<stem>[{_LETTERS}]+)(?P<tail>[{_TAIL}]*)$"
_plain = re.compile(f"[{_LETTERS}]+").fullmatch


def runs(ids: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids from ``starts`` of each place to that of the next one, one place after the other, and their numbers."""
    first = starts.take(places)
    sizes = starts.take(places + 1) - first
    ends = np.cumsum(sizes)
    whole = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if whole + len(ids) < 1 << 31 else np.int64
    return ids.take(np.repeat((first - ends + sizes).astype(kind), sizes) + np.arange(whole, dtype=kind)), sizes


class Words:
    """Ids of words, one word after the other in one array."""

    def __init__(self) -> None:
        self.places: dict = {}
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def add(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.places), int(self.starts[len(self.places)])
        while len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) <= n + len(words):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[end : end + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(words)] = end + np.cumsum(sizes)
        self.places.update(zip(words, range(n, n + len(words)), strict=True))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at some places, and the number of ids of each."""
        return runs(self.ids, self.starts, places)


class Encoder:
    """A tokenizer that is handed only words it hasn't met, if it shows on probe texts that it never looks across ASCII white space; else whole texts.

    Arrow cuts the texts and numbers their words. Of distinct words it cuts Latin letters, in lower case, from the punctuation after them, if the tokenizer shows on every
    such letter and sign that their ids are the word's, and numbers these pieces, so Python sees each piece once a batch and no word. Pieces that return keep
    their ids: two generations of at most PIECES pieces and a batch, so that frequent ones stay when rare ones go. New pieces go to the library side by side in texts of
    WORDS pieces. Where ids tell that they end a word and there are as many ends as pieces, they tell whose an id is; else the offsets do.
    """

    WORDS = 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.now, self.before = Words(), Words()
        whole = [x.ids for x in self.own.encode_batch_fast(list(PROBES), add_special_tokens=False)]
        apart = [[i for w in x.encode().split() for i in self.own.encode(w.decode(), add_special_tokens=False).ids] for x in PROBES]
        self.apart = whole == apart
        spec = json.loads(self.own.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.ending = np.zeros(max(self.own.get_vocab().values(), default=0) + 1, bool)
        self.ending[[i for t, i in self.own.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.folds = self.apart and not any(_folded(t["content"].lstrip()) or re.fullmatch(f"[{_TAIL}]+", t["content"].strip()) for t in spec["added_tokens"]) and self._shows_folds()

    def _shows_folds(self) -> bool:
        every = [chr(c) for c in range(33, 256)]
        letters, tails = [c for c in every if re.match(f"[{_LETTERS}]", c)], [c for c in every if re.match(f"[{_TAIL}]", c)]
        probes = [f"{a}{b}{t}" for k, a in enumerate(letters) for b in ("", a, "e", "S") for t in ("", tails[k % len(tails)], *tails[:2])] + [f"aB\u00c9{t}{u}" for t in tails for u in ("", t, *tails)]
        ids = lambda x: [i.ids for i in self.own.encode_batch_fast(x, add_special_tokens=False)]
        parts = [_folded(p) for p in probes]
        return ids(probes) == [a + b for a, b in zip(ids([m[1].lower() for m in parts]), ids([m[2] for m in parts]), strict=True)]

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all words, and the number of ids of each."""
        groups = [words[i : i + self.WORDS] for i in range(0, len(words), self.WORDS)]
        ids, sizes = [], []
        for group, got in zip(groups, self.own.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ending[own])
            if len(ends) == len(group) and ends[-1] == len(own) - 1 and all(map(_plain, group)):
                sizes.append(np.diff(ends, prepend=-1))
            else:
                starts = np.cumsum([0, *(len(w) + 1 for w in group)])
                got = self.own.encode(" ".join(group), add_special_tokens=False)
                own = np.array(got.ids, np.uint32)
                at = np.searchsorted(starts, np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
                sizes.append(np.bincount(at, minlength=len(group)))
            ids.append(own)
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Places of distinct pieces among those of now."""
        if len(self.now.places) > (PIECES if self.folds else MEMO):
            self.now, self.before = Words(), self.now
        out = np.fromiter(map(self.now.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            first, unknown = len(self.now.places), [pieces[k] for k in missing.tolist()]
            held = np.fromiter(map(self.before.places.get, unknown, repeat(-1)), np.int64, len(unknown))
            old, new = np.flatnonzero(held >= 0), np.flatnonzero(held < 0)
            self.now.add([unknown[k] for k in old.tolist()], *self.before.of(held[old]))
            if len(new):
                fresh = [(unknown[k].decode("utf-8", "replace"), k) for k in new.tolist()]
                fresh.sort(key=lambda x: not _plain(x[0]))
                new = np.array([k for _, k in fresh])
                self.now.add([unknown[k] for k in new.tolist()], *self._ask([x for x, _ in fresh]))
            out[missing[np.append(old, new)]] = np.arange(first, first + len(missing))
        return out

    def _spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and where each begins, with the end of the last."""
        if self.folds:
            cut = pc.extract_regex(words, _CUT)
            stem, tail = (pc.struct_field(cut, x) for x in ("stem", "tail"))
            parts = pa.concat_arrays([pc.coalesce(pc.utf8_lower(stem), words), pc.coalesce(tail, "")]).cast(pa.large_binary()).dictionary_encode()
            places = self._places(parts.dictionary.to_numpy(zero_copy_only=False).tolist())[parts.indices.to_numpy()]
            ids, sizes = self.now.of(places.reshape(2, -1).T.reshape(-1))
            sizes = sizes.reshape(-1, 2).sum(axis=1)
        else:
            ids, sizes = self.now.of(self._places(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()))
        return ids, np.append(0, np.cumsum(sizes))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one text after the other, and the number of ids of each."""
        if not self.apart:
            got = [np.array(x.ids, np.uint32) for x in self.own.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = cut.flatten().dictionary_encode()
        ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(words):
            ids, sizes = runs(*self._spell(words.dictionary), words.indices.to_numpy())
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(np.append(0, pc.list_value_length(cut).to_numpy(zero_copy_only=False)))]
        return ids, np.diff(ends)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, sizes = self.flat(pa.array(texts, pa.binary()).view(pa.string()))
        return np.split(ids.astype(np.int64), np.cumsum(sizes)[:-1]) if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def pack(segments: list[list[np.ndarray]]) -> list[bytes]:
    """A file row for each list of documents; ids are below 65,536."""
    blocks, shapes = [], []
    for docs in segments:
        flat = np.concatenate(docs)
        if len(flat) and not 0 <= flat.min() <= flat.max() < token_coder.IDS:
            raise ValueError(f"ids from {flat.min()} to {flat.max()}: the coder takes ids from 0 to {token_coder.IDS - 1}")
        own = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        shapes.append(len(own))
        blocks += own
    coded, at, out = token_coder.encode(blocks), 0, []
    for docs, n in zip(segments, shapes, strict=True):
        heads = b"".join(struct.pack("<III", len(b), crc(b), len(c)) for b, c in zip(blocks[at : at + n], coded[at : at + n], strict=True))
        out.append(MAGIC + struct.pack("<II", len(docs), n) + np.array([len(d) for d in docs], "<u8").tobytes() + heads + b"".join(coded[at : at + n]))
        at += n
    return out


def unpack(rows: list[bytes]) -> list[list[np.ndarray]]:
    """The documents of each file row; a block whose ids don't have its CRC is an error."""
    shapes, coded, lengths, checks = [], [], [], []
    for data in rows:
        if data[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        docs, n = struct.unpack_from("<II", data, 8)
        sizes = np.frombuffer(data, "<u8", docs, 16).astype(np.int64)
        heads = np.frombuffer(data, "<u4", 3 * n, 16 + 8 * docs).reshape(n, 3).astype(np.int64)
        ends = 16 + 8 * docs + 12 * n + np.cumsum(heads[:, 2])
        shapes.append((sizes, n))
        coded += [data[b - k : b] for b, k in zip(ends.tolist(), heads[:, 2].tolist(), strict=True)]
        lengths += heads[:, 0].tolist()
        checks += heads[:, 1].tolist()
    blocks = token_coder.decode(coded, lengths)
    if [crc(b) for b in blocks] != checks:
        raise ValueError("a block's ids do not have its checksum")
    out, at = [], 0
    for sizes, n in shapes:
        out.append(np.split(np.concatenate(blocks[at : at + n]), np.cumsum(sizes)[:-1]) if n else [])
        at += n
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents under ``path`` (Parquet rows of shard, segment, ids, tokens, data)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, ids, number, segments, names = encoder(tokenizer_path), [], [], 0, [], []
        waiting, total = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total
            data = pack(segments)
            kind = pa.list_(names[0].type)
            lists = [pa.concat_arrays([n]) for n in names]
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(range(number, number + len(data)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists)).cast(kind), pa.array([sum(map(len, s)) for s in segments], pa.int64()), pa.array(data, pa.binary())], ["segment", "ids", "tokens", "data"])
            number, total = number + len(data), 0
            segments.clear()
            names.clear()
            return out

        for batch in _gathered(batches):
            column, first = batch.column("_id"), 0
            coded, sizes = own.flat(batch.column("_text"))
            ends = np.cumsum(sizes + 1)
            whole = np.full(ends[-1] if len(ends) else 0, end_id, np.int32)
            inner = np.ones(len(whole), bool)
            inner[ends - 1] = False
            whole[inner] = coded
            for i, got in enumerate(np.split(whole, ends[:-1]) if len(ends) else []):
                held.append(got)
                waiting += len(got)
                if waiting >= SEGMENT:
                    names.append(pa.concat_arrays([*ids, column.slice(first, i + 1 - first)]))
                    segments.append(held)
                    held, ids, first = [], [], i + 1
                    total, waiting = total + waiting, 0
                    if total >= SIDE_BY_SIDE:
                        yield flush()
            ids.append(column.slice(first))
        if held:
            names.append(pa.concat_arrays(ids))
            segments.append(held)
        if segments:
            yield flush()
        give_back()

    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", F.md5(F.col("_text").cast("binary")))
    coded = ordered.mapInArrow(work, f"segment long, ids array<{id_type}>, tokens long, data binary")
    coded.select(F.spark_partition_id().cast("long").alias("shard"), "segment", "ids", "tokens", "data").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of (id, start, n_tokens, ids_crc32, token_ids) of files under ``path``; ``start`` counts the ids of all documents before."""
    ready(spark)
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard", "segment").agg(F.sum("tokens").alias("t"))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("t").alias("t")).select("shard", before(W.orderBy("shard")).alias("shard_start"))
    starts = sizes.select("shard", "segment", before(W.partitionBy("shard").orderBy("segment")).alias("in_shard")).join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("in_shard")).alias("start"))
    id_type = files.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE_BY_SIDE // SEGMENT):
                batch = whole.slice(at, SIDE_BY_SIDE // SEGMENT)
                docs = [d for row in unpack(batch.column("data").to_pylist()) for d in row]
                sizes_ = np.array([len(d) for d in docs], np.int64)
                per_row = [len(x) for x in batch.column("ids").to_pylist()]
                starts_, k = [], 0
                for n in per_row:
                    starts_.append(np.append(0, sizes_[k : k + n].cumsum()[:-1]))
                    k += n
                ends = np.append(0, sizes_.cumsum()).astype(np.int32)
                row = pa.array(np.repeat(np.arange(len(per_row)), per_row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard").take(row), batch.column("segment").take(row), batch.column("ids").flatten(), pa.array(np.concatenate(starts_)), pa.array(sizes_), pa.array([crc(d) for d in docs], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(docs).astype(np.int32)))],
                    ["shard", "segment", "id", "inside", "n_tokens", "ids_crc32", "token_ids"],
                )
        give_back()

    docs = files.select("shard", "segment", "ids", "data").mapInArrow(work, f"shard long, segment long, id {id_type}, inside long, n_tokens long, ids_crc32 long, token_ids array<int>")
    return docs.join(starts, ["shard", "segment"]).select("id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "token_ids")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ready(spark)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files, below the shared folder unless ``path`` says where, and read them back: ``id_col``, start, n_tokens, ids_crc32, token_ids."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, end_id, id_col, text_col)
    return read(docs.sparkSession, path).withColumnRenamed("id", id_col)
