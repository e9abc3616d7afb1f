"""Byte-level BPE by backtracking over longest matches.

A rank file names byte strings by rank; merging always joins the adjacent pair whose bytes have the least rank, the leftmost
of equal ones. Whether two tokens can stand side by side in a merged text depends on these two alone: taking the merges of
both back, latest first, no pair across their border may have been joined before. So the merged form is the one sequence of
tokens in which each pair fits, and it is found from the left: the longest token that matches is taken; if it doesn't fit
its neighbour, the next shorter one; if none does, the neighbour is given up for its own next shorter one. A place from
which no fitting end was found is never tried again, so the work is linear in the length of the piece.

Bytes are read as Latin-1, one character a byte, so that pyahocorasick finds the tokens of a piece: it gives the longest match
from a place and goes on behind it, and starts anew where a shorter token is taken. Characters are made a window at a time. Which
token fits is remembered, and so are the ids of pieces that return, as four bytes each, so that a text is one look-up a piece and one
join. A piece that is itself in the rank file is that one token, as in the tiktoken library, even where merging would not get
there; such tokens aren't offered inside longer pieces.

The file's ranks have to be those of byte-pair merging: every single byte is there, and a token that merging reaches is
joined from two tokens of lesser rank.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows, null ids and further columns play
no part. Texts beyond ``PIECE`` characters are encoded some thousand pieces at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, ready, utf8

#: Texts of more characters are cut into pieces as they are needed; bytes of a window; remembered pairs, and pieces of a generation (some 170 bytes each, two generations a worker).
PIECE, WINDOW, MOST_PAIRS, MOST_PIECES = 1 << 20, 1 << 16, 1 << 20, 400_000
#: Longer pieces are encoded anew each time; bytes of the pieces of a generation.
LONG_PIECE, MOST_HELD = 200, 1 << 26


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file of lines with base64 text and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of a short string after all merges of a rank less than ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pieces(dict):
    """Pieces and what ``make`` gives for them, made when one is first looked up; pieces above LONG_PIECE aren't kept. Two generations, so that frequent ones stay when rare ones go."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.before: dict[str, bytes] = {}
        self.held = 0  # bytes of the pieces and of what was made for them

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = found
            self.held += 4 * len(piece) + len(found)
        return found

    def bound(self) -> None:
        """To be called between lists of pieces: begins a generation where one is full."""
        if len(self) > MOST_PIECES or self.held > MOST_HELD:
            self.before, self.held = dict(self), 0
            self.clear()


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a rank file has to name every single byte")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            self.bytes[rank] = data
        self.text = [str(i) for i in range(len(self.bytes))]
        # the two tokens that a token was joined from; a single byte from itself; tokens that merging doesn't reach have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = [rank, rank] if len(data) == 1 else [ranks[x] for x in merged(data, ranks, rank)]
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                if len(data) > 1:
                    self.joined[parts[0], parts[1]] = rank
        self.automaton, self.size = ahocorasick.Automaton(ahocorasick.STORE_INTS), [len(x) for x in self.bytes]
        for rank in self.halves:
            self.automaton.add_word(self.bytes[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest_token = max(self.size)
        self.shorter = self._shorter()
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo = Pieces(lambda piece: array("i", self.piece(piece)).tobytes())

    def _shorter(self) -> dict[int, int]:
        """The longest token that a token begins with, less than itself; -1 for none."""
        known = {self.bytes[r]: r for r in self.halves}
        out = {}
        for data, rank in known.items():
            out[rank] = next((known[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in known), -1)
        return out

    def follows(self, left: int, token: int) -> int:
        """The longest of a token and those that it begins with that fits beside ``left`` (-1: nothing); -1 for none."""
        key = (left, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            while left >= 0 and token >= 0 and not self.fits(left, token):
                token = self.shorter[token]
            known = self.pairs[key] = token
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves two tokens side by side.

        Take the merges on both sides of the border back, later ones first; a pair across it that joins before what was last taken back would have been joined.
        """
        limit = len(self.bytes)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            a, b = self.halves[left], self.halves[right]
            single_left, single_right = a[0] == left, b[0] == right
            if single_left and single_right:
                return True
            if not single_left and (single_right or left > right):
                # of equal ranks the left one is joined first, so one across the border comes later
                left, limit = a[1], left
            else:
                right, limit = b[0], right + 1

    def piece(self, piece: str) -> list[int]:
        """The ids of one match of the pattern."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.backtrack(data)

    def _window(self, data: bytes, start: int) -> str:
        """The characters of a window, and as many more as a token from its last place may take."""
        return data[start : start + WINDOW + self.longest_token].decode("latin-1")

    def backtrack(self, data: bytes) -> list[int]:
        n, size, shorter, known, longest = len(data), self.size, self.shorter, self.pairs.get, self.automaton.iter_long
        dead = bytearray(n + 1)  # places that no fitting sequence goes through
        out, at, last = array("l"), 0, -1
        window, text = 0, self._window(data, 0)
        ahead = longest(text)  # the longest tokens one after another, as long as each is taken
        token = next(ahead)[1]
        while True:
            offered = token
            while token >= 0:
                fitting = known((last, token))
                token = self.follows(last, token) if fitting is None else fitting
                if token < 0 or not dead[at + size[token]]:
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + size[token], token
                if at == n:
                    return out.tolist()
                if not window <= at < window + WINDOW:
                    window, text, ahead = at, self._window(data, at), None
                if ahead is None or token != offered:
                    ahead = longest(text, at - window)
                token = next(ahead)[1]
            else:
                dead[at] = 1
                token, ahead = out.pop(), None
                at, last = at - size[token], out[-1] if out else -1
                token = shorter[token]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= PIECE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, 50_000)):
            yield some

    def ids(self, pieces: list[str]) -> list[int]:
        self.memo.bound()
        return array("i", b"".join(map(self.memo.__getitem__, pieces))).tolist()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` array<int>."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern)
        ids = [own.encode(x.decode("utf-8", "surrogatepass")) for x in utf8(batch, "_text")]
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    return map_batches(rows, work, f"_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes of the ids, which are those of a text only where the ids are whole; null for null."""
    others = [c for c in rows.columns if c != "decoded"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks_path, pattern)
        found = [None if x is None else own.decode(x) for x in batch.column(ids_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.binary())], [*others, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return map_batches(rows.select(*others), work, f"{fields}, decoded binary")


def digest(own: Codec, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids as decimal numbers joined by one space, SHA-256 of what they decode to."""
    count, numbers, back = 0, hashlib.sha256(), hashlib.sha256()
    for some in own.pieces(text):
        if ids := own.ids(some):
            numbers.update((" " * (count > 0) + " ".join(map(own.text.__getitem__, ids))).encode())
            back.update(own.decode(ids))
            count += len(ids)
    return count, numbers.hexdigest(), back.hexdigest()


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256: texts are encoded, and their ids decoded, where they lie; no ids leave a task."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(ranks_path, pattern)
            out = [digest(own, x.decode("utf-8", "surrogatepass")) for x in utf8(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.string()) for i in (1, 2))], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
