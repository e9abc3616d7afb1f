"""Media columns: AVI files of motion JPEG.

Writing: a payload of 8-bit samples becomes frames of 8 x 8 flat JPEG blocks, one sample a block. With a DC quantiser of 8 the quantised
DC coefficient of a flat block is its sample less 128, so baseline JPEG stores it without loss. Reading: the RIFF tree and its
``idx1`` index are parsed, each frame's tables are read, and the entropy-coded data of many frames are decoded side by side, one
symbol of every frame a step. The reader takes any baseline frames, grey or YCbCr, and gives the luma DC image, which is all that shot detection in the
compressed domain needs; restart intervals and progressive frames are refused.

Shots: a frame's histogram of 16 grey levels is compared with the one before; a cut is where the difference is above the mean plus ``k`` standard
deviations of its neighbourhood and above a floor. Shots are rows with frame numbers and times.

Defined results: null counts as empty; the payload of an empty text is 64 zero bytes, one frame, one shot. A file is at most 4 GB (RIFF sizes
have 32 bits), that is a text of about 1 GB.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

SIDE, FRAME = 64, 64  # pixels a side, samples a frame
SLICE = 16384  # frames that are coded side by side
FPS = 25
# Fixed values of the JPEG standard: code lengths of the usual luminance DC table. The AC table has the end-of-block symbol alone.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1, *[0] * 15), (0,)
# Fixed values of the JPEG standard: the usual tables (class and number, code lengths, symbols), which motion JPEG frames may leave out.
USUAL = {
    0x00: (DC_COUNTS, bytes(DC_SYMBOLS)),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12))),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
            "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        bytes.fromhex(
            "0001020311040521310612415107617113223281081442"
            "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
            "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x08" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS) + b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def huffman(counts, symbols) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, end of block included."""
    table, bits, sizes = huffman(DC_COUNTS, DC_SYMBOLS), np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = table[size]
        bits[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        sizes[d + 255] = length + size + 1
    return bits, sizes


_BITS, _SIZES = _difference_codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of rows of 64 samples."""
    out: list[bytes] = []
    for at in range(0, len(samples), SLICE):
        part = samples[at : at + SLICE].astype(np.int64)
        step = np.diff(part, axis=1, prepend=np.full((len(part), 1), 128)) + 255
        bits, sizes = _BITS[step], _SIZES[step]
        ends = sizes.cumsum(1)
        lengths = (ends[:, -1] + 7) // 8
        base = lengths.cumsum() - lengths
        place = (base[:, None] * 8 + ends - sizes).ravel()
        word = (bits.ravel() << (24 - sizes.ravel() - (place & 7))) & 0xFFFFFF
        total = int(lengths.sum())
        data = np.zeros(total + 2, np.int64)
        for k, shift in enumerate((16, 8, 0)):
            data += np.bincount((place >> 3) + k, (word >> shift) & 255, total + 2).astype(np.int64)[: total + 2]
        pad = lengths * 8 - ends[:, -1]
        data[base + lengths - 1] |= (1 << pad) - 1
        raw = data[:total].astype(np.uint8).tobytes()
        out += [HEADER + raw[a : a + n].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for a, n in zip(base.tolist(), lengths.tolist(), strict=True)]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1000000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    sizes = np.fromiter(map(len, frames), np.uint32, len(frames))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    movie = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + headers + movie + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames of the first video stream, found by the index, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index, rate = None, None, 0.0
    stack = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while stack:
        at, end = stack.pop()
        if at + 8 > end:
            continue
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        stack.append((at + 8 + size + (size & 1), end))
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"LIST":
            stack.append((at + 12, at + 8 + size))
        elif name == b"strh" and data[at + 8 : at + 12] == b"vids" and not rate:
            scale, ticks = struct.unpack_from("<II", data, at + 8 + 20)
            rate = ticks / scale
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
    if movie is None or index is None:
        raise ValueError("the AVI file has no movie or no index")
    video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    base = movie if len(video) == 0 or data[movie + int(video[0, 2]) :][:4] == video[0, 0].tobytes() else 0  # offsets count from 'movi' or from the file's start
    return [data[base + o + 8 : base + o + 8 + n] for o, n in zip(video[:, 2].tolist(), video[:, 3].tolist(), strict=True)], rate


def look_up(counts, symbols) -> np.ndarray:
    """For every 16 bits the symbol << 8 | length of the code that they begin with."""
    look = np.zeros(65536, np.int32)
    for symbol, (code, length) in huffman(counts, symbols).items():
        look[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return look


@functools.cache
def usual(name: int) -> np.ndarray:
    return look_up(*USUAL[name])


class Tables:
    """What a frame's header says: the blocks of an MCU in order, with their decoding tables; the usual ones where a frame has none."""

    def __init__(self, frame: bytes):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("a frame is not a JPEG image")
        quant, coding, at, interval, parts = {}, {}, 2, 0, {}
        while True:
            if len(frame) < at + 4 or frame[at] != 0xFF:
                raise ValueError("a frame ends in its header")
            marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of the DC coefficient
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    coding[body[0]] = look_up(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.length = at + 2 + size
                break
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("only baseline frames are supported")
            at += 2 + size
        if interval:
            raise ValueError("restart intervals are not supported")
        if not parts:
            raise ValueError("a frame has no size")
        across, down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
        if len(parts) == 1:
            parts, across, down = {k: (1, 1, q) for k, (_, _, q) in parts.items()}, 1, 1
        self.units = -(-self.width // (8 * across)) * -(-self.height // (8 * down))
        self.blocks = []
        for i in range(body[0]):
            part, which = body[1 + 2 * i], body[2 + 2 * i]
            h, v, q = parts[part]
            dc, ac = ((coding[x] if x in coding else usual(x & 0x11)) for x in (which >> 4, 16 | which & 15))
            self.blocks += [(i, dc, ac, quant.get(q, 1))] * (h * v)
        self.luma = [k for k, b in enumerate(self.blocks) if b[0] == 0]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Luma DC image of each frame, as 8-bit means of blocks in coding order."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(frames)
    groups: dict[bytes, tuple[Tables, list[int]]] = {}
    last = None
    for i, frame in enumerate(frames):
        if last is None or not frame.startswith(last):
            tables = Tables(frame)
            last = frame[: tables.length]
            groups.setdefault(last, (tables, []))
        groups[last][1].append(i)
    for tables, members in groups.values():
        for at in range(0, len(members), SLICE):
            part = members[at : at + SLICE]
            for i, image in zip(part, _decode_lanes([frames[k] for k in part], tables), strict=True):
                out[i] = image
    return out


def _decode_lanes(frames: list[bytes], tables: Tables) -> np.ndarray:
    raw = [f[tables.length : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in frames]
    width = max(map(len, raw)) + 4
    data = np.frombuffer(b"".join(r.ljust(width, b"\xff") for r in raw), np.uint8).astype(np.int64)
    base = np.arange(len(raw)) * width * 8
    end = base + width * 8 - 32
    place = base.copy()

    before: dict[int, np.ndarray] = {b[0]: np.zeros(len(raw), np.int64) for b in tables.blocks}
    image = np.zeros((len(raw), tables.units * len(tables.luma)), np.uint8)
    column = 0
    for _ in range(tables.units):
        for part, dc, ac, quant in tables.blocks:
            got = dc[peek(data, place, end)]
            length, size = got & 255, got >> 8
            place = place + length
            extra = peek(data, place, end) >> (16 - size)
            place = place + size
            before[part] = before[part] + np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            if part == 0:
                image[:, column] = np.clip(np.rint(before[part] * quant / 8) + 128, 0, 255)
                column += 1
            open_, seen = np.arange(len(raw)), np.ones(len(raw), np.int64)
            while len(open_):
                got = ac[peek(data, place[open_], end[open_])]
                symbol = got >> 8
                place[open_] += (got & 255) + (symbol & 15)
                seen[open_] += (symbol >> 4) + 1
                open_ = open_[(symbol != 0) & (seen[open_] < 64)]
    if (place > end + 32).any():
        raise ValueError("a frame ends before its data")
    return image


def peek(data: np.ndarray, p: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 16 bits at bit ``p`` of each lane."""
    p = np.minimum(p, end)
    byte = p >> 3
    return ((data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (8 - (p & 7))) & 0xFFFF


def cuts(images: np.ndarray, k: float = 3.0, reach: int = 12, floor: float = 0.25) -> np.ndarray:
    """Numbers of the frames that begin a new shot; rows of ``images`` are frames of equal size."""
    n = len(images)
    if n < 2:
        return np.zeros(0, np.int64)
    grid = np.bincount((np.arange(n)[:, None] * 16 + (images >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    d = np.abs(np.diff(grid, axis=0)).sum(1) / (2 * images.shape[1])
    total, square = np.append(0, d.cumsum()), np.append(0, (d * d).cumsum())
    a, b = np.maximum(np.arange(n - 1) - reach, 0), np.minimum(np.arange(n - 1) + reach + 1, n - 1)
    others = np.maximum(b - a - 1, 1)
    mean = (total[b] - total[a] - d) / others
    spread = np.sqrt(np.maximum((square[b] - square[a] - d * d) / others - mean * mean, 0))
    return np.flatnonzero((d > mean + k * spread) & (d >= floor)) + 1


def padded(data: bytes) -> bytes:
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b"\0")


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, a multiple of 64 bytes."""
    frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    ends = np.cumsum([len(p) // FRAME for p in payloads]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: float = 3.0) -> DataFrame:
    """The stored form of each text and what is read back from it.

    ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (the AVI file), media_bytes, media_sha256, feature, and shots:
    array<struct<shot, first_frame, end_frame, start_s, end_s>>.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    shot_type = pa.struct([("shot", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch, "_text")
        files = store([padded(t) for t in texts])
        got = [read_avi(f) for f in files]
        images = decode_frames([x for frames, _ in got for x in frames])
        out, at = [], 0
        for text, file, (frames, rate) in zip(texts, files, got, strict=True):
            own = np.stack(images[at : at + len(frames)])
            at += len(frames)
            back = own.tobytes()
            if not back.startswith(text) or back.strip(b"\0") != text.strip(b"\0"):
                raise AssertionError("the stored samples are not the payload")
            starts = [0, *cuts(own, k).tolist()]
            ends = [*starts[1:], len(frames)]
            shots = [{"shot": i, "first_frame": a, "end_frame": b, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
            feature = f"frames={len(frames)};shots={len(shots)};longest={max(b - a for a, b in zip(starts, ends, strict=True))};cuts={zlib.crc32(np.array(starts, '<u4').tobytes()):08x}"
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), file, len(file), hashlib.sha256(file).hexdigest(), feature, shots))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(shot_type))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "feature", "shots"]
        return pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["_id", *names])

    schema = f"_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, feature string, shots array<struct<shot:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"
    return map_batches(rows, work, schema).withColumnRenamed("_id", id_col)


def images_of(frames: list[bytes]) -> np.ndarray:
    """Luma DC images of a film's frames, all of one size; an empty frame repeats the one before, as the format has it."""
    whole = [f for f in frames if f]
    if not whole or not frames[0]:
        raise ValueError("the film begins without a frame")
    try:
        decoded = decode_frames(whole)
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError("a frame is damaged") from e
    if len({len(x) for x in decoded}) > 1:
        raise ValueError("the frames differ in size")
    return np.stack(decoded)[np.cumsum([bool(f) for f in frames]) - 1]


def clips(files: DataFrame, id_col: str, media_col: str = "media", k: float = 3.0) -> DataFrame:
    """Timed clip rows of AVI files: ``id_col``, shot, first_frame, end_frame, start_s, end_s, error.

    A file that cannot be read, or holds frames that this reader refuses, has one row with the reason in ``error`` and nothing else; null files and files without frames have none.
    """
    rows = files.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media")).where("_media is not null")
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for i, file in enumerate(utf8(batch, "_media")):
            try:
                frames, rate = read_avi(file)
                starts = [0, *cuts(images_of(frames), k).tolist()] if frames else []
                found = [(shot, a, b, a / rate, b / rate, None) for shot, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)]))]
            except (ValueError, IndexError, struct.error, ZeroDivisionError) as e:
                found = [(None, None, None, None, None, str(e) or "the file is damaged")]
            out += found
            at += [i] * len(found)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int32())), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["_id", "shot", "first_frame", "end_frame", "start_s", "end_s", "error"])

    return map_batches(rows, work, f"_id {id_type}, shot int, first_frame int, end_frame int, start_s double, end_s double, error string").withColumnRenamed("_id", id_col)
