import hashlib
import struct
import zlib

import numpy as np
import pytest

from testlattice.llm import media as m


def test_round_trip_of_all_bytes():
    rng = np.random.default_rng(0)
    payloads = [m.padded(x) for x in (b"", b"a", bytes(range(256)), bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), b"\xff\0" * 64)]
    files = m.store(payloads)
    for file, payload in zip(files, payloads, strict=True):
        frames, rate = m.read_avi(file)
        assert rate == m.FPS and len(frames) == len(payload) // 64
        assert b"".join(x.tobytes() for x in m.decode_frames(frames)) == payload
        assert struct.unpack_from("<I", file, 4)[0] == len(file) - 8


def test_slices(monkeypatch):
    monkeypatch.setattr(m, "SLICE", 3)
    payload = bytes(i * 7 % 256 for i in range(64 * 8))
    assert b"".join(x.tobytes() for x in m.decode_frames(m.encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, 64)))) == payload


def colour_frame():
    """A 16 x 16 YCbCr frame with 2 x 2 luma blocks, AC coefficients and a 16-bit quantiser, written bit by bit."""
    dc, ac = m.huffman((0, 2, 3, *[0] * 13), (0, 1, 2, 3, 4)), m.huffman((0, 2, 1, *[0] * 13), (0x00, 0x01, 0x12))
    bits = ""

    def put(table, symbol):
        nonlocal bits
        code, n = table[symbol]
        bits += format(code, f"0{n}b")

    before = [0, 0, 0]
    values = [(0, 5), (0, -3), (0, 0), (0, 15), (1, 2), (2, -1)]
    for part, value in values:
        d = value - before[part]
        before[part] = value
        size = abs(d).bit_length()
        if size > 4:
            raise AssertionError
        put(dc, size)
        if size:
            bits += format(d if d > 0 else d + (1 << size) - 1, f"0{size}b")
        put(ac, 0x01)
        bits += "1"
        put(ac, 0x12)
        bits += "01"
        put(ac, 0x00)
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    tables = b"\0" + bytes((0, 2, 3, *[0] * 13)) + bytes((0, 1, 2, 3, 4)) + b"\x10" + bytes((0, 2, 1, *[0] * 13)) + bytes((0x00, 0x01, 0x12))
    head = b"\xff\xd8" + m._segment(0xDB, b"\x10" + struct.pack(">64H", *[16] * 64)) + m._segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + b"\1\x22\0\2\x11\0\3\x11\0") + m._segment(0xC4, tables) + m._segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
    return head + data + b"\xff\xd9"


def test_reader_takes_colour_frames_with_ac():
    got = m.decode_frames([colour_frame(), m.encode_frames(np.full((1, 64), 9, np.uint8))[0], colour_frame()])
    want = [128 + 5 * 2, 128 - 3 * 2, 128, 128 + 15 * 2]
    assert got[0].tolist() == want == got[2].tolist() and set(got[1].tolist()) == {9}


def test_cuts_and_refusals():
    dark, light = np.full((30, 64), 10, np.uint8), np.full((20, 64), 200, np.uint8)
    assert m.cuts(np.concatenate([dark, light, dark])).tolist() == [30, 50]
    assert m.cuts(dark).tolist() == [] and m.cuts(dark[:1]).tolist() == []
    frame = m.encode_frames(dark[:1])[0]
    with pytest.raises(ValueError):
        m.decode_frames([frame.replace(b"\xff\xc0", b"\xff\xc2")])
    with pytest.raises(ValueError):
        m.read_avi(b"RIFF")


def test_operator(spark):
    texts = ["", None, "Straße", "x" * 64, "x" * 65, "same", "same", "long " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.media(df).collect()}
    for i, t in enumerate(texts):
        data = m.padded((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert r["shots"][-1]["end_frame"] == len(data) // 64
    assert got[5]["media_sha256"] == got[6]["media_sha256"] and got[5]["feature"] == got[6]["feature"]
    shots = [tuple(r) for r in m.clips(m.media(df), "doc_id").collect()]
    assert len(shots) == sum(len(r["shots"]) for r in got.values())
    assert m.media(df.limit(0)).count() == 0


def test_usual_tables():
    for counts, symbols in m.USUAL.values():
        assert sum(counts) == len(symbols) == len(set(symbols))
    assert [len(m.USUAL[x][1]) for x in (0, 1, 16, 17)] == [12, 12, 162, 162]
    grey = m.encode_frames(np.arange(64, dtype=np.uint8)[None])[0]
    tables = grey.index(b"\xff\xc4")
    size = struct.unpack_from(">H", grey, tables + 2)[0] + 2
    bare = m.Tables(grey[:tables] + grey[tables + size :])  # without Huffman tables of its own
    assert (bare.blocks[0][1] == m.Tables(grey).blocks[0][1]).all() and bare.blocks[0][2][0b1010 << 12] == 4  # end of block is 1010


def brute_cuts(images, k=3.0, reach=12, floor=0.25):
    """Cuts by plain loops over the definition."""
    import statistics

    grids = [[sum(1 for p in image if p // 16 == level) for level in range(16)] for image in images.tolist()]
    d = [sum(abs(x - y) for x, y in zip(a, b)) / (2 * images.shape[1]) for a, b in zip(grids, grids[1:])]
    out = []
    for i, x in enumerate(d):
        others = d[max(0, i - reach) : i] + d[i + 1 : i + 1 + reach]
        mean = sum(others) / len(others) if others else 0
        if x > mean + k * (statistics.pstdev(others) if others else 0) and x >= floor:
            out.append(i + 1)
    return out


def test_cuts_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        shots = [np.clip(rng.integers(0, 256) + rng.integers(-30, 30, (int(rng.integers(1, 40)), 64)), 0, 255) for _ in range(int(rng.integers(1, 6)))]
        images = np.concatenate(shots).astype(np.uint8)
        assert m.cuts(images).tolist() == brute_cuts(images)


def test_clips_of_damaged_files(spark):
    good = m.store([m.padded(bytes([10] * 64 * 30 + [200] * 64 * 20))])[0]
    frames = m.encode_frames(np.full((2, 64), 9, np.uint8))
    bad = {
        "junk": b"junk", "short": b"RIFF", "no movie": good[:60], "cut": m.write_avi([frames[0][:40]]), "text": m.write_avi([b"text"]),
        "restart": m.write_avi([frames[0][:2] + m._segment(0xDD, b"\0\1") + frames[0][2:]]), "progressive": m.write_avi([frames[0].replace(b"\xff\xc0", b"\xff\xc2")]), "first empty": m.write_avi([b"", frames[0]]),
    }
    films = {"good": good, "repeat": m.write_avi([frames[0], b"", frames[1]]), "none": m.write_avi([]), "null": None, **bad}
    rows = m.clips(spark.createDataFrame([(k, v, 1) for k, v in films.items()], "name string, media binary, shot int"), "name").collect()
    assert {r["name"] for r in rows if r["error"]} == set(bad)
    assert sorted((r["name"], r["first_frame"], r["end_frame"]) for r in rows if not r["error"]) == [("good", 0, 30), ("good", 30, 50), ("repeat", 0, 3)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, b"x", "f")], "doc_id long, text string, n_bytes int, media binary, feature string")
    assert [(r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in m.media(df).collect()] == [(1, 1, 64)]
