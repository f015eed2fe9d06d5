"""The general JPEG decoder against a plain encoder, and AVI files as cameras write them."""

import struct

import numpy as np
import pytest
from tilewright.llm import avi, jpeg


def table_codes(counts, symbols):
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = f"{code:0{length}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return out


def usual(kind, number):
    counts, symbols = jpeg.USUAL[kind, number]
    return [int(x) for x in counts.split()], list(bytes.fromhex(symbols))


ORDER = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def transform(block):
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            c = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
            x, y = np.arange(8)[:, None], np.arange(8)[None, :]
            out[u, v] = c * (block * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)).sum()
    return out


def amplitude(v):
    size = int(abs(v)).bit_length()
    return size, (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")


def encode(planes, factors, step=1, every=0, tables=True, custom=False):
    """A baseline JPEG of planes with sampling factors; ``step`` is every quantiser."""
    top = max(f[0] for f in factors), max(f[1] for f in factors)
    h, w = planes[0].shape[0] * top[1] // factors[0][1], planes[0].shape[1] * top[0] // factors[0][0]
    wide, high = -(-w // (8 * top[0])), -(-h // (8 * top[1]))
    kinds = [min(k, 1) for k in range(len(planes))]
    codes = {(c, n): table_codes(*usual(c, n)) for c in (0, 1) for n in (0, 1)}
    if custom:  # every symbol 8 bits long
        flat = [0] * 7 + [255] + [0] * 8, list(range(255))
        codes = dict.fromkeys(codes, table_codes(*flat))
    bits, scan, before = "", b"", [0] * len(planes)

    def flush():
        nonlocal bits
        data = int("1" + bits + "1" * (-len(bits) % 8), 2).to_bytes(len(bits) // 8 + 2, "big")[-(-(-len(bits) // 8)):] if bits else b""
        bits = ""
        return data.replace(b"\xff", b"\xff\x00")

    for unit in range(wide * high):
        if every and unit and unit % every == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (unit // every - 1) % 8])
            before = [0] * len(planes)
        my, mx = divmod(unit, wide)
        for n, (plane, (fx, fy)) in enumerate(zip(planes, factors)):
            for by in range(fy):
                for bx in range(fx):
                    y, x = (my * fy + by) * 8, (mx * fx + bx) * 8
                    padded = np.pad(plane, ((0, high * fy * 8 - plane.shape[0]), (0, wide * fx * 8 - plane.shape[1])), mode="edge")
                    block = np.rint(transform(padded[y:y + 8, x:x + 8].astype(float) - 128) / step).astype(int).ravel()[ORDER].tolist()
                    size, extra = amplitude(block[0] - before[n])
                    before[n] = block[0]
                    bits += codes[0, kinds[n]][size] + extra
                    run = 0
                    last = max((k for k in range(1, 64) if block[k]), default=0)
                    for k in range(1, last + 1):
                        if not block[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits += codes[1, kinds[n]][0xF0]
                            run -= 16
                        size, extra = amplitude(block[k])
                        bits += codes[1, kinds[n]][run << 4 | size] + extra
                        run = 0
                    if last < 63:
                        bits += codes[1, kinds[n]][0]
    scan += flush()
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    out = b"\xff\xd8" + seg(0xE0, b"AVI1\x00" + bytes(9)) + seg(0xDB, b"\x00" + bytes([step]) * 64) + seg(0xDB, b"\x11" + struct.pack(">64H", *[step] * 64))
    if tables:
        for (c, n) in codes:
            counts, symbols = ([0] * 7 + [255] + [0] * 8, list(range(255))) if custom else usual(c, n)
            out += seg(0xC4, bytes([c << 4 | n]) + bytes(counts) + bytes(symbols))
    out += seg(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, fx << 4 | fy, kinds[k]]) for k, (fx, fy) in enumerate(factors)))
    if every:
        out += seg(0xDD, struct.pack(">H", every))
    return out + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, kinds[k] * 0x11]) for k in range(len(planes))) + b"\x00\x3f\x00") + scan + b"\xff\xd9"


def picture(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    noise = np.random.default_rng(seed).integers(-20, 20, (h, w))
    return np.clip(128 + 80 * np.sin(x / 7 + seed) * np.cos(y / 5) + noise, 0, 255).astype(np.uint8)


def test_fixed_tables_and_order():
    assert jpeg.ZIGZAG.tolist() == ORDER
    for key, most in (((0, 0), 12), ((0, 1), 12), ((1, 0), 162), ((1, 1), 162)):
        counts, symbols = usual(*key)
        assert sum(counts) == len(symbols) == len(set(symbols)) == most


@pytest.mark.parametrize("options", [{}, {"every": 2}, {"tables": False}, {"custom": True}, {"tables": False, "every": 1}])
def test_gray_frames_of_all_coefficients(options):
    plane = picture(27, 45)
    got = jpeg.decode(encode([plane], [(1, 1)], 1, **options))
    assert got.shape == (27, 45, 1) and np.abs(got[:, :, 0].astype(int) - plane).max() <= 1


@pytest.mark.parametrize("luma", [(1, 1), (2, 1), (2, 2)])
def test_colour_frames(luma):
    h, w = 48, 64
    planes = [picture(h, w), picture(h // luma[1], w // luma[0], 1), picture(h // luma[1], w // luma[0], 2)]
    got = jpeg.decode(encode(planes, [luma, (1, 1), (1, 1)], 1, every=3))
    for k, plane in enumerate(planes):
        full = plane if k == 0 else np.repeat(np.repeat(plane, luma[1], 0), luma[0], 1)
        assert np.abs(got[:, :, k].astype(int) - full).max() <= 1
    coarse = jpeg.decode(encode(planes, [luma, (1, 1), (1, 1)], 6))
    assert np.abs(coarse[:, :, 0].astype(int) - planes[0]).mean() < 3


def test_damaged_frames_are_errors():
    good = encode([picture(16, 16)], [(1, 1)], 1)
    for bad in (b"", good[:40], good[:-60], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good.replace(b"\xff\xdb", b"\xff\xe1"), good[:20] + b"\x00" + good[20:]):
        with pytest.raises((jpeg.BadMedia, IndexError, struct.error)):
            jpeg.decode(bad)


def camera_file(images, streams=(b"auds", b"vids"), absolute=False, parts=1, index=True, rec=False):
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\x00" * (len(b) & 1)
    name = b"%02ddc" % streams.index(b"vids")
    strl = b"".join(chunk(b"LIST", b"strl" + chunk(b"strh", s + b"MJPG" + bytes(48))) for s in streams)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<I", 40_000) + bytes(52)) + strl)
    out, share = b"", -(-len(images) // parts)
    for p in range(parts):
        body = b"movi"
        base = len(out) + 12 + len(head) + 8 if p == 0 else 0
        entries = b""
        for k, x in enumerate(images[p * share:(p + 1) * share]):
            sound = chunk(b"00wb", bytes(6))
            body += sound
            entries += struct.pack("<4sIII", b"00wb", 0, len(body) + (base if absolute else 0), 6)
            entries += struct.pack("<4sIII", name, 0x10, len(body) + (base if absolute else 0), len(x))
            body += chunk(b"LIST", b"rec " + chunk(name, x)) if rec else chunk(name, x)
        inner = (b"AVI " + head if p == 0 else b"AVIX") + chunk(b"LIST", body) + (chunk(b"idx1", entries) if index and p == 0 else b"")
        out += chunk(b"RIFF", inner)
    return out


@pytest.mark.parametrize("form", [{}, {"absolute": True}, {"index": False}, {"parts": 2}, {"index": False, "rec": True}])
def test_camera_files(form):
    planes = [picture(16, 32, s) for s in (0, 0, 0, 9, 9)]
    dark = [np.zeros_like(planes[0])] * 3
    frames = planes + dark
    images = [encode([p, p[::2, ::2], p[::2, ::2]], [(2, 2), (1, 1), (1, 1)], 2, tables=False) for p in frames]
    movie = avi.read_avi(camera_file(images, **form))
    assert movie.fps == 25 and movie.payload is None and movie.samples.shape == (8, 16, 32)
    assert all(np.abs(a.astype(int) - b).mean() < 2 for a, b in zip(movie.samples, frames))
    assert avi.shots(movie.samples)[-1] == 5


def test_camera_rows(spark):
    images = [encode([picture(16, 16, s)], [(1, 1)], 1) for s in (0, 0)] + [b""]
    rows = [(1, 5, bytearray(camera_file(images))), (2, None, None), (3, 0, bytearray(b"RIFF")), (1, 5, bytearray(camera_file(images)))]
    got = avi.decode_media(spark.createDataFrame(rows, "id int, n_bytes long, media binary")).collect()
    by = {r.id: r for r in got}
    assert len(got) == 4 and by[1].error is None and by[1].frames == 3 and sum(c.frames for c in by[1].clips) == 3
    assert by[2].error is None and by[2].clips is None and by[3].error
