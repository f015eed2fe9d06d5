import hashlib
import os
import zlib

import numpy as np
import pytest
from tilewright.llm import avi


def plain_jpeg_dc(image):
    """Samples of a gray JPEG of flat blocks, decoded bit by bit from the tables it carries."""
    at, tables, quant = 2, {}, None
    while True:
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quant = body[1]
        elif marker == 0xC0:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for length, n in enumerate(body[1:17], 1):
                for _ in range(n):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        at += 2 + size
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in image[at:-2].replace(b"\xff\x00", b"\xff"))
    pos, dc, out = 0, 0, []

    def symbol(codes):
        nonlocal pos
        for n in range(1, 17):
            if (n, int(bits[pos : pos + n], 2)) in codes:
                found = codes[n, int(bits[pos : pos + n], 2)]
                pos += n
                return found

    for _ in range(h * w // 64):
        s = symbol(tables[0])
        x = int(bits[pos : pos + s], 2) if s else 0
        pos += s
        dc += x if not s or x >> (s - 1) else x - (1 << s) + 1
        assert symbol(tables[16]) == 0
        out.append(dc * quant // 8 + 128)
    return np.array(out, np.uint8)


def test_frames_are_plain_jpeg():
    rng = np.random.default_rng(1)
    samples = np.concatenate([rng.integers(0, 256, (3, 4, 64)), np.zeros((1, 4, 64)), np.full((1, 4, 64), 255), np.tile([0, 255], (1, 4, 32))]).astype(np.uint8)
    images = avi.encode_frames(samples)
    for image, want in zip(images, samples):
        assert (plain_jpeg_dc(image) == want.ravel()).all()
    assert (avi.decode_frames(images) == samples).all()


@pytest.mark.parametrize("size", [64, 128, 1024, 1088, 64 * 1000])
def test_round_trip(size):
    for payload in (os.urandom(size), bytes(size), b"\xff" * size):
        assert avi.read_avi(avi.write_avi(payload)).payload == payload


def test_damage_is_an_error():
    media = avi.write_avi(os.urandom(4096))
    for bad in (b"", media[:100], media[:-3000], media.replace(b"\xff\xd8", b"\xff\xd7", 1), b"x" + media):
        with pytest.raises((avi.BadMedia, ValueError)):
            avi.read_avi(bad)
    cut = media[: media.index(b"idx1")]
    assert avi.read_avi(cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]).payload == avi.read_avi(media).payload


def test_shots_by_histogram():
    flat = lambda v, n: np.full((n, 16, 64), v, np.uint8)
    assert avi.shots(np.concatenate([flat(10, 5), flat(200, 4), flat(90, 1)])) == [0, 5, 9]
    assert avi.shots(flat(7, 9)) == [0]
    # cuts every four frames; a fade of steady change, one of uneven change, and flickers of one and of two frames
    assert avi.shots(np.concatenate([flat(20 + 50 * (k % 4), 4) for k in range(10)])) == list(range(0, 40, 4))
    assert avi.shots(np.stack([flat(6 * k, 1)[0] for k in range(40)])) == [0]
    rng = np.random.default_rng(3)
    fade = np.stack([np.where(rng.random(flat(0, 1)[0].shape) < k / 40, 200, 10).astype(np.uint8) for k in range(40)])
    assert avi.shots(fade) == [0]
    assert avi.shots(np.concatenate([flat(10 if k % 2 else 220, 1) for k in range(40)])) == [0]
    assert avi.shots(np.concatenate([flat(10 if k % 2 else 220, 2) for k in range(20)])) == [0]
    # a cut after a flicker, and one out of a fade
    assert avi.shots(np.concatenate([*[flat(100 if k % 2 else 130, 1) for k in range(30)], flat(250, 20)])) in ([0], [0, 30])
    assert avi.shots(np.concatenate([fade, flat(90, 30)])) == [0, 40]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 40, "x"), (3, "é" * 40, "x"), (None, "a" * 300_000, "x"), (5, "\n".join("abz "[k % 4] * 90 for k in range(900)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    encoded = avi.encode_media(docs)
    got = avi.decode_media(encoded).collect()
    assert len(got) == len(rows)
    for (doc, text, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.id, (dict((str(a), b) for a, b, _ in rows))[str(r.id)], "x")))):
        payload = avi.payload_of(text.encode() if text is not None else None)
        assert (r.id, r.n_bytes, r.payload_bytes) == (doc, len((text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.error is None and sum(c.frames for c in r.clips) == r.frames
    clips = avi.clip_rows(avi.decode_media(encoded))
    assert clips.count() == sum(len(r.clips) for r in got)
    assert avi.decode_media(avi.encode_media(docs.limit(0))).count() == 0
