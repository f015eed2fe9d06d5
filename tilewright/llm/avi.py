"""Motion-JPEG AVI: writing bytes as gray frames, reading frames back, finding shots.

Bytes are stored losslessly in baseline JPEG: one sample is one 8 x 8 block of one gray
level, so a block has a DC coefficient and nothing else. With all quantisers at 8 the
coefficient is the sample less 128, and any decoder gives the sample in all 64 pixels.

DC differences (-255 to 255) have categories 0 to 8 with as many further bits. A code
of 9 - s bits for category s makes every difference 9 bits long; Kraft's sum is 511/512,
which leaves just the all-ones code free, as JPEG demands. With one bit for "end of
block" a block is 10 bits, so encoding and decoding are array operations.

Frames with other tables, colour, all their coefficients, other sizes or no tables at all, as cameras write
them, are decoded in general (:mod:`tilewright.llm.jpeg`); shots are then found in their luminance.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import jpeg
from tilewright.llm.common import as_bytes, bound_batches, slices
from tilewright.llm.jpeg import BadMedia

#: Samples in a row, and rows in a frame at most.
WIDTH, ROWS = 64, 16
FPS = 25
#: Levels of a frame's histogram.
BINS = 64
#: A cut is a difference over this share of the range at least ...
LEAST_CHANGE = 0.10
#: ... and over so many times the median of those up to so many frames before and after ...
TIMES, WINDOW = 3.0, 12
#: ... and larger than any within so many frames of it, else it is part of a flicker or fade.
ALONE = 2

_diffs = np.arange(-255, 256)
_sizes = np.array([int(abs(d)).bit_length() for d in _diffs])
#: The 9 bits of each difference: 8 - s ones and a zero (s = 0: eight ones, a zero), then its s bits.
_nine = np.array([(((1 << (8 - s)) - 1) << 1) << s | (d if d >= 0 else d + (1 << s) - 1) for d, s in zip(_diffs.tolist(), _sizes.tolist())], np.uint16)
CODE = (_nine << 1).astype(np.uint64)
DIFF = np.full(1 << 10, 1 << 14, np.int32)
DIFF[CODE.astype(np.int64)] = _diffs


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Quantisers, and code lengths 1 to 9 for categories 8 to 0; one bit for the end of a block.
TABLES = (
    _segment(0xDB, b"\x00" + bytes([8]) * 64)
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
)
SCAN = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of ``samples``, a uint8 array (frames, rows, width)."""
    count, rows, width = samples.shape
    flat = samples.reshape(count, -1).astype(np.int16) - 128
    diffs = np.diff(flat, axis=1, prepend=np.int16(0))
    code = CODE[diffs + 255].reshape(count, -1, 4)  # a row has a multiple of 4 samples
    words = code[:, :, 0] << np.uint64(30) | code[:, :, 1] << np.uint64(20) | code[:, :, 2] << np.uint64(10) | code[:, :, 3]
    data = words.astype(">u8").view(np.uint8).reshape(count, -1, 8)[:, :, 3:]
    head = b"\xff\xd8" + TABLES + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, width * 8, 1, 1, 0x11, 0)) + SCAN
    return [head + x.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for x in data]


class OtherTables(BadMedia):
    """A frame that isn't one of :func:`encode_frames`."""


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples of :func:`encode_frames` images of one size."""
    shape, scans = None, []
    for image in images:
        at, tables = 2, b""
        if image[:2] != b"\xff\xd8" or image[-2:] != b"\xff\xd9":
            raise BadMedia("no JPEG image")
        while True:
            if at + 4 > len(image) or image[at] != 0xFF:
                raise BadMedia("a JPEG marker is missing")
            marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
            if marker in (0xDB, 0xC4):
                tables += image[at : at + 2 + size]
            elif marker == 0xC0:
                _, h, w, parts = struct.unpack(">BHHB", image[at + 4 : at + 10])
                if parts != 1 or h % 8 or w % 32 or shape not in (None, (h // 8, w // 8)):
                    raise OtherTables("no gray frames of one size")
                shape = h // 8, w // 8
            elif marker != 0xDA:
                raise OtherTables("other segments")
            at += 2 + size
            if marker == 0xDA:
                break
        if tables != TABLES or shape is None:
            raise OtherTables("other tables")
        scans.append(image[at:-2].replace(b"\xff\x00", b"\xff"))
    rows, width = shape
    if any(len(s) != rows * width // 4 * 5 for s in scans):
        raise BadMedia("a JPEG scan has a wrong length")
    data = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5)
    words = np.zeros((len(data), 8), np.uint8)
    words[:, 3:] = data
    words = words.view(">u8").astype(np.uint64).reshape(-1)
    code = np.stack([words >> np.uint64(30), words >> np.uint64(20), words >> np.uint64(10), words], axis=1) & np.uint64(1023)
    diffs = DIFF[code.astype(np.int64)].reshape(len(scans), -1)
    flat = np.cumsum(diffs, axis=1) + 128
    if flat.min() < 0 or flat.max() > 255:
        raise BadMedia("a JPEG scan has an unknown code")
    return flat.astype(np.uint8).reshape(len(scans), rows, width)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames with the payload, a positive multiple of 64 bytes.

    The last frame is filled up with zeros; the payload's length is in an INFO chunk.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    rows = min(ROWS, len(payload) // WIDTH)
    frames = -(-len(payload) // (rows * WIDTH))
    samples = np.zeros(frames * rows * WIDTH, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    images = encode_frames(samples.reshape(frames, rows, WIDTH))
    most = max(map(len, images))
    h, w = rows * 8, WIDTH * 8
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, w, h, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FPS, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    form = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\x00" % len(payload)))
    movie, index, at = [b"movi"], [], 4
    for image in images:
        chunk = _chunk(b"00dc", image)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movie.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks between two places."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise BadMedia(f"chunk {name!r} runs over its end")
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


@dataclass
class Movie:
    """``samples`` are gray levels, (frames, rows, width): what was stored, or the luminance."""

    fps: float
    samples: np.ndarray
    payload: bytes | None


def luminance(images: list[bytes]) -> np.ndarray:
    """The gray plane or the luminance of frames of one size, whatever their tables."""
    planes = [jpeg.decode(x)[:, :, 0] for x in images]
    if any(p.shape != planes[0].shape for p in planes):
        raise BadMedia("frames of several sizes")
    return np.stack(planes)


def _movie_chunks(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a ``movi`` list, those of its ``rec`` lists among them."""
    for name, b, e in _chunks(data, begin, end):
        if name == b"LIST" and data[b : b + 4] == b"rec ":
            yield from _chunks(data, b + 4, e)
        else:
            yield name, b, e


def read_avi(data: bytes) -> Movie:
    """Frames of an AVI file by its index, or by its chunks where it has none.

    The frames are those of the first video stream, in all of the file's RIFF parts. Parts after the first
    have no such index and are read by their chunks. An empty chunk repeats the frame before it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no AVI file")
    fps, length, lists, entries, kinds = float(FPS), None, [], [], []
    for part, begin, end in _chunks(data, 0, len(data)):
        if part != b"RIFF" or data[begin : begin + 4] not in (b"AVI ", b"AVIX"):
            raise BadMedia("a part of the file is no AVI")
        for name, begin, end in _chunks(data, begin + 4, end):
            kind = data[begin : begin + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for n, b, e in _chunks(data, begin + 4, end):
                    if n == b"avih":
                        fps = 1e6 / max(1, int.from_bytes(data[b : b + 4], "little"))
                    elif n == b"LIST" and data[b : b + 4] == b"strl":
                        kinds += [data[x : x + 4] for m, x, _ in _chunks(data, b + 4, e) if m == b"strh"]
            elif kind == b"INFO":
                for n, b, e in _chunks(data, begin + 4, end):
                    if n == b"ICMT" and data[b:e].startswith(b"payload="):
                        length = int(data[b + 8 : e].rstrip(b"\x00"))
            elif kind == b"movi":
                lists.append((begin, end))
            elif name == b"idx1" and not entries:
                entries = [struct.unpack("<4sIII", data[k : k + 16]) for k in range(begin, end - 15, 16)]
    if not lists:
        raise BadMedia("no frames")
    stream = kinds.index(b"vids") if b"vids" in kinds else 0
    names, places = {b"%02ddc" % stream, b"%02ddb" % stream}, []
    entries = [x for x in entries if x[0] in names]
    for k, (begin, end) in enumerate(lists):
        if k == 0 and entries:
            # places are told from the list's begin or, by some writers, from the file's
            origin = begin if data[begin + entries[0][2] : begin + entries[0][2] + 4] in names else 0
            found = [(origin + at + 8, origin + at + 8 + size) for _, _, at, size in entries]
            if any(e > end or b < begin or data[b - 8 : b - 4] not in names for b, e in found):
                raise BadMedia("the index points beside the frames")
            places += found
        else:
            places += [(b, e) for n, b, e in _movie_chunks(data, begin + 4, end) if n in names]
    images = []
    for b, e in places:
        if e > b or images:
            images.append(data[b:e] if e > b else images[-1])
    if not images:
        raise BadMedia("no frames")
    try:
        samples = decode_frames(images)
    except OtherTables:
        return Movie(fps, luminance(images), None)
    return Movie(fps, samples, None if length is None else samples.tobytes()[:length])


def changes(samples: np.ndarray) -> np.ndarray:
    """For each frame but the first, how far its pixels' levels moved: the distance that turns one histogram into the other, of the whole range.

    A small shift of all pixels is a small change, so a fade isn't a row of jumps from level to level.
    """
    if len(samples) < 2:
        return np.zeros(0)
    frames = np.arange(len(samples))[:, None] * BINS
    levels = (samples.reshape(len(samples), -1) // (256 // BINS)).astype(np.int64)
    counts = np.bincount((frames + levels).ravel(), minlength=len(samples) * BINS).reshape(-1, BINS)
    return np.abs(np.cumsum(np.diff(counts, axis=0), axis=1)).sum(axis=1) / (levels.shape[1] * (BINS - 1))


def shots(samples: np.ndarray) -> list[int]:
    """First frames of the shots: where the histogram changes by more than the frames before and after let expect.

    Every difference counts for the ones around it, cuts too; so steady change, like a fade's or a flicker's, is no cut.
    """
    change, found = changes(samples), [0]
    for k in np.flatnonzero(change >= LEAST_CHANGE).tolist():
        around = np.concatenate([change[max(0, k - WINDOW) : k], change[k + 1 : k + 1 + WINDOW]])
        near = np.concatenate([change[max(0, k - ALONE) : k], change[k + 1 : k + 1 + ALONE]])
        if not len(around) or change[k] > TIMES * np.median(around) and change[k] > near.max():
            found.append(k + 1)
    return found


def payload_of(text: bytes | None) -> bytes:
    """A text's UTF-8, null as empty, with zeros up to a positive multiple of 64 bytes."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [t.as_py() or b"" for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([write_avi(payload_of(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: every text's bytes as an AVI file; null is the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), as_bytes(text_col, "text"))
    return bound_batches(rows).mapInArrow(_encoded, f"id {kind}, n_bytes long, media binary")


CLIPS = "array<struct<clip:int,first_frame:int,frames:int,begin_s:double,end_s:double,mean:double,sha256:string>>"


def _clips(movie: Movie) -> list[dict]:
    begins = shots(movie.samples)
    out = []
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(movie.samples)])):
        part = movie.samples[a:b]
        out.append({"clip": k, "first_frame": a, "frames": b - a, "begin_s": a / movie.fps, "end_s": b / movie.fps, "mean": float(part.mean(dtype=np.float64)), "sha256": hashlib.sha256(part.tobytes()).hexdigest()})
    return out


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "clips", "error"]
    kinds = [None, None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), None, pa.string()]
    for batch in slices(batches, "media"):
        rows = []
        for value in batch.column("media"):
            media = value.as_py()
            if media is None:
                rows.append((None, None, None, None, None, None, None, None))
                continue
            whole = len(media), hashlib.sha256(media).hexdigest()
            try:
                movie = read_avi(media)
                data = movie.payload if movie.payload is not None else movie.samples.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), *whole, len(movie.samples), _clips(movie), None))
            except (BadMedia, struct.error, ValueError, IndexError) as error:
                rows.append((None, None, None, *whole, None, None, str(error)[:200]))
        columns = list(zip(*rows))
        kinds[8] = CLIP_TYPE
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(columns, kinds[2:]))], names)


CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64()), ("sha256", pa.string())]))


def decode_media(media: DataFrame) -> DataFrame:
    """One row for each of :func:`encode_media`'s: digests of what was read back, and its clips.

    A damaged file gives nulls and its ``error``; null media give nulls. Of a movie by another writer the
    luminance counts as what was read back. Repeated rows come back repeated; equal media give equal values. Equal
    changes in a row are no cut: none stands out from the others.
    """
    kind = media.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, clips {CLIPS}, error string"
    return bound_batches(media.select("id", "n_bytes", "media")).mapInArrow(_decoded, schema)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """A row for each timed clip of :func:`decode_media`'s rows."""
    return decoded.select("id", F.explode("clips").alias("c")).select("id", "c.*")
