"""Baseline JPEG frames, decoded: any quantisers and Huffman tables, one or three components, subsampling, restarts.

The tables that motion-JPEG files leave out are the usual ones. Decoding goes symbol by symbol, blocks are
transformed all at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class BadMedia(ValueError):
    """The bytes aren't a file of this kind, or are damaged."""


def _run(high: str, low: str) -> str:
    return " ".join(h + x for h in high.split() for x in low.split())


_LOW = "1 2 3 4 5 6 7 8 9 a"
#: The usual Huffman tables, codes by length 1 to 16, then symbols in order of their codes. By class and id.
USUAL = {
    (0, 0): ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (0, 1): ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (1, 0): (
        "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a "
        + _run("4 5 6 7", "3 4 5 6 7 8 9 a") + " 83 84 85 86 87 88 89 8a " + _run("9 a b c d", "2 3 4 5 6 7 8 9 a") + " " + _run("e f", _LOW),
    ),
    (1, 1): (
        "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a "
        + _run("4 5 6 7", "3 4 5 6 7 8 9 a") + " " + _run("8 9 a b c d e f", "2 3 4 5 6 7 8 9 a"),
    ),
}
#: Place in the block of each coefficient in its order: diagonals, up and down in turns.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])
_k = np.arange(8)
#: The cosine transform's matrix: pixels are C^T x C.
COSINE = np.where(_k[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


def huffman(counts: list[int], symbols: bytes) -> np.ndarray:
    """For each 16 bits the length of the code that they begin with, and its symbol; length 0 where there is none."""
    table, code, at = np.zeros((1 << 16, 2), np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if at >= len(symbols) or code >= 1 << length:
                raise BadMedia("a Huffman table doesn't add up")
            low = code << (16 - length)
            table[low:low + (1 << (16 - length))] = length, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def usual(kind: int, number: int) -> np.ndarray:
    counts, symbols = USUAL[kind, number]
    return huffman([int(x) for x in counts.split()], bytes.fromhex(symbols))


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    blocks: list = field(default_factory=list)


class Bits:
    """Bits of an entropy-coded segment; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.count, self.lent = data, 0, 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            part = self.data[self.at:self.at + 6]
            if not part:
                self.lent += 8
                if self.lent > 64:
                    raise BadMedia("a JPEG scan ends early")
                part = b"\xff"
            self.at += len(part)
            self.value = (self.value & ((1 << self.count) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
            self.count += 8 * len(part)

    def symbol(self, table: list) -> int:
        self.need(16)
        length, symbol = table[self.value >> (self.count - 16) & 0xFFFF]
        if not length:
            raise BadMedia("a JPEG scan has an unknown code")
        self.count -= length
        return symbol

    def number(self, size: int) -> int:
        """A number of a size category."""
        if not size:
            return 0
        self.need(size)
        self.count -= size
        x = self.value >> self.count & ((1 << size) - 1)
        return x if x >> (size - 1) else x - (1 << size) + 1


def _block(bits: Bits, dc: list, ac: list, before: int) -> list[int]:
    out = [0] * 64
    out[0] = before + bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        symbol = bits.symbol(ac)
        if symbol == 0:
            break
        run, size = symbol >> 4, symbol & 15
        k += run
        if size:
            if k > 63:
                raise BadMedia("a JPEG block runs over its end")
            out[k] = bits.number(size)
        k += 1
    return out


def decode(image: bytes) -> np.ndarray:
    """Planes of a baseline JPEG image at full size, (height, width, 1 or 3): gray, or Y, Cb and Cr."""
    if image[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG image")
    at, quantisers, codes, parts, every, shape = 2, {}, {}, [], 0, None
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise BadMedia("a JPEG marker is missing")
        marker = image[at + 1]
        if marker == 0xFF:  # filling
            at += 1
            continue
        size = int.from_bytes(image[at + 2:at + 4], "big")
        body = image[at + 4:at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise BadMedia("a JPEG segment is cut off")
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                values = np.frombuffer(body[1:1 + 64 * (wide + 1)], ">u2" if wide else np.uint8)
                if len(values) != 64:
                    raise BadMedia("a quantiser table is cut off")
                quantisers[number] = values.astype(np.float64)
                body = body[1 + 64 * (wide + 1):]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = huffman(counts, body[17:17 + sum(counts)])
                body = body[17 + sum(counts):]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
                raise BadMedia("only 8-bit frames of one or three components are read")
            shape = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise BadMedia("only baseline frames are read")
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        at += 2 + size
        if marker == 0xDA:
            break
    if not parts or not all(shape) or any(p.quantiser not in quantisers or not 1 <= p.across <= 4 or not 1 <= p.down <= 4 for p in parts):
        raise BadMedia("a JPEG frame lacks its header or a table")
    named = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if set(named) != {p.number for p in parts}:
        raise BadMedia("only scans of all components are read")
    for p in parts:
        p.dc, p.ac = named[p.number] >> 4, named[p.number] & 15
    tables = {}
    for p in parts:
        for key in ((0, p.dc), (1, p.ac)):
            if key not in codes and key not in USUAL:
                raise BadMedia("a Huffman table is missing")
            tables[key] = [tuple(x) for x in (codes[key] if key in codes else usual(*key)).tolist()] if key not in tables else tables[key]
    across, down = max(p.across for p in parts), max(p.down for p in parts)
    if len(parts) == 1:
        across = down = parts[0].across = parts[0].down = 1
    wide, high = -(-shape[1] // (8 * across)), -(-shape[0] // (8 * down))
    segments = _segments(image, at, every)
    for k in range(0, wide * high, every or wide * high):
        if not segments:
            raise BadMedia("a JPEG scan ends early")
        bits, before = Bits(segments.pop(0)), [0] * len(parts)
        for _ in range(min(every or wide * high, wide * high - k)):
            for n, p in enumerate(parts):
                for _ in range(p.across * p.down):
                    p.blocks.append(_block(bits, tables[0, p.dc], tables[1, p.ac], before[n]))
                    before[n] = p.blocks[-1][0]
    return np.stack([_plane(p, quantisers[p.quantiser], wide, high, across, down)[:shape[0], :shape[1]] for p in parts], 2)


def _segments(image: bytes, at: int, every: int) -> list[bytes]:
    """The scan's bytes, cut at restarts, up to the next marker."""
    out, begin = [], at
    while True:
        k = image.find(b"\xff", at)
        if k < 0 or k + 1 >= len(image):
            out.append(image[begin:k if k >= 0 else len(image)])
            break
        if image[k + 1] == 0:
            at = k + 2
        elif 0xD0 <= image[k + 1] <= 0xD7 and every:
            out.append(image[begin:k])
            begin = at = k + 2
        else:
            out.append(image[begin:k])
            break
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _plane(part: Component, quantiser: np.ndarray, wide: int, high: int, across: int, down: int) -> np.ndarray:
    found = np.array(part.blocks, np.float64) * quantiser
    blocks = np.zeros_like(found)
    blocks[:, ZIGZAG] = found
    pixels = COSINE.T @ blocks.reshape(-1, 8, 8) @ COSINE
    pixels = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)
    rows = pixels.reshape(high, wide, part.down, part.across, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(high * part.down * 8, wide * part.across * 8)
    return np.repeat(np.repeat(rows, down // part.down, 0), across // part.across, 1)
