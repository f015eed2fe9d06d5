"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Merging greedily by score gives every text one sequence of tokens, and each prefix
of it one last token: that of its own encoding. A sequence is the encoding exactly if
each two neighbours are, that is, if merging their joined text gives these two back.
So the table is filled from the left: of the pieces that end at a place (matches of
an Aho-Corasick automaton) the last token is the one compatible with the last token
of the prefix before it. Ids are then recovered backwards. No queue of merges, and
linear in the text but for the number of matches at a place.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bound_batches, slices, sole_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A single letter, as the segments are cut.
LETTER = re.compile(r"[^\W\d_]").match
#: Segments of at most so many characters are remembered: so many, and as many that were before.
KEPT_LENGTH, KEPT = 48, 240_000
#: Remembered answers of the compatibility test.
KEPT_PAIRS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """A BPE model file: pieces, scores, types and the flags of its normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if normalizer.get(2) or normalizer.get(6) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only the identity normaliser that keeps white space and marks spaces before words is handled")
        if not set(self.types) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not handled")
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with all byte pieces are handled")
        self.end = next(k for k, (p, t) in enumerate(zip(self.pieces, self.types)) if t == CONTROL and p == "</s>")
        self.unknown = self.types.index(UNKNOWN)
        self.automaton = ahocorasick.Automaton()
        joined = set()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, (self.ids[piece], len(piece)))
                joined.update(piece)
        self.automaton.make_automaton()
        #: No piece goes on with a space after another character, or from letters to
        #: others or back: texts fall apart there, as no merge can cross.
        inner = {(x, y) for p in self.ids for x, y in zip(p, p[1:]) if x != SPACE}
        self.by_word = not any(y == SPACE for _, y in inner)
        by_kind = not any(bool(LETTER(x)) != bool(LETTER(y)) for x, y in inner)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        words = rf"[^\W\d_]+|(?:[^\w{SPACE}{alone}]|[\d_])+" if by_kind else f"[^{SPACE}{alone}]+"
        self.segment = re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*(?:{words})|{SPACE}+").findall
        self.sizes = list(map(len, self.pieces))
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The definition, for short texts: join the best-scored neighbours, leftmost first."""
        parts = list(text)
        while True:
            found = [(-self.scores[k], i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined text of two tokens encodes to these two; left 0: the text's begin."""
        a, b = self.surface(left) if left else "", self.surface(right)
        return self.merged(a + b) == ([a, b] if a else [b])

    def surface(self, token: int) -> str:
        """A piece, or the character that a number beyond the pieces stands for."""
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def tokens(self, text: str) -> list[int]:
        """Tokens of a segment by the prefix table; characters outside the pieces get numbers beyond them."""
        ids, beyond, fits = self.ids, len(self.pieces), self.fits
        last, done, known_of = [0], 1, fits.get  # last[k]: the last token of the first k characters, for k < done
        single = [ids[c] if c in ids else beyond + ord(c) for c in text]
        for end, (piece, size) in self.automaton.iter(text):
            if done > end:
                if done > end + 1:  # its last token is found already
                    continue
            else:
                last += single[done - 1 : end]
                done = end + 1
            left = last[done - size]
            known = known_of(left << 21 | piece)
            if known is None:
                if len(fits) >= KEPT_PAIRS:
                    fits.clear()
                known = fits[left << 21 | piece] = self.compatible(left, piece)
            if known:
                last.append(piece)
                done += 1
        last += single[len(last) - 1 :]
        out, at, sizes = [], len(text), self.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token] if token < beyond else 1
        out.reverse()
        return out

    def segment_ids(self, text: str) -> tuple[int, ...]:
        tokens = self.tokens(text)
        if max(tokens) < (beyond := len(self.pieces)):
            return tuple(tokens)
        return tuple(x for k in tokens for x in ((k,) if k < beyond else map(self.bytes.__getitem__, chr(k - beyond).encode())))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without the end id."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        out: list[int] = []
        kept = self.kept
        for part in self.segment(text) if self.by_word else [text]:
            ids = kept.get(part)
            if ids is None:
                ids = self.older.get(part) or self.segment_ids(part)
                if len(part) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the marked first space dropped."""
        if not hasattr(self, "raw"):
            self.raw = [
                bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
                for p, t in zip(self.pieces, self.types)
            ]
        first = next((k for k in ids if self.types[k] != CONTROL), None)
        data = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE):
            data = data[1:]
        return data.decode(errors="replace")


_loaded: dict[str, Model] = {}


def _model(data: bytes) -> Model:
    """The model of these bytes, built once in a Python worker."""
    sole_cache("pieces", _loaded.clear)
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(data)
    return _loaded[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; without a path the public 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


@contextmanager
def _no_gc() -> Iterator[None]:
    """Without looking for reference cycles: none are made, and what is kept is large to look through."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _text(value) -> str:
    return (value.as_py() or b"").decode(errors="replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """``(id, ids array<int>)`` for every row: the text's ids and the end id.

    Null is the empty text: the end id alone. Whole texts, repeated rows repeated;
    other columns don't matter. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for batch in slices(batches, "text"):
            with _no_gc():
                ids = [[*m.encode(_text(x)), m.end] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return bound_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """``(id, text)`` for rows of :func:`encode`; null ids give the empty text."""
    kind = encoded.schema["id"].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([m.decode(x.as_py() or []) for x in part.column("ids")], pa.string())], ["id", "text"])

    return bound_batches(encoded.select("id", "ids")).mapInArrow(run, f"id {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode, then decode the ids, in one pass.

    As :func:`encode` and :func:`decode` in turn, without sending the ids through the JVM.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(sent.value)
        digits = list(map(str, range(len(m.pieces))))
        for batch in slices(batches, "text"):
            counts, hashes, texts = [], [], []
            with _no_gc():
                for x in batch.column("text"):
                    ids = m.encode(_text(x))
                    ids.append(m.end)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    texts.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(texts)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bound_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
