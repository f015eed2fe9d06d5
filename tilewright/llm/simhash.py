"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A link joins two 64-bit fingerprints that differ in at most ``radius`` bits. Every
fingerprint stands for all variants within half the radius of it; two linked
fingerprints share a variant, and fingerprints that share one are linked (each is
within half the radius of it). So grouping by variant finds every link.

A variant as a row of its own would mean 2,081 rows a fingerprint at radius 4. The
shuffle therefore goes by the leading bits of the variant: a fingerprint is sent
once to each leading-bit value that one of its variants has (56 of 1,024), and the
variants that begin so are spelled out where they are grouped. The number of leading
bits follows the number of fingerprints, so that a group stays small; a group that
is large all the same is cut by further bits of the variant before it is spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import as_bytes, bound_batches, fresh, slices, small_side, staged
from tilewright.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Shingles hashed and counted at a time.
BLOCK = 1 << 16
#: Variants spelled out and sorted at a time.
SPELLED = 1 << 21
#: Fingerprints that a leading-bit value should have at most, on average.
GROUP = 1 << 20


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text's UTF-8: a bit is 1 if over half the shingle hashes set it.

    A-Z are lower-cased; words end at ASCII white space; a shingle is ``shingle``
    words joined by a space, repeats included, or all words if there are fewer.
    No words (also null): 0.
    """
    line = b" ".join((text or b"").translate(LOWER).split())
    if not line:
        return 0
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins, ends = np.append(0, ends + 1), np.append(ends, len(line))
    if len(begins) >= shingle:
        begins, ends = begins[: len(begins) - shingle + 1], ends[shingle - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(begins), BLOCK):
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(begins[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        for i in range(0, len(bits), 255):
            total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > len(begins)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs.select(F.col(id_col).alias("id"), as_bytes(text_col, "text"))).mapInArrow(_fingerprints(shingle), f"id {kind}, fp long")


def _masks(bits: range, most: int) -> list[np.ndarray]:
    """By number of flips, 0 to ``most``: all masks over these bit places (0: the highest)."""
    place = [np.uint64(1 << (63 - k)) for k in bits]
    return [np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) if c else 0 for c in combinations(place, n)], np.uint64) for n in range(most + 1)]


def _leading(value: int, bits: int) -> np.uint64:
    return np.uint64(value << (64 - bits)) if bits else np.uint64(0)


def _spelled(fps: np.ndarray, key: int, bits: int, half: int, width: int, masks: dict[int, list[np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants that several fingerprints share, of those whose leading ``bits`` are ``key``.

    Yields their owners (places in ``fps``), variant after variant, and the number of
    the variant each belongs to. ``fps`` use the highest ``width`` bits. Beyond ``most``
    variants the work is cut by the next bit.
    """
    top = _leading((1 << bits) - 1, bits)
    off = np.bitwise_count((fps ^ _leading(key, bits)) & top)
    inside = np.flatnonzero(off <= half)
    if len(inside) < 2:
        return
    off = off[inside]
    rest = masks.setdefault(bits, _masks(range(bits, width), half))
    count = sum(int((off == d).sum()) * sum(len(m) for m in rest[: half - d + 1]) for d in range(half + 1))
    if count > most and bits < width:
        for bit in (0, 1):
            for owners, runs in _spelled(fps[inside], key << 1 | bit, bits + 1, half, width, masks, most):
                yield inside[owners], runs
        return
    variants, owners = [], []
    for d in range(half + 1):
        own = inside[off == d]
        base = (fps[own] & ~top) | _leading(key, bits)
        for m in rest[: half - d + 1]:
            variants.append((base[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own, len(m)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    new = np.append(True, variants[1:] != variants[:-1])
    runs = np.cumsum(new) - 1
    shared = np.append(~new[1:], False) | ~new
    if shared.any():
        yield owners[shared], runs[shared]


def _centred(owners: np.ndarray, runs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, owner) pairs: in each run the least owner with each of the others, once."""
    begins = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    sizes = np.diff(np.append(begins, len(runs)))
    centre = np.repeat(np.minimum.reduceat(owners, begins), sizes)
    pairs = np.unique(centre[centre != owners].astype(np.int64) * n + owners[centre != owners])
    return pairs // n, pairs % n


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` places the least place that the links join it to."""
    root = np.arange(n)
    if not links:
        return root
    a, b = (np.concatenate(x) for x in zip(*links))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root[a], root[b]):
            return root


def _forest_rows(ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The links as a forest of (a, b) rows over signed ids."""
    root = _forest(len(ids), found)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[moved].view(np.int64), "b": ids[root[moved]].view(np.int64)})


def _linked(bits: int, radius: int, spelled: int):
    half, masks = radius // 2, {}

    def run(group: pa.Table) -> pa.Table:
        fps, found = np.unique(group.column("fp").to_numpy().view(np.uint64)), []
        for owners, runs in _spelled(fps, group.column("key")[0].as_py(), bits, half, 64, masks, spelled):
            a, b = _centred(owners, runs, len(fps))
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius  # always so: both are within half the radius of the variant
            found.append((a[near], b[near]))
        return _forest_rows(fps, found)

    return run


def leading_bits(count: int) -> int:
    """Leading bits of the variant that the shuffle goes by, for so many fingerprints."""
    bits = 10
    while bits < 32 and count * (1 + bits + bits * (bits - 1) // 2) >> bits > GROUP:
        bits += 2
    return bits


def links(fps: DataFrame, count: int, radius: int = 4, bits: int | None = None, spelled: int = SPELLED) -> DataFrame:
    """``(a, b)`` edges between distinct fingerprints ``fp`` whose components are those of all links.

    ``radius`` is even. Within a group the links are reduced to a forest at once, so
    a group of n near copies gives fewer than n edges, never all pairs.
    """
    bits = leading_bits(count) if bits is None else bits
    flips = [sum(1 << k for k in c) for n in range(radius // 2 + 1) for c in combinations(range(bits), n)]
    lead = F.shiftrightunsigned("fp", 64 - bits).cast("int") if bits else F.lit(0)
    sent = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: m.bitwiseXOR(lead))).alias("key"))
    return sent.groupBy("key").applyInArrow(_linked(bits, radius, spelled), "a long, b long").distinct()


def _labelled(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (with ``node``) and the ``component_id`` of their node; ``nodes`` are ``(node, least)``."""
    roots = components(edges).withColumnRenamed("node", "member")
    member = roots.join(nodes, F.col("member") == F.col("node")).select("node", "root", "least")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(ids, "root").select(F.col("node").alias("linked"), "component_id")
    labels = nodes.join(linked, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(labels, "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, bits: int | None = None) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the least id reachable over links, own included.

    Null and wordless texts have fingerprint 0 and link like any other. Equal
    fingerprints are always one component. A null id is never a component's least
    id; a component of null ids only has a null component_id. Repeated rows come back
    as often as they come in. Other columns of ``docs`` don't matter. Empty in, empty out.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.col("fp")), "fingerprints")
    nodes = staged(rows.groupBy("node").agg(F.min("id").alias("least")), "nodes")
    found = _labelled(rows, nodes, links(nodes.select(F.col("node").alias("fp")), nodes.count(), radius, bits))
    return found.select("id", "fp", "component_id")


#: Words of a long fingerprint; those that candidates are compared by, and the bits of these in which they may differ
#: (the expected share at a Jaccard similarity of 0.8 is 0.15, or 38 of 256 bits, with a deviation of 6).
LONG_WORDS, NEAR_WORDS, LONG_RADIUS = 8, 4, 70
#: Bits of a band, bands, and bits of a band that may differ.
BAND_BITS, BANDS, BAND_RADIUS = 24, 32, 2
#: Texts with so many distinct shingles at most are also found by the shingles themselves.
FEW = 40
#: Runs of so many texts at most are compared all with all, at once.
SMALL_RUN = 16
#: Pairs compared at a time.
PAIRS = 1 << 16
#: Fingerprints that a group of a band should have at most, on average.
BAND_GROUP = 1 << 18


def _streams(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further hash of each hash: SplitMix64."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles' hashes, in order; none for no words."""
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins, ends = np.append(0, ends + 1), np.append(ends, len(line))
    if len(begins) >= shingle:
        begins, ends = begins[: len(begins) - shingle + 1], ends[shingle - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(begins.tolist(), ends.tolist())]), ">u8")
    return np.unique(hashes.astype(np.uint64))


def long_fingerprint(hashes: np.ndarray, words: int = LONG_WORDS) -> np.ndarray:
    """SimHash of 64 times ``words`` bits over distinct shingle hashes; none: all zero."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    total = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 255):
        part = np.stack([_streams(hashes[k : k + 255], w) for w in range(words)], axis=1).astype(">u8")
        total += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8 * words), axis=1), axis=0, dtype=np.uint8)
    return np.frombuffer(np.packbits(2 * total > len(hashes)).tobytes(), ">u8").astype(np.uint64)


def alike(shared, a, b):
    """Whether sets of sizes ``a`` and ``b`` that share so many have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def leading_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hashes of a set: of two sets that are alike, those have one in common."""
    return hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1]


def band_places(bands: int = BANDS, width: int = BAND_BITS, words: int = LONG_WORDS) -> list[np.ndarray]:
    """The bit places of each band: fixed choices out of all, each without repeats."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return [rng.permutation(64 * words)[:width] for _ in range(bands)]


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def _band_words(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The band's bits as the highest of a word."""
    weights = np.uint64(1) << (np.uint64(63) - np.arange(len(places), dtype=np.uint64))
    return (bits[:, places] * weights[None, :]).sum(axis=1, dtype=np.uint64)


def _long_fingerprints(shingle: int):
    names = ["id", "hash", "node", "n", "shingles", *(f"w{k}" for k in range(NEAR_WORDS)), "bands", "leading"]
    places = band_places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_hashes(x.as_py(), shingle) for x in batch.column("text")]
            fps = np.array([long_fingerprint(x) for x in sets], np.uint64).reshape(-1, LONG_WORDS)
            bits = _bits(fps)
            leads = np.stack([_band_words(bits, p) >> np.uint64(64 - BAND_BITS) for p in places], axis=1).astype(np.int32)
            data = [x.tobytes() for x in sets]
            node = np.array([xxhash.xxh64_intdigest(x, SEED) for x in data], np.uint64).view(np.int64)
            leading = [leading_hashes(x).view(np.int64).tolist() if 0 < len(x) <= FEW else None for x in sets]
            columns = [pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array([x if len(x) <= 8 * FEW else None for x in data], pa.binary()), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(NEAR_WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *columns, pa.array(leads.tolist(), pa.list_(pa.int32())), pa.array(leading, pa.list_(pa.int64()))], names)

    return run


def _reached(labels: np.ndarray, hits) -> Iterator[tuple[int, int]]:
    """Links by which every two places are in one component, or were compared and aren't alike.

    Places of one label are in one component already. ``hits(front, rest)`` gives for
    each place of ``rest`` a place of ``front`` that it is alike, or -1. What a component
    has reached is compared with all that is left, also when it was reached late.
    """
    left = np.arange(len(labels))
    while len(left):
        front = left[labels[left] == labels[left[0]]]
        left = left[labels[left] != labels[left[0]]]
        while len(front) and len(left):
            by = hits(front, left)
            yield from zip(by[by >= 0].tolist(), left[by >= 0].tolist())
            moved = np.isin(labels[left], labels[left[by >= 0]])
            front, left = left[moved], left[~moved]


def _hits_of_pairs(near, members: np.ndarray):
    """``hits`` for :func:`_reached` from a test of pairs, in blocks."""

    def hits(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        by = np.full(len(rest), -1)
        at = 0
        while at < len(front) and len(open_ := np.flatnonzero(by < 0)):
            some = front[at : at + max(1, PAIRS // len(open_))]
            for k in range(0, len(open_), PAIRS):
                part = open_[k : k + PAIRS]
                found = near(np.repeat(members[some], len(part)), np.tile(members[rest[part]], len(some))).reshape(len(some), len(part))
                by[part] = np.where(found.any(axis=0), some[found.argmax(axis=0)], -1)
            at += len(some)
        return by

    return hits


class _Meeting:
    """Links among ``n`` places that meet in runs; ``near`` tells of arrays of pairs which are alike."""

    def __init__(self, n: int, near):
        self.n, self.near, self.found, self.parent = n, near, [], {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def add(self, owners: np.ndarray, runs: np.ndarray) -> None:
        """Every two owners of a run are tested, unless links found before join them."""
        begins = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        sizes = np.diff(np.append(begins, len(runs)))
        small = np.repeat(sizes <= SMALL_RUN, sizes)
        o, r = owners[small], runs[small]
        for step in range(1, SMALL_RUN):
            same = r[step:] == r[:-step]
            if not same.any():
                break
            a, b = o[step:][same].astype(np.int64), o[:-step][same]
            pairs = np.unique(np.minimum(a, b) * self.n + np.maximum(a, b))
            a, b = pairs // self.n, pairs % self.n
            for k in range(0, len(pairs), PAIRS):
                near = self.near(a[k : k + PAIRS], b[k : k + PAIRS])
                self.found.append((a[k : k + PAIRS][near], b[k : k + PAIRS][near]))
        for begin, size in zip(begins[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
            members = np.unique(owners[begin : begin + size])
            labels = np.array([self.root(x) for x in members.tolist()])
            links = [(members[a], members[b]) for a, b in _reached(labels, _hits_of_pairs(self.near, members))]
            for a, b in links:
                self.parent[self.root(int(a))] = self.root(int(b))
            if links:
                self.found.append(tuple(np.array(x, np.int64) for x in zip(*links)))


def _similar(lead: int, radius: int, spelled: int):
    masks, half = {}, BAND_RADIUS // 2

    def run(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        ids, first = np.unique(group.column("node").to_numpy(), return_index=True)
        fps = np.stack([group.column(f"w{k}").to_numpy()[first].view(np.uint64) for k in range(NEAR_WORDS)], axis=1)
        words = group.column("word").to_numpy()[first].astype(np.uint64) << np.uint64(64 - BAND_BITS)
        meeting = _Meeting(len(ids), lambda a, b: np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= radius)
        for owners, runs in _spelled(words, key, lead, half, BAND_BITS, masks, spelled):
            meeting.add(owners, runs)
        return _forest_rows(ids, meeting.found)

    return run


def _few(group: pa.Table) -> pa.Table:
    """Links, by their sets, among texts of few shingles that share a leading one."""
    ids, first, owners = np.unique(group.column("node").to_numpy(), return_index=True, return_inverse=True)
    data, sizes = group.column("shingles").to_pylist(), group.column("n").to_numpy()[first].astype(np.int64)
    sets = np.zeros((len(ids), FEW), np.uint64)
    for k, i in enumerate(first.tolist()):
        sets[k, : sizes[k]] = np.frombuffer(data[i], np.uint64)
    inside = np.arange(FEW) < sizes[:, None]

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 12):
            x, y = a[k : k + (1 << 12)], b[k : k + (1 << 12)]
            both, real = np.concatenate([sets[x], sets[y]], axis=1), np.concatenate([inside[x], inside[y]], axis=1)
            order = np.argsort(both, axis=1, kind="stable")
            both, real = np.take_along_axis(both, order, 1), np.take_along_axis(real, order, 1)
            shared = ((both[:, 1:] == both[:, :-1]) & real[:, 1:] & real[:, :-1]).sum(axis=1)
            out[k : k + (1 << 12)] = alike(shared, sizes[x], sizes[y])
        return out

    keys = group.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    meeting = _Meeting(len(ids), near)
    meeting.add(owners[order], keys[order])
    return _forest_rows(ids, meeting.found)


def _exact_hits(sets: list[np.ndarray]):
    """``hits`` for :func:`_reached` from the sets themselves."""
    sizes = np.array([len(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, flags = np.split(codes, np.cumsum(sizes)[:-1]), np.zeros(len(values), np.int64)

    def hits(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        by = np.full(len(rest), -1)
        for f in front.tolist():
            # sets of other sizes can't be alike
            open_ = np.flatnonzero((by < 0) & (5 * sizes[rest] >= 4 * sizes[f]) & (4 * sizes[rest] <= 5 * sizes[f]))
            if not len(open_):
                continue
            flags[codes[f]] = 1
            own = sizes[rest[open_]]
            shared = np.add.reduceat(flags[np.concatenate([codes[k] for k in rest[open_].tolist()])], np.cumsum(own) - own)
            flags[codes[f]] = 0
            by[open_[alike(shared, sizes[f], own)]] = f
        return by

    return hits


def _verified(shingle: int):
    def run(group: pa.Table) -> pa.Table:
        """Links by the sets among the texts that candidate links join."""
        ids, first = np.unique(group.column("node").to_numpy(), return_index=True)
        roots, texts, found = group.column("root").to_numpy()[first], group.column("text"), []
        order = np.argsort(roots, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            sets = [shingle_hashes(texts[int(first[k])].as_py(), shingle) for k in places.tolist()]
            links = list(_reached(np.arange(len(places)), _exact_hits(sets)))
            if links:
                found.append(tuple(places[np.array(x)] for x in zip(*links)))
        return _forest_rows(ids, found)

    return run


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = LONG_RADIUS) -> DataFrame:
    """``(id, component_id)`` for every row: near copies of 0.8 Jaccard similarity and more.

    Similarity is that of the sets of shingles, and every link is verified on them.
    Candidates come from fingerprints of 512 bits: bands of 24 are matched by meeting
    balls (radius 2, every band a key of its own), and texts that meet in a band
    are candidates if of 256 of the bits ``radius`` or fewer differ. Texts of few shingles are
    found by their leading shingles, without fail. The candidates' components are then
    taken apart by the sets: two of their texts are alike, joined by others, or were compared.

    Of two texts with 15 % of the bits apart, the bands miss 1 in 30,000, with 20 % 1 in 50.
    What is joined already isn't compared again, so a group of copies costs about its
    size. ``docs`` is read twice: shingles aren't stored, but made again from one text of each candidate set. Nulls, repeats and empty tables are as for :func:`near_duplicates`.
    """
    names = [f"w{k}" for k in range(NEAR_WORDS)]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, hash long, node long, n int, shingles binary, " + ", ".join(f"{w} long" for w in names) + ", bands array<int>, leading array<long>"
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), as_bytes(text_col, "text"))
    rows = bound_batches(texts).mapInArrow(_long_fingerprints(shingle), schema)
    rows = staged(rows, "long_fingerprints")
    # equal sets have equal values
    own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("own")
    nodes = staged(rows.groupBy("node").agg(F.min("id").alias("least"), own, *(F.first(c).alias(c) for c in ("n", *names, "bands"))), "long_nodes")
    lead, (count, shingles) = 0, nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    while lead < BAND_BITS - 4 and count * (1 + lead) >> lead > BAND_GROUP:
        lead += 2
    flips = F.array(*map(F.lit, [0, *(1 << k for k in range(lead))]))
    sent = nodes.where("n > 0").select("node", *names, F.posexplode("bands").alias("band", "word"))
    sent = sent.select("node", *names, "band", "word", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.shiftrightunsigned("word", BAND_BITS - lead) if lead else F.lit(0)))).alias("key"))
    loose = components(sent.groupBy("band", "key").applyInArrow(_similar(lead, radius, SPELLED), "a long, b long").distinct())
    loose = loose.withColumnRenamed("node", "member")
    # one row's text for each candidate set; shuffled at every size: at scale too many texts have candidates to send them around
    wanted = nodes.select("node", F.col("own.id").alias("own_id"), F.col("own.hash").alias("own_hash")).join(loose, F.col("node") == F.col("member")).select("node", "root", "own_id", "own_hash")
    members = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))).select("node", "root", "text")
    parts = F.pmod(F.xxhash64("root"), F.lit(1 + (shingles >> 22)))
    edges = members.groupBy(parts.alias("part")).applyInArrow(_verified(shingle), "a long, b long")
    few = rows.where("leading IS NOT NULL").select("node", "n", "shingles", F.explode("leading").alias("key")).dropDuplicates(["node", "key"])
    shared = staged(few.groupBy("key").count().where("count > 1").select(F.col("key").alias("shared")), "shared_shingles")
    few = few.join(small_side(shared), F.col("key") == F.col("shared"), "left_semi")
    edges = edges.unionByName(few.groupBy(F.pmod(F.xxhash64("key"), F.lit(1 + (count >> 14))).alias("part")).applyInArrow(_few, "a long, b long"))
    return _labelled(rows.select("id", "node"), nodes.select("node", "least"), edges).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False, **options) -> DataFrame:
    """``docs`` without the rows whose id isn't the least of its component.

    Components of :func:`near_duplicates`, or with ``similar`` of :func:`similar_texts`.
    Rows with a null id are kept. Of rows that repeat an id with equal or linked
    texts all are kept: an id stands for one document.
    """
    find = similar_texts if similar else near_duplicates
    found = find(docs, id_col, text_col, **options)
    name = fresh(docs, "_gone")
    gone = staged(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(name)).distinct(), "gone")
    return docs.join(small_side(gone), F.col(id_col) == F.col(name), "left_anti")
