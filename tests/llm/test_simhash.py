import random

import numpy as np
import xxhash
from tilewright.llm import simhash
from tilewright.llm.components import components
from tilewright.llm.simhash import _linked, fingerprint, keep_one, near_duplicates, similar_texts

import pyarrow as pa


def plain_fingerprint(text):
    """The definition, bit by bit."""
    import re

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Least place reachable, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "delta", "eps", "zeta", " x"]
    out = []
    for _ in range(40):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\t".join(copy))
    return out + [None, "", " \n", out[0], out[0], "one", "ONE", "a b c", "x" * 200_000, "w " * 70_000]


def test_fingerprint_is_the_definition():
    for text in texts():
        assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_against_all_pairs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.id: r for r in near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components(fps)
    assert [got[k].component_id for k in range(len(rows))] == want
    assert [got[k].fp % 2**64 for k in range(len(rows))] == fps
    assert {r.doc_id for r in keep_one(docs).collect()} == set(want)


def test_every_close_pair_is_joined_at_any_cut(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list(base)
    for x in base[:30]:
        y = int(x)
        for _ in range(6):  # chains
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(bit)
            fps.append(np.uint64(y))
    fps = np.unique(np.array(fps, np.uint64))
    want = plain_components([int(x) for x in fps])
    for bits, spelled in ((0, 1 << 22), (0, 500), (6, 200)):
        links = set()
        for key in range(1 << bits):
            group = pa.table({"key": pa.array([key] * len(fps), pa.int32()), "fp": fps.view(np.int64)})
            for a, b in zip(*[c.to_pylist() for c in _linked(bits, 4, spelled)(group).columns]):
                links.add((a, b))
        place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        root = list(range(len(fps)))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        for a, b in links:
            x, y = find(place[a]), find(place[b])
            root[max(x, y)] = min(x, y)
        assert [find(k) for k in range(len(fps))] == want


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 600)] + [(7, 7), (700, 701), (701, 700), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 101 + 100 + 2
    assert len({got[k] for k in range(101)}) == 1
    assert len({got[k] for k in range(500, 600)}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "other words entirely here now"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id is None, r.id or 0, r.component_id if r.component_id is not None else -1) for r in near_duplicates(docs).collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 8, 8), (False, 9, 8), (True, 0, -1), (True, 0, 4)]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert keep_one(docs).count() == 5


def test_similar_texts_join_near_copies_and_no_others(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, base_of = [], {}
    for b in range(60):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            base_of[len(rows)] = b
            rows.append((len(rows), " ".join(copy)))
        base_of[len(rows)] = 1000 + b  # half the words are others: not a copy
        rows.append((len(rows), " ".join(words[:200] + [rng.choice(vocabulary) for _ in range(200)])))
    rows += [(None, "x y z"), (900, None), (901, ""), (902, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in similar_texts(docs).collect()}
    assert len(got) == len(rows) and got[901] == 900 and got[902] == got[0]
    groups = {}
    for k, b in base_of.items():
        groups.setdefault(b, set()).add(got[k])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == 120
    assert similar_texts(docs.limit(0)).count() == 0


def test_texts_that_meet_are_joined_or_compared():
    rng = np.random.default_rng(8)
    for size in (5, 40, 300):
        points = rng.integers(0, 60, size)
        near = lambda a, b: abs(points[a] - points[b]) <= 1  # noqa: B023, E731
        meeting = simhash._Meeting(size, near)
        order = rng.permutation(size)
        meeting.add(order, np.zeros(size, np.int64))
        root = simhash._forest(size, meeting.found)
        for i in range(size):
            assert all(root[i] == root[j] for j in range(i) if near(i, j))
        assert len(meeting.found) == 1 or size <= simhash.SMALL_RUN


def test_the_threshold_is_exact(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], []
    for k in range(120):
        n = rng.choice((5, 7, 8, 20, 44, 60, 200, 400))
        base = [word() for _ in range(n)]
        more = [word() for _ in range(rng.randrange(0, max(2, n // 2)))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + more))]
        a, b = (len(simhash.shingle_hashes(t.encode())) for _, t in rows[-2:])
        want.append(a * 5 >= b * 4)  # the first set is inside the second
    assert 20 < sum(want) < 100
    got = {r.id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(120)] == want
    assert len(set(got.values())) == 240 - sum(want)
