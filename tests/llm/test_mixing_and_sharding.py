import hashlib
import random
import zlib
from collections import Counter, defaultdict

from tilewright.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, _plan string, key string"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = rng.choice(["b"] * 10 + ["a", "c", "d", None, "é", "Z"])
        out.append((k, " ".join("w" * (1 + k % 3) for _ in range(rng.randrange(0, 40))), source, "x", "x"))
    return out + [(1000, None, "a", "x", "x"), (1001, "", "e", "x", "x"), (1002, " \n\t", "b", "x", "x"), (1003, "v " * 100_000, "c", "x", "x")]


def plain_targets(size):
    """Shares by turns: what is above its stop goes back to the others by weight."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, got = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            return got | {s: weight[s] * level for s in open_}
        for s in full:
            got[s] = 2.0 * size[s]
            left -= got[s]
        open_ -= full
    return got


def test_mix_against_plain(spark):
    data = rows()
    got = {r.id: r for r in mixing.mixed(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(got) == len(data)
    count = {d: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for d, t, *_ in data}
    size, taken = Counter(), Counter()
    for d, _, s, *_ in data:
        size[s] += count[d]
        taken[s] += got[d].taken
        assert got[d].size == count[d] and 0 <= got[d].taken <= 2 * count[d]
    want = plain_targets(size)
    for d, _, s, *_ in data:
        assert got[d].source_size == size[s] and abs(got[d].target - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in size)
    # words are taken from the head of the hash order
    by_source = defaultdict(list)
    for d, _, s, *_ in data:
        by_source[s].append((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d))
    for s, order in by_source.items():
        share = [got[d].taken / count[d] for _, d in sorted(order) if count[d]]
        assert share == sorted(share, reverse=True)


def test_mix_reruns_ranges_and_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = sorted((r.id, r.taken) for r in mixing.mixed(docs).collect())
    assert first == sorted((r.id, r.taken) for r in mixing.mixed(docs.repartition(7)).collect())
    sized = docs.select("source", mixing.words(docs.text).alias("size"), mixing.random_key(docs.doc_id, "mix").alias("key"))
    cut = lambda n: sorted(map(str, mixing.cuts(sized, mixing.targets(sized), n).collect()))
    assert cut(1 << 14) == cut(5)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    size = {r.id: (r.size, r.taken) for r in mixing.mixed(docs).collect()}
    off = [d for d, (n, k) in size.items() if n and times[d] != k / n]
    assert len(off) <= 7 and max(times.values()) <= 2  # the rows at the cuts


def test_mix_of_repeats_and_nothing(spark):
    data = [(1, "a b c d", "s", "", "")] * 6 + [(2, "a b", "t", "", ""), (None, "x y z", None, "", ""), (None, "x y z", None, "", "")]
    got = mixing.mixed(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "s", "", ""), (2, "", "t", "", "")], SCHEMA)
    assert [r.taken for r in mixing.mixed(none).collect()] == [0, 0]


def plain_shards(data, shards):
    by_source = defaultdict(list)
    for d, t, s, *_ in data:
        by_source[s].append((hashlib.md5(f"shard:{d}".encode()).hexdigest(), d))
    ranked = []
    for s, order in by_source.items():
        ranked += [((2 * k + 1) / (2 * len(order)), s is None, s or "", d) for k, (_, d) in enumerate(sorted(order))]
    out, next_slot = {}, Counter()
    for k, (*_, d) in enumerate(sorted(ranked)):
        n = k * shards // len(ranked)
        out[d] = n, next_slot[n]
        next_slot[n] += 1
    return out


def test_shards_against_plain(spark):
    data = rows(500)
    docs = spark.createDataFrame(data, SCHEMA)
    for range_rows in (1 << 14, 20):
        got = {r.id: r for r in sharding.shard(docs, range_rows=range_rows).collect()}
        want = plain_shards(data, 16)
        assert {d: (r.shard, r.slot) for d, r in got.items()} == want
    sizes = Counter(r.shard for r in got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for d, t, *_ in data:
        assert (got[d].size, got[d].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    big = Counter(r.shard for d, r in got.items() if dict((x[0], x[2]) for x in data)[d] == "b")
    assert all(abs(n - sum(big.values()) / 16) <= 2 for n in big.values())


def test_shards_of_repeats_and_nothing(spark):
    data = [(1, "a", "s", "", "")] * 5 + [(None, None, None, "", "")] * 2 + [(1, "b", "s", "", "")]
    got = sharding.shard(spark.createDataFrame(data, SCHEMA), 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 8 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
