import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F
from tilewright.llm import fingerprints as fp
from tilewright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, range int, tie string, guest string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*parts):
    """Spark's XXH64 over values: each one's hash is the next one's seed."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x) if abs(x) > 1 << 31 else x.to_bytes(4, "little", signed=True), seed)
    return seed


def hash_of_longs(values):
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed


def shingles(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [signed(hash_of(w)) for w in text.split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def plain(text):
    """Bins in a list, empty ones filled by walking their draws."""
    bins = [None] * 128
    for s in shingles(text or ""):
        h = signed(hash_of_longs(s))
        b = (h >> 57) + 64
        bins[b] = h if bins[b] is None else min(bins[b], h)
    out = []
    for j in range(128):
        s, c = hash_of(j, 0) & 127 | 1, hash_of(j, 1) & 127
        order = sorted(range(128), key=lambda b: (b * s + c) & 127)
        assert len({(b * s + c) & 127 for b in range(128)}) == 128
        out.append(bins[j] if bins[j] is not None else next(bins[b] for b in order if bins[b] is not None))
    return "".join(f"{v & 255:02x}" for v in out)


def alike(a, b):
    equal = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128
    return min(1.0, max(0.0, (equal - 1 / 256) / (1 - 1 / 256)))


def rows(n=120, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "\U0001f600x", "Ünï"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 300]))) for _ in range(n)]
    data = [(k * 3 - 50, t, k, "x", None) for k, t in enumerate(texts)]
    data += [(7, None, 1, "", ""), (7, "", 1, "", ""), (8, " \n\t", 1, "", ""), (8, "one\ttwo\nthree four  five", 1, "", ""), (8, "one two three four five", 1, "", "")]
    data += [(None, "null id", 1, "", ""), (None, "null id", 1, "", ""), (9, "again and again", 2, "", ""), (9, "again and again", 2, "", "")]
    return data + [(10_000, "long " * 60_000 + "end", 3, "", ""), (10_001, "x" * 400_000, 3, "", "")]


def plain_edited(data):
    """All rows sorted in one list."""
    tie = lambda t: signed(hash_of(t))
    order = sorted(((d, t or "") for d, t, *_ in data), key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    out = []
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = plain(t), plain(edited), plain(following)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(alike(a, b), 12), round(alike(a, c), 12)))
    return out


def found(df):
    return [(r.id, r.n_chars, r.edited_sha256, r.a, r.b, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.withColumns({"a": fp.shown(F.col("fingerprint")), "b": fp.shown(F.col("edited_fingerprint"))}).collect()]


@pytest.mark.parametrize("range_rows", [1, 7, 4096])
def test_edited_likeness_against_one_list(spark, range_rows):
    data = rows()
    got = found(fp.edited_likeness(spark.createDataFrame(data, SCHEMA).repartition(3), range_rows=range_rows))
    assert sorted(map(repr, got)) == sorted(map(repr, plain_edited(data)))


@pytest.mark.parametrize("data", [[(1, "a b c d e f", 1, "", "")], [(None, "a b", 1, "", "")], [(None, None, 1, "", ""), (None, "x y", 1, "", "")], [(4, "same text", 1, "", "")] * 9])
def test_few_rows(spark, data):
    got = found(fp.edited_likeness(spark.createDataFrame(data, SCHEMA), range_rows=2))
    assert sorted(map(repr, got)) == sorted(map(repr, plain_edited(data)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.edited_likeness(empty).count() == 0 and fp.fingerprints(empty).count() == 0


def test_likeness_has_no_bias(spark):
    rng = random.Random(11)
    pairs = []
    for share in (0.0, 0.1, 0.3, 0.5, 0.8, 1.0):
        for size in (30, 400):
            for k in range(60):
                a = [f"{k}.{share}.{size}.{x}" for x in range(size)]
                b = a[: int(size * share)] + [f"other {rng.random()}" for _ in range(int(size * share), size)]
                pairs.append((share, size, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "share double, size int, a string, b string")
    got = df.withColumn("near", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()
    error = {}
    for r in got:
        x, y = shingles(r.a), shingles(r.b)
        error.setdefault((r.share, r.size), []).append(r.near - len(x & y) / len(x | y))
    assert all(abs(sum(e) / len(e)) < 0.03 for e in error.values())
    # k bins: the error of one estimate is about sqrt(J (1 - J) / k)
    assert all((sum(x * x for x in e) / len(e)) ** 0.5 < 0.09 for e in error.values())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = plain_edited([(r.doc_id, r.text) for r in docs])
    got = QUERIES["op11_fingerprints"](spark, sf_dir).collect()
    shown = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in got]
    assert sorted(shown) == sorted(want)
