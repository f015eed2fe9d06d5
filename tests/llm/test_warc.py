import gzip
import random

import pytest
from pyspark.errors import PySparkException
from tilewright.llm import warc


def archive(n=30):
    rng = random.Random(n)
    return [warc.record(str(k), f"http://h/{k}", rng.randbytes(rng.randrange(0, 3000))) for k in range(n)]


def found_pages(data):
    out = [x for x in warc.salvage(data)]
    return [int(x.headers["warc-record-id"].split(":")[-1][:-1]) for x in out if x.headers], [(x.begin, x.end) for x in out if not x.headers]


def test_plain_and_packed_archives():
    records = archive()
    for data in (b"".join(records), b"".join(map(warc.member, records)), gzip.compress(b"".join(records)), warc.NOTHING.join(map(warc.member, records))):
        assert found_pages(data) == (list(range(30)), [])


def test_salvage_recovers_what_is_whole():
    members = list(map(warc.member, archive()))
    begins = [sum(map(len, members[:k])) for k in range(31)]
    data = bytearray(b"".join(members))
    data[begins[4] + 40] ^= 0xFF  # inside record 4
    data[begins[9]] = 0  # the first byte of record 9
    cut = bytes(data[: begins[29] + 20])  # the last one is cut off
    pages, gaps = found_pages(cut)
    assert pages == [k for k in range(29) if k not in (4, 9)]
    assert gaps == [(begins[4], begins[5]), (begins[9], begins[10]), (begins[29], len(cut))]
    records = archive()
    plain = b"junk" + b"".join(records[:3]) + records[3][:-30] + b"".join(records[4:6])
    pages, gaps = found_pages(plain)
    assert pages == [0, 1, 2, 4, 5] and gaps[0] == (0, 4) and len(gaps) == 2
    bad = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert found_pages(records[0] + bad + records[2])[0] == [0, 2]
    assert found_pages(b"") == ([], []) and found_pages(b"\x1f\x8b\x08") == ([], [(0, 3)])


def test_rows(spark):
    same = "<p>équal</p>" * 50
    rows = [(5, "http://a/\r\nX: y", same, "x"), (3, None, same, "x"), (9, "u", same, "x"), (7, "u", None, "x"), (8, "u", "", "x"), (1, "u", "own", "x"), (None, "u", same, "x"), (2, "u", "b" * 500_000, "x"), (1, "u", "own", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    got = sorted(((r.id is None, r.id or 0), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(pages).collect())
    want = []
    for k, _, html, _ in rows:
        payload = (html or "").encode()
        first = min(i for i, _, h, _ in rows if i is not None and (h or "") == (html or ""))
        want.append(((k is None, k or 0), "response" if k == first else "revisit", None if k == first else first, len(payload), warc.base32_sha1(payload)))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = {r.id: r.record_type for r in warc.round_trip(pages.where("page_id IS NOT NULL"), least_bytes=1).collect()}
    assert small[7] == small[8] == "response" and small[9] == "revisit"


def test_payloads_and_gaps_from_files(spark, tmp_path):
    members = list(map(warc.member, archive(5)))
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"junk" + members[1])
    rows = warc.read(spark, f"file://{tmp_path}").orderBy("begin").collect()
    assert [r.gap is None for r in rows] == [True, False, True]
    assert (rows[1].begin, rows[1].end) == (len(members[0]), len(members[0]) + 4)
    assert warc.base32_sha1(rows[0].payload) == rows[0].payload_digest


def test_salvage_inside_a_member():
    records = archive()
    begins = [sum(map(len, records[:k])) for k in range(31)]
    bad = bytearray(b"".join(records))
    bad[begins[8] - 10] ^= 0xFF  # inside record 7
    data = gzip.compress(bytes(bad)) + warc.member(records[3])
    out = list(warc.salvage(data))
    assert found_pages(data)[0] == [*range(7), *range(8, 30), 3]
    assert [x.reason.split("; ")[1] for x in out if not x.headers] == [f"bytes {begins[7]} to {begins[8]} of the member"]
    whole = gzip.compress(b"".join(records))
    pages, gaps = found_pages(whole[: len(whole) * 2 // 3])  # cut off
    assert pages and pages == list(range(len(pages))) and len(pages) >= 15 and len(gaps) == 1 and 0 < gaps[0][0] < gaps[0][1] == len(whole) * 2 // 3
    broken = bytearray(whole)
    broken[-6] ^= 0xFF  # the CRC
    assert found_pages(bytes(broken) + warc.member(records[2]))[0] == [*range(30), 2]


def test_damage_in_the_middle_of_one_member():
    records = archive(3)
    bad = bytearray(b"".join(records))
    bad[len(records[0]) + len(records[1]) - 20] ^= 0xFF
    assert found_pages(gzip.compress(bytes(bad)))[0] == [0, 2]
    whole = gzip.compress(b"".join(archive(50)))
    pages, gaps = found_pages(whole[:-40])
    assert len(pages) >= 45 and pages == list(range(len(pages))) and gaps


def test_ids_come_back_whatever_signs_they_have(spark):
    ids = ["a b", "x>y<z", "100%", "%41", "p+q", "é/ü", "line\nbreak", "", None, "plain"]
    rows = [(x, "u", f"page {k // 2}") for k, x in enumerate(ids)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(x or None) for x in ids)
    assert {r.id: r.refers_to for r in got if r.refers_to} == {"x>y<z": "a b", "100%": "%41", "é/ü": "p+q", None: "plain"}


def test_a_gap_in_what_was_written_is_an_error(spark, monkeypatch):
    written = warc.write

    def damaged(pages, path, *args):
        written(pages, path, *args)
        from pathlib import Path
        for f in Path(path.removeprefix("file://")).glob("*.txt"):
            f.write_bytes(f.read_bytes()[:-60])
        for f in Path(path.removeprefix("file://")).glob(".*.crc"):
            f.unlink()

    monkeypatch.setattr(warc, "write", damaged)
    pages = spark.createDataFrame([(1, "u", "x" * 500)], "page_id long, url string, html string")
    with pytest.raises(PySparkException, match="lost in an archive"):
        warc.round_trip(pages).collect()


def stored(records):
    """A gzip member of stored blocks, its checksum wrong."""
    data = bytearray(warc.member(b"".join(records), 0))
    data[-8] ^= 1
    return bytes(data)


@pytest.mark.parametrize("level", [0, 1, 6])
@pytest.mark.parametrize("size", [10, 3_000, 200_000])
def test_damaged_members_give_each_record_once(level, size):
    """A wrong checksum, a cut end, a flipped byte: what is whole comes once, in its place, whatever the blocks are."""
    rng = random.Random(size)
    records = [warc.record(str(k), f"http://x/{k}", bytes(rng.randrange(97, 123) for _ in range(size))) for k in range(3)]
    after = warc.member(warc.record("after", "http://y", b"after"))
    ids = lambda found: [x.headers["warc-record-id"] for x in found if x.headers]
    whole = [f"<{warc.ID}{k}>" for k in (0, 1, 2)]
    packed = warc.member(b"".join(records), level)
    wrong = bytearray(packed)
    wrong[-8] ^= 1
    for data in (bytes(wrong), packed[:-3]):
        found = list(warc.salvage(data + after))
        assert ids(found) == [*whole, f"<{warc.ID}after>"]
        assert all(0 <= x.begin < x.end <= len(data) + len(after) for x in found)
        assert all(x.end <= len(data) for x in found if x.headers and x.headers["warc-record-id"] in whole)
        places = sorted({(x.begin, x.end) for x in found})
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
        assert sum(x.end - x.begin for x in found if not x.headers) <= 16
    flipped = bytearray(packed)
    flipped[len(packed) * 2 // 5] ^= 0xFF
    found = ids(warc.salvage(bytes(flipped) + after))
    assert len(found) == len(set(found)) and found[-1:] == [f"<{warc.ID}after>"] and set(found[:-1]) <= set(whole)


def test_a_record_inside_a_payload_is_no_record():
    inner = warc.record("inner", "http://in", b"inside")
    outer = warc.record("outer", "http://out", b"text " + inner + b" more")
    at = outer.index(b"more")
    broken = outer[:at] + b"MORE" + outer[at + 4 :]
    last = warc.record("last", "http://l", b"z")
    for data in (broken + last, warc.member(broken + last)):
        found = list(warc.salvage(data))
        assert [x.headers["warc-record-id"] for x in found if x.headers] == [f"<{warc.ID}last>"]
        assert len([x for x in found if not x.headers and "digest differs" in x.reason]) == 1
