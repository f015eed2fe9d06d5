import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tilewright.llm import fim
from tilewright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n int, key string, output string, form string"


def plain(doc_id, text):
    """All units in a list, cut by slices."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "<", "<P", "x <P> y", "<M>", "<S", "S><", "éß x1y2", "\U0001f600\U0001f600a\U0001f600", "\n\r\t\0", "ab" * 3 + "<" * 4 + ">" * 4, "áb", " <P", "P><S"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM>\n é\U0001f600", max_size=40), st.integers(-5, 10**12))
def test_transform_against_slices(text, doc_id):
    assert fim.transform(text, str(doc_id)) == plain(doc_id, text)


def test_over_rows_and_back(spark):
    rng = random.Random(7)
    data = [(k, TEXTS[k % len(TEXTS)], k, "k", "o", "f") for k in range(600)]
    data += [(None, "null id", 0, None, None, None), (5, "again", 0, "x", "x", "x"), (5, "again", 0, "x", "x", "x")]
    data += [(2000, "".join(rng.choice("ab <>PSMé") for _ in range(300_000)).replace("<P>", "").replace("<S>", "").replace("<M>", ""), 0, "", "", "")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = fim.fill_in_middle(docs)
    rows = got.withColumn("back", fim.restored(got["output"], got["form"])).collect()
    assert sorted(repr((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in rows) == sorted(repr((d, *plain(d, t))) for d, t, *_ in data)
    assert sorted(repr((r.id, r.back)) for r in rows) == sorted(repr((d, t or "")) for d, t, *_ in data)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a" * 10_000_000, "é" * 3_000_000, "a " * 2_000_000])
def test_long_texts_take_seconds(text):
    began = time.time()
    n, form, prefix, middle, output = fim.transform(text, "3")
    assert time.time() - began < 20
    assert form == "plain" or len(output) == len(text) + 9 and output.startswith("<")


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_fill_in_middle"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        n, form, prefix, middle, output = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(docs[r.doc_id]))
