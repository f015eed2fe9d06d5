"""The registered queries over the smallest tables: against DuckDB where SQL says it, else plainly."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from test_simhash import plain_components, plain_fingerprint
from tilewright.llm import avi, pii
from tilewright.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {d: (t, lang) for d, t, lang in duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()}


def luhn(digits):
    each = [int(x) * (2 if k % 2 else 1) for k, x in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in each) % 10 == 0


def run(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(x)) for x in found.fetchall())


def test_op1(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op1_simhash_near_dedup")
    order = sorted(docs)
    fps = [plain_fingerprint(docs[d][0]) for d in order]
    assert [got[d].fingerprint for d in order] == [f"{x:016x}" for x in fps]
    assert [got[d].component_id for d in order] == [order[k] for k in plain_components(fps)]


def test_op2(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op2_language_id")
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == docs[d][1] for d in held) >= 0.97 * len(held)


def test_op3(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op3_pii_surrogates")
    personal = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{40}\b", re.I)
    for d, (text, _) in docs.items():
        # numbers of 16 digits are cards if their check digit is right
        found = [x for x in personal.findall(text) if not re.fullmatch(r"\d{16}", x) or luhn(x)]
        assert not any(x in got[d].text for x in found), d
        assert len(found) == got[d].n_entities and (found or got[d].text == text)


def test_op3_whole(spark, sf_dir, docs):
    """All entities of all documents: in place, of one format, one surrogate an entity and one entity a surrogate."""
    got = pii.distinct_surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id", "text"]).collect()
    by_entity, by_surrogate, n = {}, {}, 0
    for r in got:
        text, at, pieces = docs[r.doc_id][0], 0, []
        for e in r.entities:
            old = text[e.begin : e.end]
            pieces += [text[at : e.begin], e.surrogate]
            at, n = e.end, n + 1
            assert old != e.surrogate and [c.isdigit() for c in old] == [c.isdigit() for c in e.surrogate] or e.kind in ("email", "name", "ip", "secret"), (old, e)
            sign = re.sub(r"[ ().-]", "", e.surrogate) if e.kind in ("phone", "card") else e.surrogate if e.kind == "secret" else e.surrogate.lower()
            same = re.sub(r"[ ().-]", "", old) if e.kind in ("phone", "card") else old if e.kind == "secret" else old.lower()
            assert by_entity.setdefault((e.kind, same), sign) == sign and by_surrogate.setdefault((e.kind, sign), same) == same
        assert r.text == "".join([*pieces, text[at:]])
    assert n > 10 and len(got) == len(docs)


def test_op4(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op4_licence_scan")
    names = {"Apache": "Apache License", "CC": r"CC BY", "GPL": "GNU General Public", "MIT": "MIT License"}
    for d, (text, _) in docs.items():
        assert got[d].licences == ",".join(k for k, p in names.items() if re.search(p, text, re.I)), d


def test_op7(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op7_media_columns")
    for d, (text, _) in docs.items():
        payload, media = avi.payload_of(text.encode()), avi.write_avi(avi.payload_of(text.encode()))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_op9(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op9_sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, (text, _) in docs.items():
        ids = [*library.encode(text), 2]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
