import hashlib
import os
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from tilewright.llm import mixing, simhash

import corpus_pipeline


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        after[name] = docs.collect()
        docs = spark.createDataFrame(after[name], docs.schema)
        if name != "SentencePiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    # language ID keeps whatever has letters here
    assert {r.doc_id for r in after["language ID"]} == {k for k, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    # of each set of near copies one is left, and only copies go
    left = {r.doc_id: r.text for r in after["SimHash near-dedup"]}
    before = {r.doc_id: r.text.lower() for r in after["language ID"]}
    for k in before:
        if k not in left:
            assert any(jaccard(before[k], before[j]) >= 0.5 for j in before if j < k), k
    kept = sorted(left)
    for i, k in enumerate(kept):
        for j in kept[:i]:
            assert before[k] != before[j]
    # no planted address, number or token is left; other texts are as they were
    personal = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b[0-9a-f]{40}\b", re.I)
    for r in after["PII surrogates"]:
        gone = set(personal.findall(left[r.doc_id])) & set(personal.findall(r.text))
        assert not gone and r.n_chars == len(r.text)
        if not personal.search(left[r.doc_id]) and not re.search(r"\d+\.\d+\.\d+\.\d+|\b\d{16}\b", left[r.doc_id]):
            assert r.text == left[r.doc_id]
    # the mix takes whole documents as often as the operator says, but for one a source
    inputs = spark.createDataFrame(after["PII surrogates"], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.id: r.taken / r.size if r.size else 0 for r in mixing.mixed(inputs).collect()}
    times = Counter(r.doc_id for r in after["mixing"])
    assert sum(times[k] != v for k, v in want.items()) <= len({r.source for r in after["mixing"]})
    # ids and texts are the library's
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in after["mixing"]}
    for r in after["SentencePiece"]:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert Counter(r.doc_id for r in after["SentencePiece"]) == times


ODD = "doc_id long, text string, lang string, source string, n_chars long, node long, lang_pred string"


def odd_rows():
    words = [f"word{k}" for k in range(60)]
    prose = "the house of the water and the dog " * 4
    return [
        (1, prose, "en", "a", 1, 1, "x"), (1, prose, "en", "a", 1, 1, "x"), (2, None, "en", None, None, 1, "x"), (3, "", None, "a", 0, 1, "x"), (4, "12 !!", "de", "a", 1, 1, "x"), (None, prose + "mail a.b@c.org", "en", None, 1, 1, "x"),
        (5, " ".join(words), "en", "b", 1, 1, "x"), (6, " ".join(words[:-3]), None, "b", 1, 1, "x"), (7, " ".join(words[::-1]), None, None, 1, 1, "x"), (8, "the water " * 40_000, "en", "b", 1, 1, "x"), (9, "write to me.you@host.net", "en", "b", 1, 1, "x"),
    ]


def test_odd_rows_pass_every_stage(spark, sf_dir):
    """Nulls, empties, long texts, repeats, ties and clashing names, each stage on its own."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = {name: stage(spark, docs, sf_dir).collect() for name, stage in corpus_pipeline.STAGES}
    ids = lambda name: Counter(r.doc_id for r in out[name])
    assert ids("language ID") == Counter([1, 1, None, 5, 6, 7, 8, 9]) and all(r.lang == "en" for r in out["language ID"])
    # 2, 3 are wordless; 6 is 5 without three words; null ids stay
    assert ids("SimHash near-dedup") == Counter([1, 1, 2, 4, None, 5, 7, 8, 9])
    pii_ = {(r.doc_id, r.text, r.n_chars) for r in out["PII surrogates"]}
    assert (2, None, None) in pii_ and (3, "", 0) in pii_ and not any("host.net" in (t or "") or "c.org" in (t or "") for _, t, _ in pii_)
    assert len(out["PII surrogates"]) == len(odd_rows()) == len(out["SentencePiece"])
    assert {r.n_tokens for r in out["SentencePiece"] if r.doc_id in (2, 3)} == {1}
    assert set(ids("mixing")) <= {r[0] for r in odd_rows()}


def test_empty_tables_pass_every_stage(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), sf_dir).count() == 0, name


def test_run_is_the_stages_and_leaves_one_table(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).select(*corpus_pipeline.COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    left = set(os.listdir(root)) - before
    assert [x.split("-")[0] for x in left] == ["stage3"]
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_near_copies_are_found_and_others_left(spark):
    """Recall of the near-copy stage against all pairs, at similarities about the threshold."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 150, 400]))]
        texts.append(base)
        for _ in range(3):
            changed = list(base)
            for _ in range(max(1, int(len(base) * rng.choice([0.005, 0.02, 0.03, 0.06])))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(changed)
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.id: r.component_id for r in simhash.similar_texts(docs).collect()}
    pairs = [(i, j, jaccard(" ".join(texts[i]), " ".join(texts[j]))) for b in range(0, len(texts), 4) for i in range(b, b + 4) for j in range(i)  if j >= b]
    alike = [(i, j) for i, j, s in pairs if s >= 0.8]
    assert len(alike) > 100 and sum(found[i] == found[j] for i, j in alike) >= 0.99 * len(alike)
    # components by all pairs within a family; nothing beyond them
    parent = list(range(len(texts)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in alike:
        parent[root(i)] = root(j)
    assert not any(found[i] == found[j] and root(i) != root(j) for i, j, _ in pairs)
    assert all(found[i] // 4 == i // 4 for i in found)
