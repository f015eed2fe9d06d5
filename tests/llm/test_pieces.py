import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tilewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(8)
    signs = " ▁  aAbethninorQ\n\t\r\v0123.,éß日本語한🙂\u0000​�'\"()" + "ñ"
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 200))) for _ in range(1500)]
    out += [" " * n for n in range(40)] + ["▁", "", "a" * 5000, "ab" * 3000, "\n" * 50, "The quick brown fox", "123456", "здравствуй мир", "def f(x):\n    return x\n\n\n\tif"]
    return out + [" ".join(rng.choice(["the", "internationalisation", "été", "Straße", "2024"]) for _ in range(20_000))]


def test_as_the_library_does(library):
    model = pieces.Model(pieces.model_bytes(PATH))
    for text in odd_texts():
        ids = model.encode(text)
        assert ids == library.encode(text), text[:80]
        assert model.decode([*ids, model.end]) == library.decode([*ids, model.end]), text[:80]


def test_whole_table_of_pair_answers_is_not_needed(library):
    model = pieces.Model(pieces.model_bytes(PATH))
    model.by_word = False  # the automaton over whole texts gives the same
    for text in odd_texts()[:200]:
        assert model.encode(text) == library.encode(text)


def test_rows(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "é" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.id: r for r in pieces.round_trip(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, text, _ in rows:
        ids = [*library.encode(text or ""), 2]
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[k].decoded_sha256 == sha(library.decode(ids))
    assert pieces.round_trip(docs).count() == 5
    back = {r.id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    assert pieces.round_trip(docs.limit(0)).count() == 0
