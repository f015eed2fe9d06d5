from collections import Counter
from itertools import permutations

import pytest
from tilewright.llm import filter_audit
from tilewright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, id int, part string, A string"
WORDS = [f"w{k}" for k in range(250)]


def rows():
    good = " ".join(WORDS)
    texts = [None, "", "short", good, good, good + " #", good + " A" * 60, " ".join(WORDS[:60] * 5), "SHOUT" * 3, good.upper(), "a|b", "\t\n ", "same", "same", "éÀ" * 400]
    data = [(k, texts[k % len(texts)], ["en", "de", None, ""][k % 4], 0, "p", "a") for k in range(90)]
    data += [(None, "same", "en", 0, "", ""), (None, None, None, 0, "", ""), (3, good, "en", 0, "", ""), (3, good, "en", 0, "", "")]
    return data + [(500, "long word " * 100_000, "xx", 0, "", ""), (501, "y" * 300_000, "xx", 0, "", "")]


LABELS = [(k, [0, 1, None][k % 3], [1, 0, 0, None][k % 4]) for k in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (77_777, 1, 1)]


def plain(data, labels):
    """Every order run by itself, row by row."""
    said = {}
    for d, q, t in labels:
        if d is not None:
            old = said.get(d, (False, False))
            said[d] = (old[0] or q == 1, old[1] or t == 1)
    first = {}
    for d, t, *_ in data:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    verdicts = []
    for d, t, lang, *_ in data:
        t = t or ""
        w = t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        w = [x for x in w if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|"), "E": d is not None and t in first and first[t] < d}
        verdicts.append((lang or "", {f for f, x in fails.items() if x}, *said.get(d, (False, False))))
    parts, out, shapley = {v[0] for v in verdicts}, [], Counter()
    for order in map("".join, permutations("ABCDE")):
        alive = list(verdicts)
        for step, f in enumerate(order, 1):
            for p in parts:
                here = [v for v in alive if v[0] == p and f in v[1]]
                failing = [v for v in verdicts if v[0] == p and f in v[1]]
                shapley[p, f] += len(here)
                kept = sum(v[0] == p and f not in v[1] for v in alive)
                out.append([p, order, step, kept, len(here), len(failing) - len(here), sum(v[1] == {f} for v in failing), sum(v[2] for v in here), sum(v[3] for v in here)])
            alive = [v for v in alive if f not in v[1]]
    return sorted(x + [shapley[x[0], x[1][x[2] - 1]]] for x in out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_every_order(spark):
    data = rows()
    verdicts = filter_audit.text_filters(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert verdicts.count() == len(data)
    got = filter_audit.audit(verdicts, list("ABCDE")).collect()
    assert sorted([r[n] for n in NAMES] for r in got) == plain(data, LABELS)


def test_states_are_counted_once(spark, monkeypatch):
    seen = []
    real = filter_audit._walk
    monkeypatch.setattr(filter_audit, "_walk", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame([("p", k % 2 == 0, k % 3 == 0, None, False, True) for k in range(30)], "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = filter_audit.audit(df, ["X", "Y", "Z"]).collect()
    edges = seen[0].collect()
    # one for each state and filter that isn't in it
    assert len(edges) == len({(r.state, r.filter) for r in edges}) == 3 * 4
    assert len(got) == 6 * 3 and {r.removed for r in got if r["filter"] == "Z"} == {0}
    assert {(r.filter_order, r.removed, r.redundant, r.toxic_lost) for r in got if r.step == 2 and r["filter"] == "Y" and r.filter_order == "XYZ"} == {("XYZ", 5, 5, 5)}


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs, labels = spark.createDataFrame([(1, None, None, 0, "", "")][:n], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.text_filters(docs, labels), list("ABCDE")).collect()
    assert len(got) == 600 * n and {r.part for r in got} == {""} & ({""} if n else set())
    assert all(r.removed == (r["filter"] == "A") for r in got)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    got = QUERIES["op12_filter_audit"](spark, sf_dir).collect()
    assert sorted([r[n] for n in NAMES] for r in got) == plain(docs, labels)
