import random
from collections import Counter

import numpy as np
from tilewright.llm import langid


def plain_models(counts, order):
    """Interpolated Kneser-Ney by its definition, gram by gram."""
    signs = {g[-1] for grams in counts.values() for g in grams}

    def tables(grams):
        levels = [Counter() for _ in range(order)]
        for g, n in grams.items():
            levels[len(g) - 1][g] = n
        for size in range(order, 1, -1):
            for g in list(levels[size - 1]):
                levels[size - 2][g[1:]] += 1
        return levels

    out = {}
    for lang, grams in counts.items():
        levels = tables(grams)
        discount = []
        for level in levels:
            n1, n2 = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
            discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

        def prob(sign, context, levels=levels, discount=discount):
            if context is None:
                return 1 / (len(signs) + 1)
            level, d = levels[len(context)], discount[len(context)]
            below = prob(sign, context[1:] if context else None, levels, discount)
            own = {g: n for g, n in level.items() if g[:-1] == context}
            total = sum(own.values())
            if not total:
                return below
            return max(own.get(context + sign, 0) - d, 0) / total + d * len(own) / total * below

        out[lang] = prob
    return out


def test_models_are_kneser_ney():
    rng = random.Random(2)
    counts = {lang: dict(langid.count_grams(Counter({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))): rng.randrange(1, 4) for _ in range(25)}), 3)) for lang, letters in (("xx", "abcd"), ("yy", "cdeé"))}
    models = langid.fit(counts, 3)
    plain = plain_models(counts, 3)
    for word in ("abc", "dce", "é", "ba", "cdcdcd"):
        got = models.word_scores([word])[0]
        signs = langid.BEGIN + word + langid.END
        for k, lang in enumerate(models.langs):
            want = sum(np.log(plain[lang](signs[i], signs[max(0, i - 2) : i])) for i in range(1, len(signs)))
            assert abs(got[k] - want) < 1e-6, (word, lang)
        assert got[-1] == len(word) + 1


def make(rng, lang):
    words = {"en": "the of and thing water house under going", "de": "der und nicht straße über häuser wasser gehen", "fr": "le et été maison où être garçon rivière"}[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "s", ","]) for _ in range(rng.randrange(5, 60)))


def test_accuracy_rejection_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(k, make(rng, lang), lang, "s", "x") for k in range(300) for lang in [rng.choice(["en", "de", "fr"])]]
    odd = [(1000, None, "en", None, "x"), (1001, "", None, None, "x"), (1002, "12 34 !!", "de", None, "x"), (1003, "qzxkj vbqzx " * 200, None, None, "x"), (None, "the house", None, None, "x"), (1004, "le " * 60_000, None, None, "x"), (0, rows[0][1], None, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, lang_pred string")
    models = langid.train(docs)
    got = langid.identify(docs, models).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows}
    assert sum(by_id[k].lang_pred == v for k, v in truth.items()) >= 0.98 * len(truth)
    assert not any(by_id[k].rejected for k in truth)
    for k in (1000, 1001, 1002):
        assert (by_id[k].lang_pred, by_id[k].score, by_id[k].rejected) == ("und", 0.0, True)
    assert by_id[1003].rejected and by_id[1003].lang_pred != "und"
    assert by_id[1004].lang_pred == "fr" and not by_id[None].rejected
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0), models).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert {(r.lang_pred, r.rejected) for r in langid.identify(docs, None).collect()} == {("und", True)}


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(k, "the house of the water", "en") for k in range(30)] + [(100, "½ ² ①", None), (101, "Ⅷ ⅷ", None), (102, "ª", None), (103, "the½house", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all((got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True) for k in (100, 101))
    assert got[102].lang_pred == got[103].lang_pred == "en" and langid.words_of("the½house²x y") == ["the", "house", "x", "y"]


def test_rejection_keeps_to_its_rate(spark):
    """About REJECT_RATE of fresh texts go, and nearly all of another alphabet's and of noise."""
    rng = random.Random(11)
    rows = [(k, make(rng, lang), lang) for k in range(9000) for lang in [rng.choice(["en", "de", "fr"])]]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert np.isfinite(models.reject_at)
    scorer = langid.Scorer(models)
    fresh = [make(rng, rng.choice(["en", "de", "fr"])) for _ in range(20_000)]
    assert scorer.predict(fresh)[2].mean() <= 5 * langid.REJECT_RATE
    noise = ["".join(rng.choice("qxzjkvwpy ") for _ in range(200)) for _ in range(200)] + ["это вода и дом " * 5] * 10
    assert scorer.predict(noise)[2].mean() > 0.99
