"""Language ID by interpolated Kneser-Ney character models, one per language.

Grams are counted within words (maximal runs of letters, lower-cased, between a begin
and an end sign), so that a word's log-probabilities don't depend on what is around it.
The models are stored as arrays sorted by gram hash, one column per language: the
interpolated log-probability of each gram and, for each context, the log of the weight
that backing off from it costs. A text's language is the one of least cross-entropy
per symbol. Rejection is calibrated on labelled texts that the models weren't fitted on: a text whose
cross-entropy lies farther out than all but a stated share of those is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import as_bytes, bound_batches, fresh, slices, sole_cache, staged

ORDER = 4
#: Texts of a language that its model is fitted on, about: the sample's bound.
TRAIN_TEXTS = 4000
#: One labelled text in so many is held out to calibrate rejection, of languages with ``LEAST_HELD`` texts or more.
HOLD_OUT, LEAST_HELD = 5, 25
#: Share of held-out texts that may be rejected. With too few to tell, it is what lies so many times as far out as all of them.
REJECT_RATE, BEYOND_ALL = 0.001, 4.0
#: Symbols of evidence that a score goes by at most.
SCORE_SYMBOLS = 50
#: Bounds of what is gathered to fit, and sent around: languages, and grams of all of them.
MOST_LANGS, MOST_GRAMS = 400, 20_000_000
BEGIN, END = "\x02", "\x03"
KEPT = 200_000
UND = "und"

_runs = re.compile(r"[^\W\d_]+").findall
MULT = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters. Signs such as ½, ² and Ⅷ are no letters, and cut a run."""
    out = _runs(text)
    if all(map(str.isalpha, out)):
        return out
    return "".join([c if c.isalpha() else " " for c in text]).split()


def _letters(text: str) -> list[str]:
    return words_of(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with their signs, one after the other, and each word's first place."""
    joined = "".join([f"{BEGIN}{w}{END}" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.append(0, np.cumsum(sizes)[:-1])


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes that end at each place; places with fewer before them give junk."""
    h = np.full(len(codes), size, np.uint64)
    for back in range(size - 1, -1, -1):
        h = (h ^ np.concatenate([np.zeros(min(back, len(codes)), np.uint64), codes[: len(codes) - back]])) * MULT
        h ^= h >> np.uint64(29)
    return h


def text_hash(gram: str) -> int:
    codes = np.array([ord(c) for c in gram], np.uint64)
    return int(gram_hashes(codes, len(gram))[-1])


@dataclass
class Models:
    """All languages' models; ``grams[k]`` and ``contexts[k]`` are for grams of k + 1 signs."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    limits: np.ndarray | None = None  # by language: mean, deviation between texts, deviation of a symbol
    reject_at: float = np.inf  # deviations out at which a text is rejected

    def distance(self, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many deviations a text of ``n`` symbols has more than its language's mean cross-entropy."""
        mean, between, symbol = self.limits[lang].T
        return (entropy - mean) / np.maximum(between + symbol / np.sqrt(np.maximum(n, 1)), 1e-9)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: log-probability by language, then the number of symbols."""
        out = np.zeros((len(words), len(self.langs) + 1))
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            codes, begins = _codes(part)
            depth = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
            score = self._symbols(codes, depth)
            score[depth == 0] = 0
            out[k : k + len(part), :-1] = np.add.reduceat(score, begins, axis=0)
            out[k : k + len(part), -1] = np.diff(np.append(begins, len(codes))) - 1
        return out

    def _symbols(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        score = np.zeros((len(codes), len(self.langs)))
        todo = np.flatnonzero(depth > 0)
        for size in range(len(self.grams), 0, -1):
            at = todo[depth[todo] >= size - 1]
            if not len(at):
                continue
            keys, logp = self.grams[size - 1]
            found, place = _find(keys, gram_hashes(codes, size)[at])
            score[at[found]] += logp[place]
            missed = at[~found]
            if size > 1:
                keys, weight = self.contexts[size - 1]
                known, place = _find(keys, gram_hashes(codes, size - 1)[missed - 1])
                score[missed[known]] += weight[place]
            else:
                score[missed] += self.floor
            todo = np.setdiff1d(todo, at[found], assume_unique=True)
        return score


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted ``keys``, and where those are."""
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[place] == wanted
    return found, place[found]


def count_grams(words: Counter, order: int = ORDER) -> Counter:
    """Grams of ``order`` signs, and shorter ones where a word begins, with their counts."""
    out: Counter = Counter()
    for word, n in words.items():
        signs = f"{BEGIN}{word}{END}"
        for end in range(2, len(signs) + 1):
            out[signs[max(0, end - order) : end]] += n
    return out


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney models from each language's counts of :func:`count_grams`.

    The longest grams, and those at a word's begin, have their own counts; the others
    the number of distinct signs found before them. One discount an order,
    n1 / (n1 + 2 n2).
    """
    langs = sorted(counts)
    tables: list[list[dict[str, int]]] = []
    for lang in langs:
        levels: list[dict[str, int]] = [{} for _ in range(order)]
        for gram, n in counts[lang].items():
            levels[len(gram) - 1][gram] = n
        for size in range(order, 1, -1):
            seen: Counter = Counter(g[1:] for g in levels[size - 1])
            for gram, n in seen.items():
                levels[size - 2][gram] = levels[size - 2].get(gram, 0) + n
        tables.append(levels)
    signs = {g for levels in tables for g in levels[0]}
    floor = -np.log(len(signs) + 1.0)
    models = Models(langs, [], [], float(floor))
    below: dict[str, np.ndarray] = {}
    for size in range(1, order + 1):
        grams = sorted({g for levels in tables for g in levels[size - 1]})
        contexts = sorted({g[:-1] for g in grams})
        where = {c: k for k, c in enumerate(contexts)}
        place = np.fromiter((where[g[:-1]] for g in grams), np.int64, len(grams))
        if size == 1:
            base = np.full((len(grams), len(langs)), np.exp(floor))
        else:
            base = np.array([below[g[1:]] for g in grams]).reshape(len(grams), len(langs))
        prob, weight = np.empty((len(grams), len(langs))), np.empty((len(contexts), len(langs)))
        for lang, levels in enumerate(tables):
            n = np.fromiter((levels[size - 1].get(g, 0) for g in grams), np.float64, len(grams))
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total = np.bincount(place, n, len(contexts))
            kinds = np.bincount(place, n > 0, len(contexts))
            known = total > 0
            weight[:, lang] = np.where(known, discount * kinds / np.where(known, total, 1), 1.0)
            own = np.where(known[place], np.maximum(n - discount, 0) / np.where(known, total, 1)[place], 0)
            prob[:, lang] = own + weight[place, lang] * base[:, lang]
        for names, values, to in ((grams, prob, models.grams), (contexts, weight, models.contexts)):
            keys = np.array([text_hash(g) if g else 0 for g in names], np.uint64) if size > 1 or to is models.grams else np.zeros(len(names), np.uint64)
            order_ = np.argsort(keys)
            to.append((keys[order_], np.log(values[order_])))
        below = {g: prob[k] for k, g in enumerate(grams)}
    # the weight at the root: an unseen sign gets the share that backing off leaves
    if models.contexts[0][1].size:
        models.floor = float(floor + models.contexts[0][1].mean())
    return models


def _fraction(lang: Column, counts: dict[str, int], most: int) -> Column:
    """Whether a row's hash is within its language's share."""
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))])
    return F.pmod(F.xxhash64(F.col("id"), F.lit("train")), F.lit(1 << 30)) < F.element_at(share, lang) * (1 << 30)


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                words.setdefault(lang, Counter()).update(_letters(text.as_py().decode(errors="replace")))
        for lang, own in words.items():
            grams = count_grams(own, order)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_TEXTS, order: int = ORDER) -> Models | None:
    """Models from the rows of ``labelled`` that have a text and a language; None if none has.

    Fitted on a sample chosen by hash of the id, about ``most`` whole texts a language
    (all, of languages with fewer): the bound of what is gathered. Every ``HOLD_OUT``-th of them isn't learned
    from; these tell from where on a text is rejected.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), as_bytes(text_col, "text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    enough = [k for k, n in counts.items() if n >= LEAST_HELD]
    held = F.col("lang").isin(enough) & (F.pmod(F.xxhash64("id", "text", F.lit("held out")), F.lit(HOLD_OUT)) == 0)
    sample = staged(rows.where(_fraction(F.col("lang"), counts, most)).select("lang", "text", held.alias("held")), "labelled")
    grams = bound_batches(sample.where("NOT held").select("lang", "text")).mapInArrow(_counted(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = staged(grams, "grams")
    if grams.count() > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} grams; take fewer texts")
    grams = grams.toArrow()
    by_lang: dict[str, dict[str, int]] = {}
    for lang, gram, n in zip(*(grams.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        by_lang.setdefault(lang, {})[gram] = n
    if not by_lang:
        return None
    models = fit(by_lang, order)
    sent = sample.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, "text"):
            sums, _ = scorer.sums([t.as_py().decode(errors="replace") for t in batch.column("text")])
            place = [scorer.models.langs.index(x) if x in scorer.models.langs else 0 for x in batch.column("lang").to_pylist()]
            n = sums[:, -1]
            h = -sums[np.arange(len(n)), place] / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("held"), pa.array(n), pa.array(h)], ["lang", "held", "n", "h"])

    measured = staged(bound_batches(sample).mapInArrow(measure, "lang string, held boolean, n double, h double").where("n > 0"), "measured")
    # by what is held out where a language has some, else by what it was learned from
    own = measured.join(F.broadcast(measured.groupBy("lang").agg(F.max("held").alias("any"))), "lang").where("held = any")
    mean = own.groupBy("lang").agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("m"))
    spread = own.join(F.broadcast(mean), "lang").groupBy("lang").agg(
        F.first("m").alias("m"), F.stddev_pop("h").alias("between"), F.sqrt(F.avg(F.col("n") * (F.col("h") - F.col("m")) ** 2)).alias("symbol"),
    )
    models.limits = np.zeros((len(models.langs), 3))
    for r in spread.collect():
        if r.lang in models.langs:
            models.limits[models.langs.index(r.lang)] = r.m, r.between, r.symbol
    # at most TRAIN_TEXTS a language: the bound of what comes here
    seen = own.toArrow()
    place = np.array([models.langs.index(x) if x in models.langs else -1 for x in seen.column("lang").to_pylist()], int)
    known = place >= 0
    far = models.distance(place[known], seen.column("h").to_numpy()[known], seen.column("n").to_numpy()[known])
    if len(far):
        enough_held = len(far) >= 1 / REJECT_RATE
        models.reject_at = float(np.quantile(far, 1 - REJECT_RATE, method="higher")) if enough_held else max(1.0, float(far.max())) * BEYOND_ALL
    return models


class Scorer:
    """Sums of log-probabilities of texts, words remembered."""

    def __init__(self, models: Models):
        self.models, self.places, self.rows, self.used = models, {}, np.zeros((1024, len(models.langs) + 1), np.float32), 0

    def sums(self, texts: list[str]) -> tuple[np.ndarray, list[bool]]:
        """For each text the sums by language and the number of symbols; whether it has a letter."""
        lists = [_letters(t) for t in texts]
        missing = list(set().union(*lists).difference(self.places)) if lists else []
        if self.used + len(missing) > KEPT and self.used:
            self.places.clear()
            self.used, missing = 0, list(set().union(*lists))
        if missing:
            if self.used + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((max(len(self.rows), len(missing)), self.rows.shape[1]), np.float32)])
            self.rows[self.used : self.used + len(missing)] = self.models.word_scores(missing)
            self.places.update(zip(missing, range(self.used, self.used + len(missing))))
            self.used += len(missing)
        out, get = np.zeros((len(texts), self.rows.shape[1])), self.places.__getitem__
        for k, words in enumerate(lists):
            if words:
                out[k] = self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out, [has_letter(t) for t in texts]

    def predict(self, texts: list[str | None], reject_at: float | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, for each text."""
        sums, letters = self.sums([t or "" for t in texts])
        n = np.maximum(sums[:, -1], 1)
        entropy = -sums[:, :-1] / n[:, None]
        best = entropy.argmin(axis=1) if len(texts) else np.zeros(0, int)
        least = entropy[np.arange(len(best)), best]
        gap = (entropy - least[:, None]) * np.minimum(n, SCORE_SYMBOLS)[:, None]
        score = 1 / np.exp(-gap).sum(axis=1)
        rejected = ~np.array(letters, bool)
        if self.models.limits is not None:
            rejected |= self.models.distance(best, least, n) > (self.models.reject_at if reject_at is None else reject_at) + 1e-9
        langs = [self.models.langs[b] if x else UND for b, x in zip(best, letters)]
        return langs, np.where(letters, score, 0.0), rejected


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, reject_at: float | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``, else the id) with ``lang_pred``, ``score``, ``rejected``.

    ``lang_pred`` is a learned language, or ``und`` if the text is null or has no letter
    or no model was learned; such rows have score 0 and are rejected. ``score`` is the language's
    share of the odds at the text's mean cross-entropies, over ``SCORE_SYMBOLS`` symbols or as many as it has: what
    a stretch of that length tells, so that a long text's score isn't always 1. A text is rejected ``reject_at`` deviations beyond its
    language's mean, where None takes what :func:`train` found. Ties go to the
    language first in code-point order. Texts are scored whole, repeated rows alike. Columns
    of the results' names are replaced. Empty in, empty out.
    """
    names = [c for c in keep or [id_col] if c not in ("lang_pred", "score", "rejected")]
    column = fresh(docs, "_text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, rejected boolean"
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in slices(batches, column):
            texts = [None if (x := t.as_py()) is None else x.decode(errors="replace") for t in batch.column(column)]
            if sent.value is None:
                found = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                scorer = scorer or _scorer(sent)
                found = scorer.predict(texts, reject_at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], [*names, "lang_pred", "score", "rejected"])

    return bound_batches(docs.select(*names, as_bytes(text_col, column))).mapInArrow(run, schema)


_scorers: dict[int, Scorer] = {}


def _scorer(sent) -> Scorer:
    """One scorer in a Python worker for each broadcast model."""
    sole_cache("langid", _scorers.clear)
    key = id(sent.value)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(sent.value)
    return _scorers[key]
