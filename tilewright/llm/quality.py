"""Quality rules with host verdicts.

Rules judge each document. Their failures are counted by host, each rule's on its own; a host's
failure rate is shrunk towards those of all hosts with a beta prior fitted to that rule (beta-binomial moments:
what hosts differ beyond chance), so that a host of few documents isn't judged by chance. Documents of
a host that has a rule's shrunk rate over its limit go with it; the limit is where the fitted prior ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import as_bytes, bound_batches, slices, small_side, staged

BLANK = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: A host goes if its shrunk failure rate of a rule stands out from the prior: over the mean by so many deviations,
#: twice the mean and so much more than the mean ...
DEVIATIONS, TIMES, MORE = 3.0, 2.0, 0.05
#: ... or is over this, whatever other hosts do.
HOST_LIMITS = {"lines": 0.3, "repeats": 0.5, "short": 0.5, "symbols": 0.3}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of a text's UTF-8; null has none of anything."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, BLANK)
    chars = len(solid.decode(errors="replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    places = [k for k, w in enumerate(windows) if w in often]
    return 3 + sum(min(3, b - a) for a, b in pairwise(places))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [counts(t.as_py()) for t in batch.column("text")]
        columns = [pa.array(c, pa.int64()) for c in zip(*found)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *columns], ["id", "host", *COUNTS])


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(id, host, COUNTS, base_failed)`` for every row.

    Failed: under 50 words, or over half of them in repeated windows.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col)]
    schema = f"id {kinds[0]}, host {kinds[1]}, " + ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), as_bytes(text_col, "text"))
    return bound_batches(rows).mapInArrow(_counted, schema).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def failures() -> dict[str, Column]:
    """The rules over ``COUNTS``: a repeated line for 20 words, half the words in repeated windows, under 50 words, a symbol for 10 words."""
    n = F.col("n_words")
    return {"lines": 20 * F.col("n_dup_lines") > n, "repeats": 100 * F.col("n_repeat_words") > 50 * n, "short": n < 50, "symbols": 10 * F.col("n_symbols") > n}


#: The least share of variance that is taken to be the hosts' own: with less, rates are pooled all but wholly.
LEAST_SHARE = 1e-6


def prior(n_docs: float, squares: float, hosts: int, failed: float, weighed: float) -> tuple[float, float]:
    """Mean and intra-host correlation 1 / (a + b + 1) of a beta prior, by moments of a beta-binomial.

    From sums over the hosts: documents n, n^2, hosts, failures f, f^2 / n. The sampling noise of the rates, m (1 - m) / n each, is taken off
    what they differ, each host weighing its documents.
    """
    m = failed / n_docs if n_docs else 0.0
    own = n_docs - squares / n_docs - (hosts - 1) if n_docs else 0.0
    chance = m * (1 - m)
    share = (weighed - n_docs * m * m - chance * (hosts - 1)) / (chance * own) if chance > 1e-12 and own > 1e-9 else 0.0
    return m, min(1.0 - LEAST_SHARE, max(LEAST_SHARE, share))


def host_rates(rows: DataFrame, host_limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """``(host, n_docs, rates)`` from rows of :func:`base_rules`; ``rates`` has each rule's ``rule, n_failed, shrunk_rate, limit``."""
    failed = [F.count_if(c).alias(f"n_{rule}") for rule, c in failures().items()]
    own = staged(rows.groupBy("host").agg(F.count("*").alias("n_docs"), *failed), "hosts")
    # sums for each rule, over all hosts
    n = F.col("n_docs").cast("double")
    sums = [F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("hosts")]
    seen = own.agg(*sums, *(f for r in host_limits for f in (F.sum(f"n_{r}").alias(f"f_{r}"), F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / n).alias(f"w_{r}")))).first()

    def judged(rule: str) -> Column:
        m, share = prior(seen["n"] or 0.0, seen["nn"] or 0.0, seen["hosts"], seen[f"f_{rule}"] or 0, seen[f"w_{rule}"] or 0.0)
        strength = 1 / share - 1
        limit = min(host_limits[rule], max(m + DEVIATIONS * (m * (1 - m) * share) ** 0.5, TIMES * m, m + MORE))
        rate = (F.col(f"n_{rule}") + m * strength) / (F.col("n_docs") + strength)
        return F.struct(F.lit(rule).alias("rule"), F.col(f"n_{rule}").alias("n_failed"), rate.alias("shrunk_rate"), F.lit(limit).alias("limit"))

    return own.select("host", "n_docs", F.array(*map(judged, host_limits)).alias("rates"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """``(id, COUNTS, base_failed, host_rule, host_rate, kept)`` for every row.

    Kept: passed the base rules, of a host whose shrunk failure rates are at most their limits: those of the fitted prior, ``host_limits`` at most.
    ``host_rule`` is the rule that the host's rate is nearest to, or farthest over, the limit of; ``host_rate`` that
    rate; ties go to the first in order of the names. Null texts have no words and fail; null hosts are one host. Repeated rows
    count each. Other columns don't matter. Empty in, empty out.
    """
    rows = staged(base_rules(docs, id_col, text_col, host_col), "base_rules")
    # to nine places: rates are sums, and ties are to be ties
    over = F.transform("rates", lambda x: F.struct((-F.round(x["shrunk_rate"] / x["limit"], 9)).alias("near"), x["rule"].alias("rule"), x["shrunk_rate"].alias("rate")))
    rates = staged(host_rates(rows, host_limits).select(F.col("host").alias("_host"), F.array_min(over).alias("_x")), "host_rates")
    joined = rows.join(small_side(rates), F.col("host").eqNullSafe(F.col("_host")))
    return joined.select("id", *COUNTS, "base_failed", F.col("_x.rule").alias("host_rule"), F.col("_x.rate").alias("host_rate"), (~F.col("base_failed") & (F.col("_x.near") >= -1)).alias("kept"))
