"""Fill-in-middle transformation by a two-pass matcher of constant memory.

A text is a row of units, runs of ASCII letters or any other single code point. The first pass
over a text only counts its units; two ranks are drawn from the document's id, and the second pass
advances a lazy iterator over the same matches to the lower rank and then to the higher one, which
gives the two cuts in code points. Beside the text and the output, a document costs a match object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import bound_batches, slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
#: Of 100 documents so many are transformed; of 100 of those so many suffix first.
RATE, SPM_RATE = 90, 20


def draws(doc_id: str, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, from ``seed:doc_id``."""
    digest = sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def cuts(text: str, low: int, high: int) -> tuple[int, int]:
    """Code points before the units of rank ``low`` and ``high``, ``low`` at most ``high``."""
    matches = UNIT.finditer(text)

    def advance(units: int, at: int) -> int:
        last = None
        for last in islice(matches, units):
            pass
        return last.end() if last else at

    first = advance(low, 0)
    return first, advance(high - low, first)


def transform(text: str, doc_id: str, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text; see :func:`fill_in_middle`."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or MARK.search(text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = 1) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row.

    The prefix ends after the lower of two drawn ranks of ``0 .. n`` units, the middle after the higher.
    Form ``psm`` puts prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle; ``plain``
    leaves the text: an empty one, one that holds a mark, or one beyond ``rate``. Null texts
    are empty ones, and a null id draws as the empty string. Equal ranks give an empty middle. Rows are
    independent, so repeated rows come out alike; other columns don't matter. Very long texts are cut
    whole. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [transform(t.as_py() or "", d.as_py() or "", rate, spm_rate, seed) for d, t in zip(batch.column("key"), batch.column("text"))]
            n, form, prefix, middle, output = map(list, zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return bound_batches(rows).mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its parts stand between marks, which no transformed text holds."""
    part = lambda *order: F.concat(*(F.get(F.split(output, MARK.pattern, -1), F.lit(k)) for k in order))
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)
