"""What filters remove in every order: a trie of permutations, walked over persisted survivors.

Filters are applied depth-first along the trie of all their permutations. A node's survivors are a
DataFrame derived from its parent's by one more filter, and persisted while the walk is below it. What
survives hangs on the set of filters applied, not on their order, so a state is memoised under
its unordered set: n! paths share 2^n states, and each edge (state, next filter) is counted once, from
the survivors that are there: rows it removes, rows that it leaves. One job a state counts all its
edges, for every part of the table at once.

A state's counts are written when they are made; a lost executor costs the persisted blocks, which
come back from the written verdicts.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import small_side, staged
from tilewright.sources.paths import scratch

#: What :func:`audit` counts beside removals: removed rows with a mark.
MARKS = ("good", "toxic")


def audit(rows: DataFrame, filters: list[str], part: str = "part", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """Counts for every part, order of the filters and step.

    ``rows`` have a boolean column for each of ``filters``, true where the row fails it (null: passes), ``part`` and a boolean
    column for each of ``marks``. Returns ``(part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, <mark>_lost, shapley)``: ``filter_order`` joins the names, ``step`` counts from 1;
    ``kept`` after the step, ``removed`` by it, ``redundant`` failing its filter but removed before, ``unique_fails`` failing
    its filter only, ``shapley`` what the filter removes summed over all orders.

    Rows aren't told apart, so repeats count each. A null part is a part. A part has all its rows of
    the result, with zeros where nothing is removed; an empty table has none. The result has n! n rows a
    part, so n is small; the walk has 2^n states.
    """
    fails = [F.coalesce(F.col(f), F.lit(False)).alias(f"f{k}") for k, f in enumerate(filters)]
    kept_marks = [F.coalesce(F.col(m), F.lit(False)).alias(f"m{k}") for k, m in enumerate(marks)]
    base = staged(rows.select(F.col(part).alias("part"), *fails, *kept_marks), "verdicts")
    edges = _walk(base, len(filters), len(marks))
    return _orders(edges, filters, part, marks)


def _walk(base: DataFrame, n: int, n_marks: int) -> DataFrame:
    """``(part, state, filter, kept, removed, lost..., failing, unique)`` of every edge; ``state`` has bit k if filter k was applied."""
    path, visited = scratch(base.sparkSession, "audit_edges"), set()

    def count(k: int, state: int) -> Column:
        """Of the survivors of ``state``, what filter ``k`` does; that a row fails it alone is asked once, of the whole table."""
        hit, others = F.col(f"f{k}"), [F.col(f"f{x}") for x in range(n) if x != k]
        alone = reduce(lambda c, x: c & ~x, others, hit) if state == 0 else F.lit(False)
        lost = [F.count_if(hit & F.col(f"m{m}")).alias(f"lost{m}") for m in range(n_marks)]
        return F.struct(F.lit(k).alias("filter"), F.count_if(~hit).alias("kept"), F.count_if(hit).alias("removed"), F.count_if(alone).alias("unique"), *lost)

    def visit(survivors: DataFrame, state: int) -> None:
        visited.add(state)
        left = [k for k in range(n) if not state >> k & 1]
        # nothing is walked to from a state with one filter left
        held = survivors.persist() if len(left) > 1 else survivors
        edges = held.groupBy("part").agg(F.array(*(count(k, state) for k in left)).alias("e"))
        edges.select("part", F.lit(state).alias("state"), F.explode("e").alias("e")).select("part", "state", "e.*").write.mode("append").parquet(path)
        for k in left if len(left) > 1 else []:
            if state | 1 << k not in visited:
                visit(held.where(~F.col(f"f{k}")), state | 1 << k)
        held.unpersist()

    visit(base, 0)
    return base.sparkSession.read.parquet(path)


def _orders(edges: DataFrame, filters: list[str], part: str, marks: tuple[str, ...]) -> DataFrame:
    spark, n = edges.sparkSession, len(filters)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[x] for x in order), step + 1, k, state))
            state |= 1 << k
    steps = spark.createDataFrame(steps, "filter_order string, step int, k int, s int")
    # a state in which a part has no row left wrote no count for it
    each_part = edges.where("state = 0").select("part", F.col("filter").alias("k"), F.col("removed").alias("failing"), "unique")
    # orders that have a state before a filter: those of the set, times those of what is left
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n))), (F.bit_count("state") + 1).cast("int"))
    shapley = edges.groupBy("part", F.col("filter").alias("k")).agg(F.sum(F.col("removed") * weight).alias("shapley"))
    same = lambda a, b: a["part"].eqNullSafe(b["part"]) & (a["k"] == b["k"])
    each, total = small_side(staged(each_part, "audit_parts")), small_side(staged(shapley, "audit_shapley"))
    parts = each.join(total, same(each, total)).select(each["part"], each["k"], "failing", "unique", "shapley")
    wanted = parts.join(F.broadcast(steps), "k")
    found = edges.select(F.col("part").alias("p"), "state", "filter", "removed", "kept", *(f"lost{m}" for m in range(len(marks))))
    found = small_side(staged(found, "audit_found"))
    on = wanted["part"].eqNullSafe(found["p"]) & (wanted["s"] == found["state"]) & (wanted["k"] == found["filter"])
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    name = F.element_at(F.array(*map(F.lit, filters)), F.col("k") + 1)
    return wanted.join(found, on, "left").select(
        F.col("part").alias(part), "filter_order", "step", name.alias("filter"), whole("kept").alias("kept"), whole("removed").alias("removed"),
        (F.col("failing") - whole("removed")).alias("redundant"), F.col("unique").alias("unique_fails"), *(whole(f"lost{m}").alias(f"{mark}_lost") for m, mark in enumerate(marks)), "shapley",
    )


WORD = r"[^\x20\x09-\x0D]+"


def text_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, A, B, C, D, E, good, toxic)``: the verdicts of five filters on every document, true where it fails.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: any of ``#$%&*|``; E: the
    text of a row with a smaller id. Null texts are empty ones; null ids are neither smaller nor larger than any, so fail
    nothing under E; a row isn't its own earlier copy, nor one of the same id. A null part is the empty string. ``labels``
    are ``(doc_id, quality, toxic)``; of repeated labels one that says 1 is enough.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    seen = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"), F.char_length(text).alias("n_chars"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("n_capitals"), text.rlike("[#$%&*|]").alias("D"),
    )
    ruled = staged(
        seen.select("id", "part", "digest", (F.col("n_words") < 200).alias("A"), (100 * F.col("n_distinct").cast("long") < 50 * F.col("n_words").cast("long")).alias("B"), (100 * F.col("n_capitals").cast("long") > 3 * F.col("n_chars").cast("long")).alias("C"), "D"),
        "filter_rules",
    )
    copies = ruled.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("copied"), "first")
    copies = small_side(staged(copies, "filter_copies"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = small_side(staged(said, "filter_labels"))
    joined = ruled.join(copies, ruled["digest"] == copies["copied"], "left").join(said, ruled["id"] == said["labelled"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return joined.select("id", "part", "A", "B", "C", "D", no(F.col("id") > F.col("first")).alias("E"), no(F.col("good")).alias("good"), no(F.col("toxic")).alias("toxic"))
