"""The corpus pipeline: language ID, near-dedup, PII surrogates, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's ``docs``. What a stage wrote on its way, and
what the stage before it left, is deleted then.

For all stages: columns beyond those of ``documents`` are dropped; rows are independent of others with a null
id; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import langid, mixing, pieces, pii, simhash
from tilewright.llm.common import staged
from tilewright.sources.paths import discard, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, learned from the labelled ones; ``lang`` is the one that was found.

    Rejected ones go, and so do null, empty and letterless texts, and all if no row has both a text and a language. Long texts are
    scored whole, repeated rows alike; ties go to the first language by code point.
    """
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    return found.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies: words of five, 0.8 alike.

    Candidates by fingerprints of 512 bits over five-word shingles, verified on the shingles. Wordless and null texts are
    copies of each other. Rows with a null id stay; rows that repeat an id stay or go together.
    """
    return simhash.keep_one(docs, similar=True).select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced; ``n_chars`` follows the text. A null text stays null, with a null ``n_chars``."""
    found = pii.distinct_surrogates(docs, keep=COLUMNS)
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed 5 : 2 : 1, repeating, to 150 % of all words; repeats are rows.

    Null is a source of its own. Null and wordless texts take no words of the budget. Equal ids come in an order by their texts.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's SentencePiece ids, counted and hashed, and the text decoded from them; a null text is the empty one."""
    return pieces.round_trip(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII surrogates", pii_surrogates),
    ("mixing", mix_sources),
    ("SentencePiece", tokenize),
]

#: Kneser-Ney models, XXH64 fingerprints and byte-pair merges aren't SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with passing(spark) as made:
            docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
            kept = [made.pop()]  # the last path named is the result's
        discard(spark, left)
        left = kept
    return STAGES[-1][1](spark, docs, sf_dir)
