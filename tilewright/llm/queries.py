"""The queries ``opN_<name>`` over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import avi, filter_audit, fim, fingerprints, langid, licences, mixing, pieces, pii, quality, sharding, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: four-word shingles, links at 4 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def learnable(docs: DataFrame) -> DataFrame:
    """The documents whose language may be learned from: two thirds, by CRC of the id."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by Kneser-Ney character models learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(learnable(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP6_SQL = """
WITH alphabet AS (SELECT string_split('A B C D E F G H I J K L M N O P Q R S T U V W X Y Z 2 3 4 5 6 7', ' ') AS a),
paid AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM paid),
first AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h),
coded AS (
  SELECT page_id, payload_bytes, h,
         list_aggregate(list_transform(range(32), lambda i: a[((('0x' || substr(h || '0000', (i * 5 // 8 * 2 + 1)::INT, 4))::BIGINT >> (11 - i * 5 % 8)::INT) & 31) + 1]), 'string_agg', '') AS payload_digest
  FROM hashed, alphabet)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded JOIN first USING (h)
"""


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as motion-JPEG AVI and read back; the feature counts frames, shots and their lengths."""
    found = avi.decode_media(avi.encode_media(table(spark, sf_dir, "documents")))
    feature = F.format_string(
        "frames=%d shots=%d clips=%s sha=%s", "frames", F.size("clips"), F.concat_ws(",", F.transform("clips", lambda c: c["frames"].cast("string"))),
        F.substring(F.sha2(F.concat_ws(",", F.transform("clips", lambda c: c["sha256"])), 256), 1, 16),
    )
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict on its host (its source)."""
    found = quality.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", *quality.COUNTS[1:], "base_failed", "kept", "host_rule", F.round("host_rate", 6).alias("host_rate"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, text, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
windows AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c FROM flat WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN dup d ON w.doc_id = d.doc_id LEFT JOIN covered c ON w.doc_id = c.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
ruled AS (
  SELECT source, rule, limit_, CASE rule WHEN 'lines' THEN 20 * n_dup_lines > n_words WHEN 'repeats' THEN 100 * n_repeat_words > 50 * n_words WHEN 'short' THEN n_words < 50 ELSE 10 * n_symbols > n_words END AS bad
  FROM failed, (VALUES ('lines', 0.3::DOUBLE), ('repeats', 0.5), ('short', 0.5), ('symbols', 0.3)) r(rule, limit_)),
hosts AS (SELECT source, rule, limit_, count(*) AS n_docs, sum(bad::INT) AS n_failed FROM ruled GROUP BY source, rule, limit_),
sums AS (SELECT rule, sum(n_docs)::DOUBLE AS n, sum(n_docs::DOUBLE * n_docs) AS nn, count(*) AS hosts, sum(n_failed)::DOUBLE / sum(n_docs) AS m, sum(n_failed::DOUBLE * n_failed / n_docs) AS w FROM hosts GROUP BY rule),
chance AS (SELECT *, m * (1 - m) AS mm, n - nn / n - (hosts - 1) AS own FROM sums),
prior AS (SELECT rule, m, mm, least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, CASE WHEN mm > 1e-12 AND own > 1e-9 THEN (w - n * m * m - mm * (hosts - 1)) / (mm * own) ELSE 0 END)) AS share FROM chance),
rates AS (SELECT source, rule, least(limit_, greatest(m + 3 * sqrt(mm * share), 2 * m, m + 0.05::DOUBLE)) AS limit_, (n_failed + m * (1 / share - 1)) / (n_docs + (1 / share - 1)) AS rate FROM hosts JOIN prior USING (rule)),
near AS (SELECT *, round(rate / limit_, 9) AS near FROM rates),
verdict AS (SELECT source, arg_min(rule, (-near, rule)) AS host_rule, arg_min(rate, (-near, rule)) AS host_rate, max(near) AS worst FROM near GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND worst <= 1 AS kept, host_rule, round(host_rate, 6) AS host_rate
FROM failed f JOIN verdict r ON f.source IS NOT DISTINCT FROM r.source
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 32k BPE pieces, and the ids decoded again."""
    return pieces.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced by surrogates."""
    found = pii.distinct_surrogates(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), kinds.alias("kinds"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, by paragraph and line."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("licences", ",").alias("licences"), "n_paragraphs")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of the sources at 5 : 2 : 1, repeating, takes."""
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
own AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS whole,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM own),
levels AS (SELECT *, (whole - before) / open_weight AS own_level FROM ordered),
level AS (SELECT arg_min(own_level, before) AS level FROM levels WHERE weight * own_level <= cap),
plan AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
  FROM levels, level),
budget AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM plan),
split AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM budget),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM sized d JOIN split p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken
FROM run
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot, the sources interleaved in proportion."""
    return sharding.shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP10_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
rows_ AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
         md5('shard:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
crc AS (
  SELECT *, xor(list_reduce(
      list_transform(range(size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
      lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM rows_, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, text_crc32, size) - 1 AS place, count(*) OVER (PARTITION BY source) AS n_source, count(*) OVER () AS n
  FROM crc),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY (2 * place + 1)::DOUBLE / (2 * n_source)::DOUBLE, source ASC NULLS LAST) - 1 AS rank FROM placed),
cut AS (SELECT *, (rank * 16 // n)::INT AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""

def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation fingerprints of every document and of its half-edited text, and how alike they and the next document's are."""
    found = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    shown = {c: fingerprints.shown(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")}
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", shown["fingerprint"], shown["edited_fingerprint"], "near_edited", "near_next")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from ``documents``, language by language, in each of their 120 orders."""
    verdicts = filter_audit.text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(verdicts, list("ABCDE")).drop("filter")


OP12_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
  FROM words w JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
mask AS (SELECT *, list_sum(list_transform(range(5), lambda k: CASE WHEN f[k + 1] THEN (1 << k)::BIGINT ELSE 0 END))::BIGINT AS fails FROM flags),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM mask GROUP BY ALL),
letters AS (SELECT k::INT AS k, chr((65 + k)::INT) AS name FROM range(5) r(k)),
paths AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.k <> b.k AND len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, ks[s] AS k, list_sum([0::BIGINT] || list_transform(ks[1:s - 1], lambda x: (1 << x)::BIGINT))::BIGINT AS before
  FROM paths, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, k,
         coalesce(sum(n) FILTER (fails & (before | (1 << k)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & before <> 0 AND fails & (1 << k) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = (1 << k)), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & (1 << k) <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley
FROM counted
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a middle moved to its end, and whether the text comes back from that."""
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units),
ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_licence_scan": op4_licence_scan,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_media_columns": op7_media_columns,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
    "op11_fingerprints": op11_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op5_mixing": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_sharding": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
