"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, huffman, langid, mixing, quality, sharding, simhash, suffixdedup, tokencounts, toxicity
from .common import checkpointed, delete_folder, table, training_row

SQL: dict[str, str] = {}


def op1_mix_sources(spark, sf_dir):
    plan = mixing.mixed(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR))) AS digest
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM by_source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM ranked),
levels AS (
  SELECT *, (SELECT sum(source_size)::DOUBLE FROM by_source) * 1.5::DOUBLE AS budget,
         (SELECT sum(weight) FROM weighed) AS all_weight,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_below,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_below
  FROM weighed),
water AS (
  SELECT max((budget - caps_below) / (all_weight - weight_below)) AS level FROM levels
  WHERE cap / weight >= (budget - caps_below) / (all_weight - weight_below)),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
  FROM levels, water),
quotas AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM targets),
places AS (
  SELECT s.source, s.digest, s.size, count(*) AS n, any_value(q.source_size) AS source_size, any_value(q.target) AS target, any_value(q.copies) AS copies,
         CAST(round(any_value(q.target) - any_value(q.copies) * any_value(q.source_size)) AS BIGINT) AS quota
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source GROUP BY s.source, s.digest, s.size),
ordered AS (
  SELECT *, CAST(coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM places)
SELECT s.doc_id, s.size, o.source_size, o.target, o.copies * s.size + least(s.size, greatest(0, (o.quota - o.start) // o.n)) AS taken
FROM sized s JOIN ordered o ON s.source IS NOT DISTINCT FROM o.source AND s.digest = o.digest AND s.size = o.size
"""


def op2_quality_rules(spark, sf_dir):
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.MEASURES[:5], "base_failed", "kept")


SQL["op2_quality_rules"] = r"""
WITH split AS (
  SELECT rowid_ AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
line_sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM lines GROUP BY r),
windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) t(k) GROUP BY r),
measured AS (
  SELECT s.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM split s LEFT JOIN line_sums USING (r) LEFT JOIN repeats USING (r)),
ruled AS (
  SELECT *, CAST(n_words < 20 AS INT) AS f1, CAST(100 * n_repeat_words > 30 * n_words AS INT) AS f2,
         CAST(10 * n_symbols > greatest(n_words, 1) AS INT) AS f3, CAST(10 * n_dup_lines > 3 * n_lines AS INT) AS f4,
         CAST(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS INT) AS f5
  FROM measured),
hosts AS (SELECT source, rule, count(*) AS n, sum(f) AS fails
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS f FROM ruled) GROUP BY source, rule),
prior AS (SELECT rule, avg(fails / n) AS m, var_pop(fails / n) AS v FROM hosts GROUP BY rule),
strengths AS (SELECT rule, m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END, 1), 1000) AS s FROM prior),
verdicts AS (
  SELECT source, bool_or((fails + m * s) / (n + s) > 0.5) AS host_failed FROM hosts JOIN strengths USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 + f2 > 0) AS base_failed,
       (f1 + f2 = 0 AND NOT host_failed) AS kept
FROM ruled JOIN verdicts ON ruled.source IS NOT DISTINCT FROM verdicts.source
"""


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = langid.trained(docs)
    found = langid.predicted(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_shard_documents(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents")).drop("tokens")


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op7_decontaminate"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS w
  FROM (SELECT item, words, least(10, len(words)) AS m, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM items WHERE len(words) > 0)),
doc_windows AS (
  SELECT r, m, i, array_to_string(list_slice(words, i, i + m - 1), ' ') AS w
  FROM (SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS i
        FROM split, (SELECT DISTINCT m FROM item_windows) WHERE len(words) >= m)),
matches AS (SELECT r, d.m, i, item FROM doc_windows d JOIN item_windows USING (m, w)),
hit_words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM matches, range(0, 10) t(k) WHERE k < m GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM matches WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


#: A parameter: a tiktoken rank file, read with the pattern of its vocabulary.
RANKS = "byte_bpe_50k.tiktoken"


def op8_token_counts(spark, sf_dir):
    """Counts of all documents before and after redaction: doc_id, n_before, n_tokens, n_edits, n_encoded."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    found = tokencounts.edited_counts(table(spark, sf_dir, "documents"), ranks, pattern, tokencounts.redactions)
    return found.select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded")


def op9_suffix_dedup(spark, sf_dir):
    return suffixdedup.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


SQL["op9_suffix_dedup"] = r"""
WITH hexed AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT r, unnest(range(0, octet_length(from_hex(h)) - 199)) AS i FROM hexed),
strings AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM starts JOIN hexed USING (r)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM strings) WHERE n > 1),
marked AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again),
spans AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM marked) GROUP BY r, span),
kept AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
cut AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, CASE WHEN b IS NULL THEN length(h) ELSE 2 * (b - a) END), '' ORDER BY a) AS rest
  FROM kept JOIN hexed USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(rest, h))) AS kept_sha256
FROM hexed LEFT JOIN sums USING (r) LEFT JOIN cut USING (r)
"""


#: A parameter: any file of the tokenizers library whose pre-tokenizer cuts at ASCII white space.
TOKENIZER = "word_bpe_49k.json"


def op10_token_file(spark, sf_dir):
    import public_tokenizers

    path = huffman.new_store_path(spark)
    try:
        huffman.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=1)
        found = huffman.read_store(spark, path)
        return checkpointed(found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    finally:
        delete_folder(spark, path)  # the query's own; a store that is to be kept is written by write_store


def queries():
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql():
    return dict(SQL)
