"""Registered queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, divergence, language_id, neighbour_forest, packing, perspectives, sharding, simhash_dedup, source_mixing, spelling,
    suffix_dedup, token_counts, toxicity,
)
from .common import table


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(language_id.learnable(docs))
    named = language_id.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (language_id.fold_of("doc_id") == 2).alias("held_out"), "lang_pred", "score", "n_words", "n_spans")


def op6_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model)


def op7_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_forest.nearest(table(spark, sf_dir, "embeddings"))


def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(table(spark, sf_dir, "documents"))


def op9_speaker_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_groups, op2_suffix_dedup, op3_source_mix, op4_slot_shards, op5_language_spans, op6_toxic_severity,
        op7_projection_forest, op8_edited_token_counts, op9_speaker_views, op10_benchmark_leaks,
        op11_packed_sequences, op12_spelling_variants, op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS turn
  FROM documents),
listed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth
  FROM sized GROUP BY source),
capped AS (
  SELECT source, source_size, nth, 2 * source_size AS cap,
         CASE (nth - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM listed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, nth
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap / weight::DOUBLE, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS own_level
  FROM capped),
targets AS (
  SELECT source, source_size, nth,
         least(max(own_level) OVER () * weight, cap::DOUBLE) AS target
  FROM levels),
lines AS (
  SELECT *, greatest(1, words // 256) AS block_words, CAST(ceil(source_size / greatest(1, words // 256)::DOUBLE) AS BIGINT) AS n,
         words // greatest(source_size, 1) AS passes
  FROM (SELECT *, CAST(round(target) AS BIGINT) AS words FROM targets)),
used AS (
  SELECT *, passes * n + least(n, CAST(floor((words - passes * source_size) / block_words::DOUBLE + 0.5) AS BIGINT)) AS uses FROM lines),
placed AS (
  SELECT *, coalesce(sum(uses) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
         greatest(length(bin(CAST(sum(uses) OVER () - 1 AS BIGINT))), 1) AS bits
  FROM used),
numbered AS (SELECT *, unnest(range(CAST(first AS BIGINT), CAST(first + uses AS BIGINT))) AS number FROM placed WHERE uses > 0),
slots AS (
  SELECT source, nth, n, list_reduce(list_concat([0::BIGINT], list_transform(range(CAST(bits AS BIGINT)), lambda b: (number >> CAST(b AS BIGINT)) & 1)),
           lambda whole, bit: 2 * whole + bit) AS slot
  FROM numbered),
ranked AS (SELECT source, nth, slot, (row_number() OVER (PARTITION BY nth ORDER BY slot) - 1) % n AS block FROM slots),
takes AS (SELECT source, block, count(*) AS times, min(slot) AS slot FROM ranked GROUP BY source, nth, block),
line AS (
  SELECT row_number() OVER () AS row, s.doc_id, s.source, s.size, l.source_size, l.target, l.block_words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS b
  FROM sized s JOIN placed l ON s.source IS NOT DISTINCT FROM l.source),
pieces AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(CAST(b // block_words AS BIGINT), CAST((b + size - 1) // block_words + 1 AS BIGINT)) ELSE [-1] END) AS block
  FROM line)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(sum(CASE WHEN p.size > 0 THEN least(p.b + p.size, (p.block + 1) * p.block_words) - greatest(p.b, p.block * p.block_words) ELSE 0 END
                * coalesce(t.times, 0)) AS BIGINT) AS taken,
       CAST(min(t.slot) AS BIGINT) AS first_slot
FROM pieces p LEFT JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block
GROUP BY p.row, p.doc_id, p.size, p.source_size, p.target
""",
    "op9_speaker_views": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
views AS (SELECT DISTINCT conv_id, speaker AS viewpoint FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT s.conv_id, v.viewpoint, s.turn, s.speaker, s.text, md5(s.speaker || chr(31) || s.text) AS tie, s.speaker = v.viewpoint AS trained,
         CASE WHEN s.speaker = v.viewpoint THEN 'assistant' WHEN s.speaker = 'system' THEN s.speaker ELSE 'user' END AS role
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
         '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM seen),
pieced AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM headed),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(piece)) OVER w AS BIGINT) - length(piece) AS b
  FROM pieced WINDOW w AS (PARTITION BY conv_id, viewpoint ORDER BY turn NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, viewpoint, turn, seq, role, name, piece, trained, b AS "begin", b + length(piece) AS "end",
       CASE WHEN trained THEN b + length(head) END AS mask_begin, CASE WHEN trained THEN b + length(piece) - 1 END AS mask_end
FROM placed
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::UBIGINT],
           flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::UBIGINT[]),
           lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) AS h
  FROM runs, crc_table),
spelt AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
parts AS (
  SELECT word, n, left(word, CAST(i AS BIGINT)) || '*' || substr(word, CAST(i AS BIGINT) + 2) AS blanked, left(word, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS shorter
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM parts a JOIN parts b ON a.blanked = b.blanked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM parts a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM parts a JOIN words b ON a.shorter = b.word),
best AS (
  SELECT word, near AS form, near_n AS form_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS nth
  FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE nth = 1) b ON w.word = b.word),
chain AS (
  SELECT word, word AS at, form AS further FROM formed
  UNION ALL SELECT c.word, c.further, f.form FROM chain c JOIN formed f ON c.further = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.further IS NULL
""",
    "op13_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT row, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs)),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
priced AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v) AS HUGEINT) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
}
