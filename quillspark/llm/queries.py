"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import align, decontaminate, exact, langid, minhash, mixing, ngram_join, passages, quality, resample, secrets, tokens, warc
from quillspark.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write(_table(spark, sf_dir, "documents"), new_path(spark, "tokens")).documents()


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.spans(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.sums(warc.read(spark, path))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(_table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.Alignment(_table(spark, sf_dir, "documents")).documents()


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_passages": op10_passages,
    "op11_resampling": op11_resampling,
    "op12_alignment": op12_alignment,
    "op13_minhash": op13_minhash,
}

#: Documents (sets) and the pairs of rows that links of at least PERCENT in a hundred connect (reach).
_LINKED = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
grams AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.r AS x, b.r AS y, a.n + b.n AS n, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= PERCENT * (n - shared)),
reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS key
  FROM documents),
own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER up_to, 0) AS DOUBLE) / CAST(sum(weight) OVER onward AS DOUBLE) AS level
  FROM own
  WINDOW up_to AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT arg_min(level, CAST(3 * source_size AS DOUBLE) / weight) AS level FROM leveled WHERE 3 * source_size > level * weight),
targets AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= l.level * weight THEN CAST(3 * source_size AS DOUBLE) ELSE w.level * weight END AS target
  FROM leveled l, water w),
shares AS (
  SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS take, CAST((least(CAST(round(target) AS BIGINT), 3 * source_size) + 4095) // 4096 AS BIGINT) AS slots
  FROM targets),
stretches AS (
  SELECT *, CAST(floor(CAST(sum(take) OVER (ORDER BY source NULLS LAST) AS DOUBLE) / CAST(sum(take) OVER () AS DOUBLE) * 4611686018427387904.0::DOUBLE) AS BIGINT) AS high,
         CAST((sum(take) OVER () + 4095) // 4096 AS BIGINT) AS points
  FROM shares),
points AS (
  SELECT slot, CAST(slot::HUGEINT * 2850178573120402645 % 4611686018427387904 AS BIGINT) AS u
  FROM (SELECT unnest(range(coalesce((SELECT max(points) FROM stretches), 0))) AS slot)),
bounds AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low FROM stretches),
won AS (
  SELECT b.source, b.slots, slot, row_number() OVER (PARTITION BY b.source ORDER BY slot) - 1 AS block
  FROM points p JOIN bounds b ON p.u >= b.low AND p.u < b.high),
missed AS (
  SELECT b.source, unnest(range(coalesce(h.have, 0), b.slots)) AS block, b.points
  FROM bounds b LEFT JOIN (SELECT source, count(*) AS have FROM won GROUP BY source) h ON b.source IS NOT DISTINCT FROM h.source),
schedule AS (
  SELECT source, block, slot FROM won WHERE block < slots
  UNION ALL SELECT source, block, points + row_number() OVER (ORDER BY block, source NULLS LAST) - 1 FROM missed),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.take, t.slots,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source)
SELECT p.doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (take // source_size) + greatest(0, least(size, take % source_size - before)) END AS BIGINT) AS taken,
       p.slots, CASE WHEN size > 0 AND before < take THEN s.slot END AS first_slot
FROM placed p LEFT JOIN schedule s ON p.source IS NOT DISTINCT FROM s.source AND p.before // 4096 = s.block
""",
    "op6_ngram_join": _LINKED.replace("PERCENT", "80") + """
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN sets a ON a.r = x JOIN sets b ON b.r = y GROUP BY x, a.doc_id, a.s
""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM r
""",
    "op11_resampling": r"""
WITH RECURSIVE step(v, c, i) AS (
  SELECT v, v, 0 FROM range(256) r(v)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY v) AS t FROM step WHERE i = 8),
texts AS (
  SELECT true AS own, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT false, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
  SELECT own, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc),
placed AS (SELECT own, id, bucket FROM features JOIN hashed USING (f)),
sums AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight, count(*) AS n_features FROM placed JOIN gains USING (bucket) WHERE own GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (id) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
""",
    "op13_minhash": _LINKED.replace("PERCENT", "85") + """
SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id, coalesce(a.doc_id = min(b.doc_id), false) AS kept
FROM reach JOIN sets a ON a.r = x JOIN sets b ON b.r = y GROUP BY x, a.doc_id, a.s
""",
}
