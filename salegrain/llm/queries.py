"""Queries of the text operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, workers_can_import
from .decontaminate import decontaminate
from .language_id import identify_languages, learn_languages, training_rows
from .line_dedup import dedup_lines
from .near_dedup import near_dedup
from .packing import pack
from .pii import BASE_KINDS, find_pii
from .quality import learn_quality, score_quality
from .secret_scan import scan_secrets
from .spotsigs import fingerprint, fingerprint_documents
from .substring_dedup import dedup_substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_can_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = dedup_substrings(table(spark, sf_dir, "documents"))
    return texts.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc_fold(F.col(doc_id)) == 1, F.lit(False)).alias("held_out")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn_languages(training_rows(docs)))
    return found.select("doc_id", held_out(), "lang_pred", "score", "accepted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string")))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(spans, ",").alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii": op4_pii,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last_id FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone
  FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op10_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), iw AS (
  SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)
), windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS k
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(0, len(ws) - least(10, len(ws)) + 1) + 1)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT w FROM windows),
places AS (
  SELECT doc_id, i, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS k
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, greatest(0, len(ws) - w + 1) + 1)) AS i)
), found AS (
  SELECT DISTINCT p.doc_id, p.i, p.w, x.item_id FROM places p JOIN windows x ON p.w = x.w AND p.k = x.k
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS j FROM (SELECT DISTINCT doc_id, i, w FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS k
  FROM words, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r
), least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_id LEFT JOIN sizes USING (doc_id)
""",
    "op1_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k
  FROM words, LATERAL (SELECT unnest(range(1, greatest(0, len(ws) - 19) + 1)) AS i)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE r > 1),
each AS (SELECT doc_id, u.w, u.j FROM words, LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j) u),
kept AS (
  SELECT e.doc_id, string_agg(w, ' ' ORDER BY e.j) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
}
