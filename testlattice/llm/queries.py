"""Thin queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import line_dedup as lines
from . import byte_bpe, filter_audit, html_text, media, mixing, near_dedup, sentencepiece_codec, source_audit, suffix_dedup, token_file, toxicity
from .common import table

MIX = {"entropy_ratio": 0.98, "max_repeats": 4.0, "block_tokens": 100_000}


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """A public tokenizer's file: in the folder that the session's setting names, else where the package of public tokenizers has it."""
    if folder := spark.conf.get("testlattice.tokenizers", ""):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The expression that splits text before the merges of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), **MIX)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file(table(spark, sf_dir, "documents"), tokenizer_file(spark, "word_bpe_49k.json"), end_id=2).drop("token_ids")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("kept_text")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents")).drop("media", "shots")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(table(spark, sf_dir, "documents"), min_docs=10, most_terms=10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_file(spark, "byte_bpe_50k.tiktoken"), pattern())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP1_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), used AS (SELECT * FROM rows_ WHERE n_tokens > 0
), totals AS (SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM used GROUP BY source
), whole AS (SELECT CAST(sum(n_tokens) AS DOUBLE) AS t, count(*) AS n FROM totals
), shares AS (SELECT totals.*, n_tokens / t AS share FROM totals, whole
), up AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT up.k, up.low, up.high, (up.low + up.high) / 2 AS mid, (SELECT ln(sum(pow(share, (up.low + up.high) / 2))) - sum(pow(share, (up.low + up.high) / 2) * ((up.low + up.high) / 2) * ln(share)) / sum(pow(share, (up.low + up.high) / 2)) FROM shares) >= 0.98 * ln((SELECT n FROM whole)) AS ok FROM up WHERE up.k < 45)
), down AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (
    SELECT down.k, down.low, down.high, (down.low + down.high) / 2 AS mid, (SELECT max(pow(share, (down.low + down.high) / 2) / share) / sum(pow(share, (down.low + down.high) / 2)) FROM shares) <= 4 * (1 + 1e-9) AS ok FROM down WHERE down.k < 45)
), exponent AS (SELECT CASE WHEN (SELECT n FROM whole) > 1 THEN greatest((SELECT round(low, 6) FROM up WHERE k = 45), (SELECT round(high, 6) FROM down WHERE k = 45)) ELSE CAST(1 AS DOUBLE) END AS alpha
), norm AS (SELECT sum(pow(share, alpha)) AS z FROM shares, exponent
), weighted AS (
  SELECT source, n_docs, n_tokens AS have, round(pow(share, alpha) / z, 9) AS weight, CAST(floor(round(pow(share, alpha) / z, 9) * t + 0.5) AS BIGINT) AS quota, alpha FROM shares, exponent, norm, whole
), blocks AS (SELECT greatest(1, ceil(sum(quota) / 100000.0)) AS b FROM weighted WHERE quota > 0
), drawn AS (
  SELECT doc_id, used.source, n_tokens, have, weight, quota, alpha, epoch, md5('0|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM used JOIN weighted ON used.source = weighted.source, unnest(generate_series(CAST(0 AS BIGINT), CAST(floor((quota - 1) / have) AS BIGINT))) AS e(epoch) WHERE quota > 0
), placed AS (
  SELECT *, epoch * have + coalesce(CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM drawn
), cut AS (SELECT placed.*, CAST(floor(CAST(start AS DOUBLE) / quota * b) AS BIGINT) AS block FROM placed, blocks WHERE start < quota)
SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY md5(key || '|' || source), doc_id) - 1 AS BIGINT) AS slot, doc_id, source, epoch, n_tokens, weight, alpha FROM cut
"""
OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (frequent.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (frequent.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON keyed.key = frequent.key GROUP BY doc_id
"""
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), n AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)
), o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS k) AS ks
), r AS (
  SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good = 1), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), gn AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS total FROM g LEFT JOIN v ON v.lang = g.lang
), ln AS (SELECT lang, v, sum(total) AS total FROM gn GROUP BY lang, v
), lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term
), lp AS (SELECT lc.lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM lc JOIN ln ON ln.lang = lc.lang
), p AS (SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p FROM gn JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), every_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - lp.p) * (p.p - lp.p)) // (p.p + lp.p) FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE p.n > 0 AND p.p > lp.p
), ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op8_line_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_source_audit": OP12_SQL}
