"""Queries of this subpackage: what ``__spark_entry__`` registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents")).drop("place")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).drop("copies", "rate")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import MORE, PATTERNS, find_spans, listed

    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *[count(k) for k in MORE], every)


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ranking import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_notices

    return license_notices(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op11_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .rolling_median import cents, rolling_median

    return rolling_median(table(spark, sf_dir, "clicks"), cents(F.col("value")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .best_fit_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
t AS (SELECT doc_id, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 75 * (len(sa.x) + len(sb.x) - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT y.b, r.root FROM r JOIN both_ways y ON y.a = r.id)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.x""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i) WHERE len(w) >= 8),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
ln AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
              length(x) - length(replace(x, '|', '')) AS bars, length(x) - length(replace(x, '!', '')) AS marks,
              length(x) - length(regexp_replace(x, '[#*$%&<>]', '', 'g')) AS symbols FROM d, unnest(l) AS u(x)),
lost AS (SELECT doc_id, sum(chars) AS lost FROM ln WHERE (bars >= 2 AND 4 * bars >= n) OR (symbols >= 3 AND symbols >= n) OR (marks >= 3 AND 3 * marks >= n)
          OR (n <= 25 AND regexp_matches(x, '(?i)all rights reserved|licen[sc]ed under|released under the|terms of (use|service)|privacy policy|cookie|enable javascript|sign up|log in to|click here|subscribe to|share (this|on)')) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.lost, 0) AS lost
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * word_chars AS kept FROM b""",
    "op7_decontamination": rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS x FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, g.n, i, item FROM g JOIN win ON g.x = win.x AND g.n = win.n),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_rolling_median": """
WITH r AS (SELECT click_id, kind, ts, CAST(floor(100 * value + 0.5) AS BIGINT) AS c FROM clicks WHERE ts IS NOT NULL),
e AS (SELECT click_id, kind, ts, c FROM r QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, kind NULLS FIRST, c NULLS FIRST) = 1),
w AS (SELECT click_id, kind, c, list_sort(coalesce(list(c) FILTER (c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW), [])) AS l FROM e),
m AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CASE WHEN len(l) > 1 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM w),
d AS (SELECT *, CASE WHEN n > 1 THEN list_sort(list_transform(l, lambda x: abs(2 * x - median2))) END AS g FROM m),
s AS (SELECT *, CASE WHEN n > 1 THEN g[(n + 1) // 2] + g[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * c - median2) > 3 * mad4 AS far FROM s""",
}
