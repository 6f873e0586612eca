"""The registered queries of the training-data operators, and their SQL where DuckDB can express them.

Each query applies its operator to the whole table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, langid, mixing, near_dedup, pii, quality, secrets, token_files
from ._common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(documents(spark, sf_dir))
    return out.select("doc_id", *[_count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), end_id=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), numerator=85, denominator=100)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_report(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_secrets, op4_pii, op5_token_files, op6_mixing, op7_near_dedup, op8_quality, op9_langid, op10_html)}


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    rules = " OR ".join(f"{m} {side} {bound}" for m, side, bound in quality.RULES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
s AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM h WHERE c > 1),
rep AS (SELECT r, sum(CASE WHEN nx IS NULL THEN 3 ELSE least(3, nx - i) END)::BIGINT AS n FROM s GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: length(x) <= 5 AND list_contains([{stop}], lower(translate(x, '.,;:!?', '')))))::BIGINT AS n_stop_words
  FROM w JOIN l USING (r) LEFT JOIN rep USING (r)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({rules})) AS kept FROM q"""


ORACLES: dict[str, str] = {
    "op2_exact_dedup": "SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op8_quality": _quality_sql(),
}
