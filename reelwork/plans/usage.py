"""Token usage and cost of paid responses."""

from __future__ import annotations

from reelwork.operators import usage as U
from reelwork.plans.base import query

_DEDUP = r"""
, marked AS (SELECT *, sha256(payload) AS payload_hash, regexp_matches(path, '(^|/)attempts/|(^|/)attempt-[0-9]+/|(^|[./])attempt-[0-9]+\.raw_interaction\.json$') AS is_attempt FROM a_usage)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY payload_hash ORDER BY is_attempt DESC, path) AS rn FROM marked)
, kept AS (SELECT * FROM ranked WHERE is_attempt OR rn = 1)"""
_PRICES = ", prices AS (SELECT * FROM (VALUES ('m-a', 1.5::DOUBLE, 0.15::DOUBLE, 7.5::DOUBLE), ('m-b', 0.5::DOUBLE, 0.05::DOUBLE, 3.0::DOUBLE)) v(model, input_price, cached_price, output_price))"
_MODELS = """
, models AS (SELECT model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_tokens)::BIGINT AS cached_tokens, sum(input_tokens - cached_tokens)::BIGINT AS uncached_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(thought_tokens)::BIGINT AS thought_tokens, sum(output_tokens + thought_tokens)::BIGINT AS billed_output_tokens FROM kept WHERE has_usage GROUP BY model)
, costs AS (SELECT models.*, round((uncached_tokens * input_price + cached_tokens * cached_price) / 1000000, 8) AS input_cost, round(billed_output_tokens * output_price / 1000000, 8) AS output_cost FROM models JOIN prices USING (model))"""


@query("a1_usage_dedup", "a_usage", sql=_DEDUP + " SELECT path, payload, model, is_attempt FROM kept")
def _a1(log):
    return U.usage_dedup(log).select("path", "payload", "model", "is_attempt")


@query("a1_usage_duplicates", "a_usage", sql=_DEDUP + " SELECT path, payload_hash FROM ranked WHERE NOT is_attempt AND rn > 1")
def _a1_duplicates(log):
    return U.usage_duplicates(log)


@query("a2_usage_cost", "a_usage", sql=_DEDUP + _PRICES + _MODELS + " SELECT * FROM costs")
def _a2(log):
    return U.usage_cost(log, U.price_table(log.sparkSession, U.EXAMPLE_PRICES))


@query("a2_usage_violations", "a_usage", sql=_DEDUP + _PRICES + """
SELECT path, 'unknown_model' AS rule FROM kept WHERE has_usage AND model NOT IN (SELECT model FROM prices)
UNION ALL SELECT path, 'cached_out_of_range' FROM kept WHERE has_usage AND (cached_tokens < 0 OR cached_tokens > input_tokens)
UNION ALL SELECT path, 'unpriced' FROM kept WHERE NOT has_usage""")
def _a2_violations(log):
    return U.usage_violations(log, U.price_table(log.sparkSession, U.EXAMPLE_PRICES))


@query("a3_usage_total", "a_usage", sql=_DEDUP + _PRICES + _MODELS + """
SELECT CASE WHEN count(*) > 1 THEN 'mixed' ELSE max(model) END AS model, sum(requests)::BIGINT AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(billed_output_tokens)::BIGINT AS billed_output_tokens,
    round(sum(input_cost + output_cost), 6) AS cost, (SELECT count(*) FROM kept WHERE NOT has_usage) AS unpriced, (SELECT count(*) FROM kept WHERE NOT has_usage) = 0 AS pricing_complete,
    (SELECT count(*) FROM ranked WHERE NOT is_attempt AND rn > 1) AS duplicates FROM costs""")
def _a3(log):
    return U.usage_total(log, U.price_table(log.sparkSession, U.EXAMPLE_PRICES))


@query("a4_tokens_by_modality", "a_usage", sql=_DEDUP + """
SELECT modality, sum(tokens)::BIGINT AS tokens FROM (SELECT 'video' AS modality, cached_tokens AS tokens FROM kept WHERE has_usage UNION ALL SELECT 'text', input_tokens - cached_tokens FROM kept WHERE has_usage) GROUP BY modality""")
def _a4(log):
    return U.tokens_by_modality(U.with_modalities(U.usage_dedup(log)))


@query("a5_library_cost", "a_usage", sql=_DEDUP + _PRICES + r"""
, tokens AS (SELECT split_part(path, '/', 1) AS asset_id, model, sum(CASE WHEN has_usage AND NOT is_attempt THEN input_tokens - cached_tokens ELSE 0 END) AS f1, sum(CASE WHEN has_usage AND NOT is_attempt THEN cached_tokens ELSE 0 END) AS c1,
    sum(CASE WHEN has_usage AND NOT is_attempt THEN output_tokens + thought_tokens ELSE 0 END) AS o1, sum(CASE WHEN has_usage THEN input_tokens - cached_tokens ELSE 0 END) AS f2, sum(CASE WHEN has_usage THEN cached_tokens ELSE 0 END) AS c2,
    sum(CASE WHEN has_usage THEN output_tokens + thought_tokens ELSE 0 END) AS o2, count(*) FILTER (WHERE has_usage) AS ok, count(*) FILTER (WHERE NOT has_usage) AS bad FROM kept GROUP BY ALL)
SELECT asset_id, round(sum(f1 * input_price + c1 * cached_price + o1 * output_price) / 1000000, 6) AS execution_cost, round(sum(f2 * input_price + c2 * cached_price + o2 * output_price) / 1000000, 6) AS lifetime_cost,
    sum(ok)::BIGINT AS succeeded, sum(bad)::BIGINT AS failed FROM tokens JOIN prices USING (model) GROUP BY asset_id""")
def _a5(log):
    return U.library_cost(log, U.price_table(log.sparkSession, U.EXAMPLE_PRICES))


@query("s7_changed_artifacts", "a_usage", sql=r"""
, now AS (SELECT path, sha256(payload) AS sha256 FROM a_usage), snapshot AS (SELECT path, sha256(CASE WHEN input_tokens % 10 = 0 THEN payload || '!' ELSE payload END) AS sha256 FROM a_usage WHERE input_tokens % 7 <> 0)
SELECT path, sha256 FROM now WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.path = now.path AND s.sha256 = now.sha256)""")
def _s7(log):
    from pyspark.sql import functions as F

    now = log.select("path", F.sha2("payload", 256).alias("sha256"))
    old = log.where("input_tokens % 7 <> 0").select("path", F.sha2(F.when(F.col("input_tokens") % 10 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")), 256).alias("sha256"))
    return U.changed_artifacts(now, old)


@query("s8_latest_attempt", "a_usage", sql=r"""
, attempts AS (SELECT split_part(path, '/', 1) AS subject, path, input_tokens AS attempt FROM a_usage)
SELECT subject, path, attempt FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY attempt DESC, path DESC) AS rn FROM attempts) WHERE rn = 1""")
def _s8(log):
    from pyspark.sql import functions as F

    return U.latest_attempt(log.select(F.split("path", "/")[0].alias("subject"), "path", F.col("input_tokens").alias("attempt")))
