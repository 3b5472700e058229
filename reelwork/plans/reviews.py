"""Reviews by session, moment and method (view i)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import reviews as R
from reelwork.plans.base import query

_K = "session_id, moment_id, target_id"


@query("j13_method_pairs", "i_review", sql=f"""
, r AS (SELECT * FROM i_review WHERE reviewed), p AS (SELECT a.*, b.grounding_method AS other_method, b.x_min AS ox0, b.y_min AS oy0, b.x_max AS ox1, b.y_max AS oy1 FROM r a JOIN r b USING (session_id, moment_id, target_id) WHERE a.grounding_method <> b.grounding_method)
, f AS (SELECT *, row_number() OVER (PARTITION BY {_K}, grounding_method, x_min ORDER BY other_method, ox0) AS rn FROM p)
, i AS (SELECT *, greatest(0, least(x_max, ox1) - greatest(x_min, ox0)) * greatest(0, least(y_max, oy1) - greatest(y_min, oy0)) AS i FROM f WHERE rn = 1)
, s AS (SELECT {_K}, grounding_method, x_min, other_method, round(i / ((x_max - x_min) * (y_max - y_min) + (ox1 - ox0) * (oy1 - oy0) - i), 6) AS iou, round(sqrt(((x_min + x_max) / 2 - (ox0 + ox1) / 2) ** 2 + ((y_min + y_max) / 2 - (oy0 + oy1) / 2) ** 2), 6) AS distance FROM i)
SELECT {_K}, r.grounding_method, r.x_min, other_method, iou, distance, iou IS NOT NULL AS comparable FROM r LEFT JOIN s USING ({_K}, grounding_method, x_min)""")
def _j13(r):
    return R.method_pairs(r)


# a session's reviews with what a person and a model said; in SQL that Spark and DuckDB share
_REVIEWS = """SELECT session_id, moment_id, concat(session_id, '-', moment_id, '-', target_id, '-', grounding_method) AS review_id, min(x_min) AS position, CASE WHEN bool_and(reviewed) THEN 'reviewed' ELSE 'pending_human_review' END AS status,
    concat('said ', max(x_max)) AS verdict, min(y_min) AS y, max(y_max) AS proposed FROM {rows} GROUP BY session_id, moment_id, target_id, grounding_method"""
_R = f", r AS ({_REVIEWS.format(rows='i_review')})"


def _exported(reviews):
    rows = reviews.sparkSession.sql(_REVIEWS.format(rows="{rows}"), rows=reviews)
    annotations = rows.where("status = 'reviewed' AND y % 7 <> 1 OR y % 11 = 3").select("review_id", F.struct("verdict", "y").alias("annotation"))
    proposals = rows.where("y % 13 <> 5").select("review_id", F.struct("proposed").alias("proposal"))
    return rows.select("session_id", "review_id", "position", "status"), annotations, proposals


@query("s10_export_reviews", "i_review", sql=_R + """
SELECT session_id, review_id, status, CASE WHEN status = 'reviewed' AND (y % 7 <> 1 OR y % 11 = 3) THEN verdict END AS verdict, CASE WHEN status = 'reviewed' AND y % 13 <> 5 THEN proposed END AS proposed FROM r""")
def _s10(r):
    return R.export_reviews(*_exported(r)).select("session_id", "review_id", "status", "annotation.verdict", "proposal.proposed")


@query("s10_pending_reviews", "i_review", sql=_R + """
SELECT session_id, count(*) FILTER (WHERE status = 'reviewed') AS reviewed, coalesce(string_agg(review_id, ',' ORDER BY position, review_id) FILTER (WHERE status <> 'reviewed'), '') AS pending FROM r GROUP BY session_id""")
def _s10p(r):
    return R.pending_reviews(R.export_reviews(*_exported(r))).withColumn("pending", F.array_join("pending", ","))


@query("s10_export_violations", "i_review", sql=_R + """
SELECT session_id, review_id, unnest(list_filter([CASE WHEN status = 'reviewed' AND y % 7 = 1 AND y % 11 <> 3 THEN 'annotation_missing' END, CASE WHEN status = 'reviewed' AND y % 13 = 5 THEN 'proposal_missing' END, CASE WHEN status <> 'reviewed' AND y % 11 = 3 THEN 'annotated_but_pending' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def _s10v(r):
    return R.export_violations(*_exported(r))


@query("v22_review_rules", "i_review", sql=f"""
, r AS (SELECT * REPLACE (x_max - x_min % 5 * 60 AS x_max, y_max - y_min % 3 * 120 AS y_max, x_min - CASE WHEN y_min % 17 = 0 THEN 600 ELSE 0 END AS x_min), x_min % 2 = 0 AS revealed FROM i_review)
SELECT session_id, moment_id, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY {_K}, grounding_method) > 1 THEN 'several_verdicts' END, CASE WHEN revealed AND NOT reviewed THEN 'revealed_before_verdict' END, CASE WHEN x_min >= x_max OR y_min >= y_max OR x_min < 0 OR y_min < 0 OR x_max < 0 OR y_max < 0 OR x_min > 1000 OR y_min > 1000 OR x_max > 1000 OR y_max > 1000 THEN 'bad_box' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def _v22(r):
    moved = r.select(*[c for c in r.columns if c not in ("x_min", "x_max", "y_max")], (F.col("x_max") - F.col("x_min") % 5 * 60).alias("x_max"), (F.col("y_max") - F.col("y_min") % 3 * 120).alias("y_max"), (F.col("x_min") - F.when(F.col("y_min") % 17 == 0, 600).otherwise(0)).alias("x_min"), (F.col("x_min") % 2 == 0).alias("revealed"))
    return R.review_violations(moved)
