"""Boxes and labels of runs (view c)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.functions import geometry as G
from reelwork.operators import compare as C
from reelwork.plans.base import query

_KEY = "asset_id, event_id"
_STATUS = "CASE WHEN NOT visible THEN 'not_visible' WHEN n_candidates = 1 THEN 'matched' ELSE 'ambiguous' END"
_PAIRS = """
, pairs AS (SELECT l.asset_id, l.run_id AS left_run_id, r.run_id AS right_run_id, l.event_id AS left_event_id, r.event_id AS right_event_id, l.kind AS left_kind, r.kind AS right_kind,
    l.x_min AS a0, l.y_min AS a1, l.x_max AS a2, l.y_max AS a3, r.x_min AS b0, r.y_min AS b1, r.x_max AS b2, r.y_max AS b3 FROM c_box l JOIN c_box r ON l.asset_id = r.asset_id AND l.run_id < r.run_id)
, inter AS (SELECT *, greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1)) AS i FROM pairs)
, scored AS (SELECT *, CASE WHEN (a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - i > 0 THEN i / ((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - i)::DOUBLE ELSE 0.0 END AS iou,
    sqrt(((a0 + a2) / 2 - (b0 + b2) / 2) ** 2 + ((a1 + a3) / 2 - (b1 + b3) / 2) ** 2) AS distance FROM inter)"""
_BOX = ["x_min", "y_min", "x_max", "y_max"]


def _pairs(boxes):
    return C.with_box_metrics(C.pairs_within(boxes, ["asset_id"], ["event_id", "kind", *_BOX]))


@query("f1_yxyx_to_xyxy", "c_box", sql="SELECT asset_id, event_id, CASE WHEN x_min < x_max AND y_min < y_max AND x_max <= 1000 AND y_max <= 1000 THEN concat(x_min, ',', y_min, ',', x_max, ',', y_max) END AS box FROM c_box")
def _f1(boxes):
    converted = G.yxyx_to_xyxy(F.array("y_min", "x_min", "y_max", "x_max"))
    return boxes.select("asset_id", "event_id", F.array_join(converted.cast("array<string>"), ",").alias("box"))


@query("f2_normalized_to_pixels", "c_box", sql="""
, p AS (SELECT asset_id, event_id, greatest(0, least(1919, x_min * 1920 // 1000)) AS left_px, greatest(0, least(1079, y_min * 1080 // 1000)) AS top_px, x_max, y_max FROM c_box)
SELECT asset_id, event_id, left_px, top_px, least(1920, greatest(left_px + 1, (x_max * 1920 + 999) // 1000)) AS right_px, least(1080, greatest(top_px + 1, (y_max * 1080 + 999) // 1000)) AS bottom_px FROM p""")
def _f2(boxes):
    low = boxes.select("*", G.pixel_low(F.col("x_min"), 1920).alias("left_px"), G.pixel_low(F.col("y_min"), 1080).alias("top_px"))
    return low.select("asset_id", "event_id", "left_px", "top_px", G.pixel_high(F.col("x_max"), F.col("left_px"), 1920).alias("right_px"), G.pixel_high(F.col("y_max"), F.col("top_px"), 1080).alias("bottom_px"))


@query("f3_box_iou", "c_box", sql=_PAIRS + " SELECT asset_id, left_event_id, right_event_id, round(iou, 6) AS iou FROM scored")
def _f3(boxes):
    return _pairs(boxes).select("asset_id", "left_event_id", "right_event_id", F.round("iou", 6).alias("iou"))


@query("f4_center_distance", "c_box", sql=_PAIRS + " SELECT asset_id, left_event_id, right_event_id, round(distance, 6) AS distance FROM scored")
def _f4(boxes):
    return _pairs(boxes).select("asset_id", "left_event_id", "right_event_id", F.round("distance", 6).alias("distance"))


@query("f5_pad_box", "c_box", sql="""
, p AS (SELECT *, round_even((x_max - x_min) * 0.1::DOUBLE, 0)::BIGINT AS dx, round_even((y_max - y_min) * 0.1::DOUBLE, 0)::BIGINT AS dy FROM c_box)
SELECT asset_id, event_id, greatest(0, x_min - dx) AS x0, greatest(0, y_min - dy) AS y0, least(1000, x_max + dx) AS x1, least(1000, y_max + dy) AS y1 FROM p""")
def _f5(boxes):
    return boxes.select("asset_id", "event_id", *[c.alias(n) for c, n in zip(G.padded(C.box(), 0.1), ("x0", "y0", "x1", "y1"), strict=True)])


@query("f6_box_to_xywh", "c_box", sql="""
, p AS (SELECT asset_id, event_id, least(greatest(round_even(x_min * 1280 / 1000, 0)::BIGINT, 0), 1279) AS x, least(greatest(round_even(y_min * 720 / 1000, 0)::BIGINT, 0), 719) AS y,
    least(round_even(x_max * 1280 / 1000, 0)::BIGINT, 1280) AS x1, least(round_even(y_max * 720 / 1000, 0)::BIGINT, 720) AS y1 FROM c_box)
SELECT asset_id, event_id, x, y, greatest(1, x1 - x) AS w, greatest(1, y1 - y) AS h FROM p""")
def _f6(boxes):
    return boxes.select("asset_id", "event_id", *[c.alias(n) for c, n in zip(G.to_xywh(C.box(), 1280, 720), "xywh", strict=True)])


@query("f9_label_similarity", "c_box")
def _f9(boxes):
    pairs = C.pairs_within(boxes, ["asset_id"], ["event_id", "label"])
    return C.with_label_similarity(pairs, "left_label", "right_label").select("asset_id", "left_event_id", "right_event_id", F.round("similarity", 9).alias("similarity"))


@query("p6_single_matched", "c_box", sql=f"SELECT {_KEY}, x_min, y_min, x_max, y_max FROM c_box WHERE visible AND n_candidates = 1")
def _p6(boxes):
    return C.single_matched(boxes).select("asset_id", "event_id", *_BOX)


_SEED = """
SELECT asset_id, event_id, CASE WHEN reject_reason IS NULL THEN coalesce(number, 1) END AS candidate_number, CASE WHEN reject_reason IS NULL THEN CASE WHEN number IS NULL THEN 'single_matched_candidate' ELSE 'explicit_candidate_number' END END AS selection_source, reject_reason FROM (
SELECT *, CASE WHEN NOT visible THEN 'not_visibly_grounded' WHEN number IS NULL AND n_candidates <> 1 THEN 'needs_review' WHEN number < 1 OR number > n_candidates THEN 'number_out_of_range' END AS reject_reason
FROM (SELECT *, CASE WHEN entity_id % 4 = 0 THEN 2::BIGINT END AS number FROM c_box))"""


@query("p7_tracking_seed", "c_box", sql=_SEED)
def _p7(boxes):
    proposals = boxes.withColumn("status", C.match_status(F.col("visible"), F.col("n_candidates")))
    return C.tracking_seed(proposals, ["asset_id", "event_id"], F.when(F.col("entity_id") % 4 == 0, 2))


@query("p13_match_status", "c_box", sql=f"SELECT {_KEY}, {_STATUS} AS status FROM c_box")
def _p13(boxes):
    return boxes.select("asset_id", "event_id", C.match_status(F.col("visible"), F.col("n_candidates")).alias("status"))


_GIVEN = "CASE entity_id % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_visible' END"


@query("p13_match_status_violations", "c_box", sql=f"""
SELECT asset_id, event_id, rule FROM (SELECT *, CASE WHEN status = 'matched' AND (NOT visible OR n_candidates <> 1) THEN 'matched_needs_one_visible' WHEN status = 'ambiguous' AND NOT visible THEN 'ambiguous_needs_candidates'
    WHEN status NOT IN ('matched', 'ambiguous') THEN 'other_needs_none' END AS rule FROM (SELECT *, coalesce({_GIVEN}, {_STATUS}) AS status FROM c_box)) WHERE rule IS NOT NULL""")
def _p13v(boxes):
    given = boxes.withColumn("status", C.match_status(F.col("visible"), F.col("n_candidates"), F.expr(_GIVEN)))
    return C.match_status_violations(given, ["asset_id", "event_id"])


@query("j11_run_pairs", "c_box", sql=", runs AS (SELECT DISTINCT run_id FROM c_box) SELECT l.run_id AS left_run, r.run_id AS right_run FROM runs l JOIN runs r ON l.run_id < r.run_id")
def _j11(boxes):
    return C.run_pairs(boxes)


@query("j12_all_pairs_within", "c_box", sql=_PAIRS + " SELECT asset_id, left_run_id, right_run_id, count(*) AS pairs FROM pairs GROUP BY ALL")
def _j12(boxes):
    return C.pairs_within(boxes, ["asset_id"], ["event_id"]).groupBy("asset_id", "left_run_id", "right_run_id").agg(F.count("*").alias("pairs"))


@query("j16_request_match", "c_box", sql="""
SELECT asset_id, event_id, field, expected, actual FROM (SELECT asset_id, event_id, 'entity_id' AS field, entity_id::VARCHAR AS expected, (entity_id + CASE WHEN entity_id % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR AS actual FROM c_box
UNION ALL SELECT asset_id, event_id, 'frame_time_ms', frame_time_ms::VARCHAR, CASE WHEN entity_id % 7 <> 0 THEN frame_time_ms END::VARCHAR FROM c_box) WHERE expected IS DISTINCT FROM actual""")
def _j16(boxes):
    cached = boxes.select("asset_id", "event_id", (F.col("entity_id") + F.when(F.col("entity_id") % 10 == 0, 1).otherwise(0)).alias("entity_id"), F.when(F.col("entity_id") % 7 != 0, F.col("frame_time_ms")).alias("frame_time_ms"))
    return C.request_mismatches(cached, boxes, ["asset_id", "event_id"], ["entity_id", "frame_time_ms"])


def _events(boxes):
    pairs = C.with_label_similarity(C.pairs_within(boxes, ["asset_id"], ["event_id", "label", "kind", *_BOX]), "left_label", "right_label")
    return pairs.select("asset_id", "left_run_id", "right_run_id", "left_event_id", "right_event_id", "left_kind", "right_kind", "similarity", *[f"{s}_{c}" for s in ("left", "right") for c in _BOX])


_GROUP = ["asset_id", "left_run_id", "right_run_id"]


@query("t1_greedy_match", "c_box")
def _t1(boxes):
    return C.greedy_match(_events(boxes), _GROUP, "left_event_id", "right_event_id").select(*_GROUP, "left_event_id", "right_event_id", F.round("similarity", 9).alias("similarity"))


@query("t2_greedy_match_groundings", "c_box")
def _t2(boxes):
    return C.match_groundings(_events(C.single_matched(boxes)), _GROUP, "left_event_id", "right_event_id").select(*_GROUP, "left_event_id", "right_event_id", F.round("similarity", 9).alias("similarity"))


@query("c1_compare_runs", "c_box")
def _c1(boxes):
    return C.with_box_metrics(C.match_groundings(_events(C.single_matched(boxes)), _GROUP, "left_event_id", "right_event_id")).select(*_GROUP, "left_event_id", "right_event_id", F.round("iou", 6).alias("iou"), F.round("distance", 6).alias("distance"))


def _references(boxes):
    return boxes.where("run_id = 0").select("asset_id", F.col("event_id").alias("reference_id"), F.col("label").alias("reference_label"), (F.col("frame_time_ms") + 100).alias("reference_time_ms"), *[F.col(c).alias(f"reference_{c}") for c in _BOX])


@query("t3_best_proposal", "c_box")
def _t3(boxes):
    return C.best_proposal(_references(boxes), C.single_matched(boxes).where("run_id <> 0"), ["asset_id"]).select("asset_id", "reference_id", "event_id", F.round("similarity", 9).alias("similarity"), "gap_ms", "comparable", "reason")


@query("c2_compare_reference", "c_box")
def _c2(boxes):
    references = _references(boxes)
    found = C.with_box_metrics(C.best_proposal(references, C.single_matched(boxes).where("run_id <> 0"), ["asset_id"]), "reference_", "")
    kept = found.select("asset_id", "reference_id", "event_id", "comparable", "reason", F.when(F.col("comparable"), F.round("iou", 6)).alias("iou"))
    return references.select("asset_id", "reference_id").join(kept, ["asset_id", "reference_id"], "left")


@query("c3_repeatability", "c_box", sql=_PAIRS + " SELECT asset_id, left_run_id, right_run_id, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(min(distance), 6) AS min_distance FROM scored GROUP BY ALL")
def _c3(boxes):
    return _pairs(boxes).groupBy(*_GROUP).agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.min("distance"), 6).alias("min_distance"))


@query("a6_repeat_summary", "c_box", sql="""
SELECT kind, run_id, count(*) AS requested, count(*) FILTER (WHERE visible AND n_candidates = 1) AS succeeded, count(*) FILTER (WHERE NOT (visible AND n_candidates = 1)) AS failures, round(avg(CASE WHEN visible AND n_candidates = 1 THEN (x_min + x_max) / 2 END), 6) AS mean_center_x FROM c_box GROUP BY ALL""")
def _a6(boxes):
    return C.repeat_summary(boxes, ["kind", "run_id"])


@query("a7_ab_group_stats", "c_box", sql=_PAIRS + " SELECT left_kind, count(*) AS runs, count(*) FILTER (WHERE iou >= 0.8) AS passed, count(*) - count(*) FILTER (WHERE iou >= 0.8) AS failed, round(avg(iou), 6) AS mean_iou, round(min(iou), 6) AS min_iou, round(max(iou), 6) AS max_iou FROM scored GROUP BY left_kind")
def _a7(boxes):
    return C.group_stats(_pairs(boxes), "left_kind")


@query("a8_verdict_counts", "c_box", sql=_PAIRS + """
SELECT left_run_id, count(*) FILTER (WHERE same AND iou >= 0.8) AS passed, count(*) FILTER (WHERE same AND iou >= 0.5 AND iou < 0.8) AS review, count(*) FILTER (WHERE same AND iou < 0.5 OR NOT same AND left_event_id % 2 = 0) AS failed, count(*) FILTER (WHERE NOT same AND left_event_id % 2 <> 0) AS unscored
FROM (SELECT *, left_kind = right_kind AS same FROM scored) GROUP BY left_run_id""")
def _a8(boxes):
    same = F.col("left_kind") == F.col("right_kind")
    reason = F.when(F.col("left_event_id") % 2 == 0, "label similarity below 0.75").otherwise("no box")
    return C.verdict_counts(_pairs(boxes).withColumn("verdict", C.verdict(same, F.col("iou"), reason)), ["left_run_id"])


@query("v8_grounding_boxes", "c_box", sql="SELECT asset_id, event_id, 'out_of_range' AS rule FROM c_box WHERE x_max > 1000 OR y_max > 1000")
def _v8(boxes):
    return C.box_violations(boxes, ["asset_id", "event_id"])
