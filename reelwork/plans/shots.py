"""Shots, intervals and sampling plans (views b)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.times import mmss_to_ms, ms_to_mmss, pts_to_ms
from reelwork.operators import shots as S
from reelwork.plans.base import query

_SHOTS = """
, assets AS (SELECT DISTINCT asset_id, duration_ms FROM b_points)
, starts AS (SELECT DISTINCT asset_id, t_ms FROM b_boundary WHERE t_ms > 0 AND t_ms < duration_ms UNION SELECT asset_id, 0 FROM assets)
, shots AS (SELECT asset_id, row_number() OVER w AS shot_index, t_ms AS start_ms, coalesce(lead(t_ms) OVER w, duration_ms) AS end_ms FROM starts JOIN assets USING (asset_id) WINDOW w AS (PARTITION BY asset_id ORDER BY t_ms))"""
_ALL = ("b_points", "b_boundary", "b_event")
_KIND = "CASE event_id % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' ELSE 'none' END"


def _shots(points, boundary):
    return S.shots_from_scores(boundary, points.select("asset_id", "duration_ms").distinct())


def _inspection(events):
    return events.withColumn("inspection", F.expr(_KIND))


@query("w1_shots", "b_points", "b_boundary", sql=_SHOTS + " SELECT * FROM shots")
def _w1(points, boundary):
    return _shots(points, boundary)


@query("w1_boundaries", "b_boundary", sql="SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY t_ms) AS boundary_index, t_ms, max(score) AS score FROM b_boundary WHERE t_ms > 0 AND t_ms < duration_ms GROUP BY asset_id, t_ms")
def _w1b(boundary):
    return S.best_boundaries(boundary)


@query("j2_point_in_shot", *_ALL, sql=_SHOTS + " SELECT e.asset_id, event_id, shot_index FROM b_event e JOIN shots s ON e.asset_id = s.asset_id AND s.start_ms <= e.start_ms AND e.start_ms < s.end_ms")
def _j2(points, boundary, events):
    return S.point_in_interval(events.select("asset_id", "event_id", F.col("start_ms").alias("at_ms")), _shots(points, boundary), "asset_id", "at_ms").select("asset_id", "event_id", "shot_index")


_J3 = _SHOTS + """
, hit AS (SELECT e.asset_id, e.event_id, list_sort(list(shot_index)) AS shot_ids FROM b_event e JOIN shots s ON e.asset_id = s.asset_id AND s.start_ms < e.end_ms AND s.end_ms > e.start_ms GROUP BY ALL)"""


@query("j3_event_shot_overlap", *_ALL, sql=_J3 + " SELECT asset_id, event_id, array_to_string(shot_ids, ',') AS shot_ids, coalesce(len(shot_ids) > 1, false) AS exact_frame_required FROM b_event LEFT JOIN hit USING (asset_id, event_id)")
def _j3(points, boundary, events):
    return S.event_shot_overlap(events, _shots(points, boundary)).withColumn("shot_ids", F.array_join(F.col("shot_ids").cast("array<string>"), ","))


@query("j3_events_without_shot", *_ALL, sql=_J3 + " SELECT asset_id, event_id FROM b_event ANTI JOIN hit USING (asset_id, event_id)")
def _j3v(points, boundary, events):
    return S.event_shot_overlap(events, _shots(points, boundary)).where("shot_ids IS NULL").select("asset_id", "event_id")


@query("j4_interval_intersection", *_ALL, sql=_SHOTS + """
SELECT e.asset_id, event_id, greatest(e.start_ms, s.start_ms) AS from_ms, least(e.end_ms, s.end_ms) AS to_ms, e.start_ms + 30000 AS seed_ms FROM b_event e JOIN shots s ON e.asset_id = s.asset_id AND s.start_ms <= e.start_ms + 30000 AND e.start_ms + 30000 < s.end_ms
WHERE greatest(e.start_ms, s.start_ms) <= e.start_ms + 30000 AND e.start_ms + 30000 < least(e.end_ms, s.end_ms)""")
def _j4(points, boundary, events):
    p = events.select("asset_id", "event_id", F.col("start_ms").alias("allowed_start"), F.col("end_ms").alias("allowed_end"), (F.col("start_ms") + 30000).alias("seed_ms"))
    return S.interval_intersection(p, _shots(points, boundary))


_J5 = _SHOTS + """
, centered AS (SELECT *, coalesce(keyframe_ms, (start_ms + end_ms) // 2) AS center_ms FROM b_event)
, windows AS (SELECT e.asset_id, event_id, shot_index, center_ms, greatest(center_ms - 2000, e.start_ms, s.start_ms) AS window_start, least(center_ms + 2000, e.end_ms, s.end_ms) AS window_end
    FROM centered e JOIN shots s ON e.asset_id = s.asset_id AND s.start_ms <= center_ms AND center_ms < s.end_ms)
, dense AS (SELECT * FROM windows WHERE window_end - window_start >= 250)"""


@query("j5_dense_window", *_ALL, sql=_J5 + " SELECT * FROM dense")
def _j5(points, boundary, events):
    return S.dense_window(events, _shots(points, boundary))


@query("j6_segment_bounds", *_ALL, sql=_SHOTS + """
, held AS (SELECT e.asset_id, event_id, s.start_ms AS a, s.end_ms AS b, e.start_ms - 2500 AS x FROM b_event e JOIN shots s ON e.asset_id = s.asset_id AND s.start_ms <= e.start_ms AND e.start_ms < s.end_ms)
, shifted AS (SELECT *, CASE WHEN x < a THEN a WHEN x + 5000 > b THEN b - 5000 ELSE x END AS y FROM held)
SELECT asset_id, event_id, greatest(y, a) AS segment_start, least(y + 5000, b) AS segment_end FROM shifted WHERE least(y + 5000, b) - greatest(y, a) >= 1000""")
def _j6(points, boundary, events):
    return S.segment_bounds(events.select("asset_id", "event_id", F.col("start_ms").alias("center_ms")), _shots(points, boundary), 5000)


@query("p4_events_needing_dense", "b_event", sql=f"SELECT asset_id, event_id FROM b_event WHERE {_KIND} IN ('required', 'recommended')")
def _p4(events):
    return S.events_needing_dense(_inspection(events), "flagged").select("asset_id", "event_id")


@query("p10_tracking_seed_time", "b_event", sql="SELECT asset_id, event_id, CASE WHEN keyframe_ms >= start_ms AND keyframe_ms < end_ms THEN keyframe_ms ELSE (start_ms + end_ms) // 2 END AS seed_ms FROM b_event")
def _p10(events):
    return events.select("asset_id", "event_id", S.seed_time(F.col("keyframe_ms"), F.col("start_ms"), F.col("end_ms")).alias("seed_ms"))


@query("f7_mmss", "b_event", sql="SELECT event_id, lpad((start_ms // 60000)::VARCHAR, greatest(2, len((start_ms // 60000)::VARCHAR))::INT, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') AS text, start_ms // 1000 * 1000 AS back_ms FROM b_event")
def _f7(events):
    return events.select("event_id", ms_to_mmss(F.col("start_ms")).alias("text")).withColumn("back_ms", mmss_to_ms(F.col("text")))


@query("f8_pts_to_ms", "b_points", sql="""
, x AS (SELECT event_id, t_ms * 7 * 1001 * 1000 AS n, 30000 AS d FROM b_points), y AS (SELECT event_id, n % d AS r, (n - n % d) // d AS q, d FROM x)
SELECT event_id, q + CASE WHEN 2 * r > d OR (2 * r = d AND q % 2 = 1) THEN 1 ELSE 0 END AS ms FROM y""")
def _f8(points):
    return points.select("event_id", pts_to_ms(F.col("t_ms") * 7, 0, F.lit(1001).cast("long"), F.lit(30000).cast("long")).alias("ms"))


_SAID = "CASE event_id % 6 WHEN 0 THEN concat('A Fast ', event_type) WHEN 1 THEN concat('快速 ', event_type) WHEN 2 THEN concat('cut of 0.3 s, ', event_type) WHEN 3 THEN concat('UI panel, ', event_type) WHEN 4 THEN concat('a sudden ', event_type) ELSE concat('a slow ', event_type) END"


@query("f11_dense_fps", "b_points", sql=f"""
, n AS (SELECT event_id, {_KIND} AS kind, lower({_SAID}) AS said FROM b_points)
SELECT event_id, CASE WHEN kind = 'required' AND list_bool_or([contains(said, m) FOR m IN ['快速', '短暫', '0.2', '0.3', '0.4', '0.5', 'fast', 'transient', 'ui']]) THEN 8 WHEN kind IN ('required', 'recommended') THEN 4 ELSE 2 END AS fps FROM n""")
def _f11(points):
    return points.select("event_id", S.dense_fps(F.expr(_KIND), F.expr(_SAID)).alias("fps"))


@query("w13_frame_numbering", "b_points", sql="SELECT event_id, 'RF' || lpad((row_number() OVER (ORDER BY asset_id, t_ms, event_id))::VARCHAR, 6, '0') AS frame_id FROM b_points")
def _w13(points):
    return S.frame_numbers(points, "asset_id", ["t_ms", "event_id"], "RF").select("event_id", "frame_id")


_GRID = """
, times AS (SELECT asset_id, event_id, unnest(range(window_start, window_end, {step})) AS frame_ms FROM {windows} JOIN b_event USING (asset_id, event_id) UNION SELECT asset_id, event_id, keyframe_ms FROM {windows} JOIN b_event USING (asset_id, event_id) WHERE window_start <= keyframe_ms AND keyframe_ms < window_end)"""


@query("w14_grid_sample", *_ALL, sql=_J5 + _GRID.format(step=500, windows="dense") + " SELECT asset_id, event_id, frame_ms FROM times")
def _w14(points, boundary, events):
    return S.dense_grid(S.dense_window(events, _shots(points, boundary), keep=("keyframe_ms", "duration_ms")), 500)


@query("w14_grid_violations", *_ALL, sql=_J5 + _GRID.format(step=1, windows="dense") + " SELECT asset_id, event_id, 'over_limit' AS rule, count(*) AS frames FROM times GROUP BY ALL HAVING count(*) > 3600")
def _w14v(points, boundary, events):
    return S.dense_grid_violations(S.dense_window(events, _shots(points, boundary), keep=("keyframe_ms", "duration_ms")), 1)


@query("w15_bucket_sample", "b_points", sql="""
, x AS (SELECT *, (t_ms - min(t_ms) OVER (PARTITION BY asset_id)) // 86400000 AS bucket FROM b_points), y AS (SELECT *, row_number() OVER (PARTITION BY asset_id, bucket ORDER BY t_ms, event_id) AS rn FROM x)
SELECT asset_id, event_id, t_ms FROM y WHERE rn = 1 OR event_type = 'purchase'""")
def _w15(points):
    return S.bucket_sample(points, "asset_id", "t_ms", 86_400_000, "event_type = 'purchase'").select("asset_id", "event_id", "t_ms")


@query("c4_clip_timeline", *_ALL, sql=_J3 + """
SELECT asset_id, event_id, array_to_string(shot_ids, ',') AS shot_ids, coalesce(len(shot_ids) > 1, false) AS exact_frame_required,
    lpad((start_ms // 60000)::VARCHAR, greatest(2, len((start_ms // 60000)::VARCHAR))::INT, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') AS start_text,
    lpad((end_ms // 60000)::VARCHAR, greatest(2, len((end_ms // 60000)::VARCHAR))::INT, '0') || ':' || lpad((end_ms // 1000 % 60)::VARCHAR, 2, '0') AS end_text FROM b_event LEFT JOIN hit USING (asset_id, event_id)""")
def _c4(points, boundary, events):
    return S.clip_timeline(events, _shots(points, boundary)).withColumn("shot_ids", F.array_join(F.col("shot_ids").cast("array<string>"), ","))


@query("c5_dense_plan", *_ALL, sql=_J5 + f"""
, planned AS (SELECT *, 4 AS fps FROM dense WHERE {_KIND} IN ('required', 'recommended'))
""" + _GRID.format(step=250, windows="planned") + """
SELECT asset_id, event_id, frame_ms, 'DF' || lpad((row_number() OVER (PARTITION BY asset_id, event_id ORDER BY frame_ms))::VARCHAR, 6, '0') AS frame_id FROM times""")
def _c5(points, boundary, events):
    from pyspark.sql import Window as W

    flagged = S.events_needing_dense(_inspection(events), "flagged")
    fps = S.dense_fps(F.expr(_KIND), F.lit("steady"))
    windows = S.dense_window(flagged, _shots(points, boundary), keep=("keyframe_ms", "duration_ms"))
    frames = S.dense_grid(windows, F.floor(F.lit(1000) / fps))
    n = F.row_number().over(W.partitionBy("asset_id", "event_id").orderBy("frame_ms"))
    return frames.withColumn("frame_id", F.concat(F.lit("DF"), F.lpad(n.cast("string"), 6, "0")))


@query("v1_content_map", "b_event", sql="""
SELECT asset_id, event_id, 'empty_interval' AS rule FROM b_event WHERE start_ms >= end_ms UNION ALL SELECT asset_id, event_id, 'keyframe_outside' FROM b_event WHERE keyframe_ms < start_ms OR keyframe_ms >= end_ms
UNION ALL SELECT asset_id, event_id, 'beyond_duration' FROM b_event WHERE end_ms > duration_ms UNION ALL SELECT asset_id, event_id, 'duplicate_id' FROM (SELECT *, count(*) OVER (PARTITION BY asset_id, event_id) AS n FROM b_event) WHERE n > 1""")
def _v1(events):
    return S.content_map_violations(events)


@query("v1_entity_references", "b_event", sql="""
, e AS (SELECT asset_id, event_id % 10 AS entity_id FROM b_event WHERE event_id % 10 < 8 GROUP BY ALL UNION ALL SELECT DISTINCT asset_id, 3 FROM b_event WHERE asset_id % 7 = 0), r AS (SELECT DISTINCT asset_id, event_id, unnest([event_id % 10, 1]) AS entity_id FROM b_event)
SELECT asset_id, event_id, entity_id, 'unknown_entity' AS rule FROM r ANTI JOIN e USING (asset_id, entity_id) UNION ALL SELECT asset_id, NULL, entity_id, 'duplicate_entity' FROM e GROUP BY asset_id, entity_id HAVING count(*) > 1""")
def _v1e(events):
    entities = events.select("asset_id", (F.col("event_id") % 10).cast("long").alias("entity_id")).where("entity_id < 8").distinct().unionByName(events.where("asset_id % 7 = 0").select("asset_id", F.lit(3).cast("long").alias("entity_id")).distinct())
    references = events.select("asset_id", "event_id", F.explode(F.array((F.col("event_id") % 10).cast("long"), F.lit(1).cast("long"))).alias("entity_id"))
    return S.entity_violations(references, entities)


# events as a model lists them: some twice, some turned round, some with a keyframe elsewhere
_LISTED = """, listed AS (SELECT asset_id, event_id - CASE WHEN event_id % 31 = 7 THEN 30 ELSE 0 END AS event_id, start_ms, CASE WHEN event_id % 37 = 5 THEN start_ms ELSE end_ms END AS end_ms, start_ms + CASE WHEN event_id % 29 = 3 THEN -1 WHEN event_id % 23 = 4 THEN 10000000 ELSE 0 END AS keyframe_ms,
    duration_ms, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms + CASE WHEN event_id % 19 = 2 THEN 86400000 ELSE 0 END, event_id) AS position FROM b_event)"""


def _listed(events):
    key = lambda n, k: F.col("event_id") % n == k
    order = W.partitionBy("asset_id").orderBy(F.col("start_ms") + F.when(key(19, 2), 86_400_000).otherwise(0), "event_id")
    return events.select(
        "asset_id", (F.col("event_id") - F.when(key(31, 7), 30).otherwise(0)).alias("event_id"), "start_ms", F.when(key(37, 5), F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        (F.col("start_ms") + F.when(key(29, 3), -1).when(key(23, 4), 10_000_000).otherwise(0)).alias("keyframe_ms"), "duration_ms", F.row_number().over(order).alias("position"),
    )


@query("v2_temporal_map", "b_event", sql=_LISTED + """
, m AS (SELECT *, count(*) OVER (PARTITION BY asset_id, event_id) AS n, lag(end_ms) OVER (PARTITION BY asset_id ORDER BY position) AS before FROM listed)
SELECT asset_id, event_id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN end_ms <= start_ms THEN 'empty_interval' END, CASE WHEN keyframe_ms < start_ms OR keyframe_ms >= end_ms THEN 'keyframe_outside' END, CASE WHEN end_ms > duration_ms THEN 'beyond_duration' END, CASE WHEN start_ms < before THEN 'overlap' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def _v2(events):
    return S.temporal_map_violations(_listed(events))


@query("v3_moments", "b_event", sql=_LISTED + """
, m AS (SELECT *, count(*) OVER (PARTITION BY asset_id, event_id) AS n, lag(start_ms // 1000) OVER (PARTITION BY asset_id ORDER BY position) AS before FROM listed)
SELECT asset_id, event_id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN start_ms // 1000 <= before THEN 'not_increasing' END, CASE WHEN start_ms // 1000 * 1000 >= duration_ms THEN 'beyond_duration' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def _v3(events):
    return S.moment_violations(_listed(events))


@query("v3_target_candidates", "b_event", "b_points", sql=_LISTED + """
, m AS (SELECT *, count(*) OVER (PARTITION BY asset_id, event_id) AS n FROM listed)
SELECT asset_id, event_id, 'duplicate_id' AS rule FROM m WHERE n > 1 UNION ALL SELECT asset_id, event_id, 'beyond_duration' FROM m WHERE start_ms // 1000 * 1000 >= duration_ms
UNION ALL SELECT DISTINCT asset_id, NULL::BIGINT, 'no_candidate' FROM b_points WHERE asset_id NOT IN (SELECT asset_id FROM b_event WHERE event_id % 3 = 0)""")
def _v3t(events, points):
    return S.moment_violations(_listed(events), ordered=False).unionByName(S.empty_maps(points, events.where("event_id % 3 = 0")), allowMissingColumns=True)


@query("v23_echo_checks", "b_points", sql="""
SELECT event_id, field, expected, actual FROM (
SELECT event_id, 'asset_id' AS field, asset_id::VARCHAR AS expected, (asset_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END)::VARCHAR AS actual FROM b_points
UNION ALL SELECT event_id, 'duration_ms', duration_ms::VARCHAR, CASE WHEN event_id % 13 <> 0 THEN duration_ms END::VARCHAR FROM b_points) WHERE expected IS DISTINCT FROM actual""")
def _v23(points):
    answers = points.select("event_id", (F.col("asset_id") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("asset_id"), F.when(F.col("event_id") % 13 != 0, F.col("duration_ms")).alias("duration_ms"))
    return S.echo_mismatches(answers, points, ["event_id"], ["asset_id", "duration_ms"])
