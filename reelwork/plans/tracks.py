"""Track samples, agreement and crop paths (view d)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import tracks as T
from reelwork.operators.compare import box
from reelwork.plans.base import query

_W = "PARTITION BY track_id ORDER BY sample_index"
_STATE = f"""
, parts AS (SELECT *, sample_index >= seed_index AS part FROM d_sample)
, pos AS (SELECT *, list_sort(list(area_ratio) OVER h) AS recent, sqrt(((x_min + x_max) / 2 - lag((x_min + x_max) / 2) OVER o) ** 2 + ((y_min + y_max) / 2 - lag((y_min + y_max) / 2) OVER o) ** 2) AS moved
    FROM parts WHERE area_ratio > 0 WINDOW h AS (PARTITION BY track_id, part ORDER BY sample_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY track_id, part ORDER BY sample_index))
, gates AS (SELECT *, area_ratio / recent[len(recent) // 2 + 1] AS ratio FROM pos)
, marked AS (SELECT *, coalesce(ratio < 0.4 OR ratio > 2.5, false) AS area_jump, coalesce(moved > 220, false) AS center_jump, components > 4 AS fragmented, probability < 0.6 AS weak FROM gates)
, stated AS (SELECT track_id, sample_index, t_ms, area_ratio, components, probability, x_min, y_min, x_max, y_max, seed_index,
    CASE WHEN area_jump OR center_jump THEN 'drift_suspected' WHEN fragmented OR weak THEN 'low_confidence' ELSE 'tracked' END AS state,
    CASE WHEN area_jump OR center_jump OR fragmented OR weak THEN concat_ws(',', CASE WHEN area_jump THEN 'mask_area_jump' END, CASE WHEN center_jump THEN 'center_jump' END, CASE WHEN fragmented THEN 'mask_fragmented' END, CASE WHEN weak THEN 'weak_positive' END) ELSE 'geometry_gates_passed' END AS reasons FROM marked
    UNION ALL SELECT track_id, sample_index, t_ms, area_ratio, components, probability, x_min, y_min, x_max, y_max, seed_index, 'lost', 'mask_empty' FROM parts WHERE NOT area_ratio > 0)"""
_IDENTITY = "CASE WHEN sample_index = seed_index THEN 'seed' WHEN state IN ('drift_suspected', 'lost') THEN 'revalidation_required' ELSE 'not_revalidated' END"
_TOUCH = "(x_min <= 5 OR y_min <= 5 OR x_max >= 995 OR y_max >= 995)"


_CUT = "sample_index % 50 = 49"


@query("w3_track_state", "d_sample", sql=_STATE + f"""
SELECT track_id, sample_index, CASE WHEN state <> 'lost' AND {_CUT} THEN 'drift_suspected' ELSE state END AS state,
    CASE WHEN state <> 'lost' AND {_CUT} THEN 'shot_boundary_requires_new_seed' || CASE WHEN reasons = 'geometry_gates_passed' THEN '' ELSE ',' || reasons END ELSE reasons END AS reasons FROM stated""")
def _w3(samples):
    return T.track_states(samples.withColumn("shot_boundary", F.expr(_CUT))).select("track_id", "sample_index", "state", F.array_join("reasons", ",").alias("reasons"))


@query("w4_identity_status", "d_sample", sql=_STATE + f" SELECT track_id, sample_index, {_IDENTITY} AS identity_status FROM stated")
def _w4(samples):
    return T.track_states(samples).select("track_id", "sample_index", T.identity_status().alias("identity_status"))


_REASONS = _STATE + f"""
, s AS (SELECT *, CASE WHEN sample_index % 37 = 5 THEN 'revalidation_failed' ELSE {_IDENTITY} END AS status, sample_index % 50 = 49 AS shot_boundary, count(*) OVER (PARTITION BY track_id) AS n, row_number() OVER w - 1 AS place, lag(state) OVER w AS before, lag(area_ratio) OVER w AS area,
    sqrt(((x_min + x_max) / 2 - lag((x_min + x_max) / 2) OVER w) ** 2 + ((y_min + y_max) / 2 - lag((y_min + y_max) / 2) OVER w) ** 2) / 1000 AS moved FROM stated WINDOW w AS ({_W}))
, reasons AS (SELECT track_id, sample_index, seed_index, 25 AS priority, 'track_start' AS reason FROM s WHERE place = 0 UNION ALL SELECT track_id, sample_index, seed_index, 20, 'track_midpoint' FROM s WHERE place = n // 2
    UNION ALL SELECT track_id, sample_index, seed_index, 30, 'track_end' FROM s WHERE place = n - 1 UNION ALL SELECT track_id, sample_index, seed_index, 100, 'shot_boundary' FROM s WHERE place > 0 AND shot_boundary
    UNION ALL SELECT track_id, sample_index, seed_index, 98, 'semantic_revalidation_failed' FROM s WHERE place > 0 AND status = 'revalidation_failed'
    UNION ALL SELECT track_id, sample_index, seed_index, 95, 'semantic_revalidation_required' FROM s WHERE place > 0 AND status = 'revalidation_required' UNION ALL SELECT track_id, sample_index, seed_index, 92, 'drift_suspected' FROM s WHERE place > 0 AND state = 'drift_suspected'
    UNION ALL SELECT track_id, sample_index, seed_index, 90, 'post_occlusion_reappearance' FROM s WHERE place > 0 AND before = 'lost' AND state <> 'lost' UNION ALL SELECT track_id, sample_index, seed_index, 80, 'low_confidence' FROM s WHERE place > 0 AND state = 'low_confidence'
    UNION ALL SELECT track_id, sample_index, seed_index, 75, 'geometry_area_jump' FROM s WHERE place > 0 AND area_ratio > 0 AND area > 0 AND abs(area_ratio - area) / greatest(area, 1e-9) >= 0.6
    UNION ALL SELECT track_id, sample_index, seed_index, 75, 'geometry_center_jump' FROM s WHERE place > 0 AND area_ratio > 0 AND area > 0 AND moved >= 0.18)
, merged AS (SELECT track_id, sample_index, seed_index, max(priority)::BIGINT AS priority, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM reasons GROUP BY ALL)"""


def _bounded(samples):
    return T.track_states(samples).withColumns({"shot_boundary": F.col("sample_index") % 50 == 49, "checked_status": F.when(F.col("sample_index") % 37 == 5, "revalidation_failed")})


@query("a19_checkpoint_reasons", "d_sample", sql=_REASONS + " SELECT track_id, sample_index, priority, reasons FROM merged")
def _a19(samples):
    return T.merged_reasons(T.checkpoint_reasons(_bounded(samples))).select("track_id", "sample_index", "priority", F.array_join("reasons", ",").alias("reasons"))


@query("w5_checkpoint_plan", "d_sample", sql=_REASONS + " SELECT track_id, sample_index, priority, reasons, place, place <= 3 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY priority DESC, sample_index) AS place FROM merged WHERE sample_index <> seed_index)")
def _w5(samples):
    return T.checkpoint_plan(_bounded(samples), 3).withColumn("reasons", F.array_join("reasons", ","))


@query("v25_checkpoint_plan", "d_sample", sql=_REASONS + " SELECT track_id, 'under_budget' AS rule FROM (SELECT track_id, count(*) AS n FROM merged WHERE sample_index <> seed_index GROUP BY track_id) WHERE least(n, 2) < least(n, 3)")
def _v25(samples):
    return T.checkpoint_plan_violations(T.checkpoint_plan(_bounded(samples), 2), 3)


@query("p3_usable_samples", "d_sample", sql=_STATE + " SELECT track_id, sample_index, (t_ms - first_ms) / 1000 AS seconds FROM (SELECT *, min(t_ms) OVER (PARTITION BY track_id) AS first_ms FROM stated) WHERE state = 'tracked'")
def _p3(samples):
    return T.usable_samples(T.track_states(samples)).select("track_id", "sample_index", "seconds")


@query("a9_track_confidence", "d_sample", sql=_STATE + " SELECT track_id, count(*) AS samples, count(*) FILTER (WHERE state = 'low_confidence') AS low_confidence, round(count(*) FILTER (WHERE state = 'low_confidence') / count(*), 6) AS ratio, count(*) FILTER (WHERE state = 'low_confidence') = 0 AS passed FROM stated GROUP BY track_id")
def _a9(samples):
    return T.track_confidence(T.track_states(samples))


@query("a10_state_counts", "d_sample", sql=_STATE + " SELECT track_id, state, count(*) AS n FROM stated GROUP BY ALL")
def _a10(samples):
    return T.state_counts(T.track_states(samples))


@query("a10_state_count_mismatches", "d_sample", sql=_STATE + """
, c AS (SELECT track_id, state, count(*) AS n FROM stated GROUP BY ALL), d AS (SELECT track_id, state, n + CASE WHEN track_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM c WHERE NOT (track_id % 11 = 0 AND state = 'lost'))
SELECT coalesce(c.track_id, d.track_id) AS track_id, coalesce(c.state, d.state) AS state, d.n AS expected, c.n AS actual FROM c FULL JOIN d ON c.track_id = d.track_id AND c.state = d.state WHERE c.n IS DISTINCT FROM d.n""")
def _a10m(samples):
    stated = T.track_states(samples)
    declared = T.state_counts(stated).where("NOT (track_id % 11 = 0 AND state = 'lost')").withColumn("n", F.col("n") + F.when(F.col("track_id") % 7 == 0, 1).otherwise(0))
    return T.state_count_mismatches(stated, declared)


@query("a11_coverage_gate", "d_sample", sql=_STATE + """
, u AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY track_id ORDER BY t_ms) AS gap FROM stated WHERE state = 'tracked'), inner_gap AS (SELECT track_id, coalesce(max(gap), 0) AS internal_gap_ms FROM u GROUP BY track_id)
, g AS (SELECT track_id, count(*) AS expected, count(*) FILTER (WHERE state = 'tracked') AS common, min(t_ms) AS a, max(t_ms) AS b, min(t_ms) FILTER (WHERE state = 'tracked') AS u, max(t_ms) FILTER (WHERE state = 'tracked') AS v FROM stated GROUP BY track_id)
, r AS (SELECT track_id, expected, common, round(1 - common / expected, 6) AS unavailable_ratio, coalesce(u - a, b - a) AS head_gap_ms, coalesce(b - v, b - a) AS tail_gap_ms, coalesce(internal_gap_ms, 0) AS internal_gap_ms FROM g LEFT JOIN inner_gap USING (track_id))
SELECT *, common >= 2 AND unavailable_ratio <= 0.20 AND head_gap_ms <= 86400000 * 1.35 + 35 AND tail_gap_ms <= 86400000 * 1.35 + 35 AND internal_gap_ms <= 86400000 * 2.25 + 35 AS passed FROM r""")
def _a11(samples):
    return T.coverage_gate(T.track_states(samples).withColumn("usable", F.col("state") == "tracked"), 86_400_000)


@query("a12_track_dimensions", "d_sample", sql="""
, t AS (SELECT track_id, track_id % 10 AS series, 1920 AS source_width, CASE WHEN track_id % 30 = 0 THEN 1088 ELSE 1080 END AS source_height, 960 AS width, 540 + track_id % 3 AS height FROM d_sample GROUP BY track_id)
, g AS (SELECT series, count(DISTINCT (source_width, source_height)) AS sizes, round(max(abs(width / height / (source_width / source_height) - 1)), 9) AS aspect_error, min(least(width, height)) AS side FROM t GROUP BY series)
SELECT series, sizes, aspect_error, sizes = 1 AND aspect_error <= greatest(0.01, 2 / side) AS passed FROM g""")
def _a12(samples):
    t = samples.select("track_id").distinct()
    rows = t.select((F.col("track_id") % 10).alias("series"), F.lit(1920).alias("source_width"), F.when(F.col("track_id") % 30 == 0, 1088).otherwise(1080).alias("source_height"), F.lit(960).alias("width"), (540 + F.col("track_id") % 3).alias("height"))
    return T.dimension_check(rows)


@query("a13_target_summary", "d_sample", sql="""
, g AS (SELECT track_id, count(*) FILTER (WHERE area_ratio <= 0) AS empty, min(area_ratio) AS a, max(area_ratio) AS b, max(CASE WHEN sample_index = seed_index THEN area_ratio END) AS s FROM d_sample GROUP BY track_id)
SELECT track_id, empty, round(a, 6) AS min_area, round(b, 6) AS max_area, round(s, 6) AS seed_area, round(CASE WHEN s > 0 THEN a / s END, 6) AS min_over_seed, round(CASE WHEN s > 0 THEN b / s END, 6) AS max_over_seed FROM g""")
def _a13(samples):
    return T.target_summary(samples)


_RUNS = "SELECT track_id AS mask, event_y AS y, x_min AS x, 1 + components * 10 AS length FROM (SELECT *, y_min % 540 AS event_y FROM d_sample)"


@query("a21_mask_box", "d_sample", sql=f"""
, runs AS ({_RUNS}), g AS (SELECT mask, sum(length)::BIGINT AS area, min(x) AS l, min(y) AS t, max(x + length) AS r, max(y) + 1 AS b FROM runs GROUP BY mask)
, n AS (SELECT mask, area, round(area / (960 * 540), 9) AS ratio, round_even(l * 1000 / 960, 0)::BIGINT AS x0, round_even(t * 1000 / 540, 0)::BIGINT AS y0, round_even(r * 1000 / 960, 0)::BIGINT AS x1, round_even(b * 1000 / 540, 0)::BIGINT AS y1 FROM g)
SELECT mask, area, ratio, x0, y0, greatest(x1, x0 + 1) AS x1, greatest(y1, y0 + 1) AS y1 FROM n""")
def _a21(samples):
    runs = samples.select(F.col("track_id").alias("mask"), (F.col("y_min") % 540).alias("y"), F.col("x_min").alias("x"), (1 + F.col("components") * 10).alias("length"))
    return T.mask_boxes(runs, 960, 540)


_HASHES = ", hashes AS (SELECT track_id, track_id % 10 AS series, sha256(string_agg(concat(sample_index, ':', t_ms), '|' ORDER BY sample_index)) AS track_hash FROM d_sample GROUP BY track_id)"


def _hashes(samples):
    ordered = F.array_sort(F.collect_list(F.struct("sample_index", "t_ms")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["sample_index"].cast("string"), x["t_ms"].cast("string"))), "|")
    return samples.groupBy("track_id").agg(F.sha2(text, 256).alias("track_hash")).withColumn("series", F.col("track_id") % 10)


@query("a22_multi_region_fingerprint", "d_sample", sql=_HASHES + " SELECT series, sha256(string_agg(concat(track_id, ':', track_hash), '|' ORDER BY track_id)) AS fingerprint FROM hashes GROUP BY series")
def _a22(samples):
    return T.region_fingerprint(_hashes(samples).withColumnRenamed("track_id", "region"))


@query("j17_resolve_tracks", "d_sample", sql=_HASHES + """
, tracks AS (SELECT track_id, CASE WHEN track_id % 9 = 0 THEN 'same' ELSE track_hash END AS track_hash FROM hashes), renders AS (SELECT track_id AS render_id, CASE WHEN track_id % 4 = 0 THEN 'none' WHEN track_id % 9 = 0 THEN 'same' ELSE track_hash END AS track_hash FROM hashes)
, t AS (SELECT track_hash, count(*) AS n, min(track_id) AS track_id FROM tracks GROUP BY track_hash)
SELECT render_id, CASE WHEN n = 1 THEN track_id END AS track_id, CASE WHEN n IS NULL THEN 'no_track' WHEN n > 1 THEN 'several_tracks' END AS rule FROM renders LEFT JOIN t USING (track_hash)""")
def _j17(samples):
    h = _hashes(samples)
    same = F.when(F.col("track_id") % 9 == 0, "same").otherwise(F.col("track_hash"))
    tracks = h.select("track_id", same.alias("track_hash"))
    renders = h.select(F.col("track_id").alias("render_id"), F.when(F.col("track_id") % 4 == 0, "none").otherwise(same).alias("track_hash"))
    return T.resolve_by_fingerprint(renders, tracks)


@query("w11_monotone_checks", "d_sample", sql=f"""
, s AS (SELECT track_id, sample_index + CASE WHEN sample_index > 30 THEN 1 ELSE 0 END AS sample_index, t_ms - CASE WHEN sample_index % 40 = 39 THEN 900000000 ELSE 0 END AS t_ms FROM d_sample), o AS (SELECT *, lag(t_ms) OVER w AS before, row_number() OVER w - 1 AS place FROM s WINDOW w AS ({_W}))
SELECT track_id, sample_index, 'time_not_increasing' AS rule FROM o WHERE t_ms <= before UNION ALL SELECT track_id, sample_index, 'index_gap' FROM o WHERE sample_index <> place""")
def _w11(samples):
    s = samples.select("track_id", (F.col("sample_index") + F.when(F.col("sample_index") > 30, 1).otherwise(0)).alias("sample_index"), (F.col("t_ms") - F.when(F.col("sample_index") % 40 == 39, 900_000_000).otherwise(0)).alias("t_ms"))
    return T.monotone_violations(s)


_SEEN = "SELECT track_id, sample_index, unnest(CASE WHEN sample_index < seed_index THEN ['reverse'] WHEN sample_index > seed_index THEN ['forward'] ELSE ['forward', 'prompt', 'reverse'] END) AS direction FROM d_sample"


@query("w16_direction_coverage", "d_sample", sql=f"""
, observed AS (SELECT track_id, sample_index + CASE WHEN sample_index % 60 = 59 THEN 100000 ELSE 0 END AS sample_index, CASE WHEN sample_index % 45 = 44 THEN 'reverse' ELSE direction END AS direction FROM ({_SEEN}) WHERE sample_index % 50 <> 49)
, seen AS (SELECT track_id, sample_index, list_sort(list(DISTINCT direction)) AS got, count(*) AS n FROM observed GROUP BY ALL), expected AS (SELECT track_id, sample_index, list(direction ORDER BY direction) AS directions FROM ({_SEEN}) GROUP BY ALL)
SELECT track_id, sample_index, rule FROM (SELECT coalesce(e.track_id, s.track_id) AS track_id, coalesce(e.sample_index, s.sample_index) AS sample_index,
    CASE WHEN directions IS NULL THEN 'out_of_range' WHEN got IS NULL THEN 'missing' WHEN n > len(got) THEN 'duplicate' WHEN got <> directions THEN 'wrong_direction' END AS rule FROM expected e FULL JOIN seen s ON e.track_id = s.track_id AND e.sample_index = s.sample_index) WHERE rule IS NOT NULL""")
def _w16(samples):
    expected = T.expected_directions(samples)
    seen = expected.select("track_id", "sample_index", F.explode("directions").alias("direction")).where("sample_index % 50 <> 49")
    observed = seen.select("track_id", (F.col("sample_index") + F.when(F.col("sample_index") % 60 == 59, 100_000).otherwise(0)).alias("sample_index"), F.when(F.col("sample_index") % 45 == 44, "reverse").otherwise(F.col("direction")).alias("direction"))
    return T.direction_coverage(expected, observed)


@query("w17_accepted_prefix", "d_sample", sql="""
, s AS (SELECT *, sample_index >= seed_index AS side, (area_ratio <= 0)::INT AS bad FROM d_sample)
, m AS (SELECT *, CASE WHEN side THEN max(bad) OVER (PARTITION BY track_id, side ORDER BY sample_index) ELSE max(bad) OVER (PARTITION BY track_id, side ORDER BY sample_index DESC) END AS hit FROM s)
SELECT track_id, count(*) FILTER (WHERE hit = 0) AS accepted, count(*) AS total, round(count(*) FILTER (WHERE hit = 0) / count(*), 6) AS coverage FROM m GROUP BY track_id""")
def _w17(samples):
    return T.accepted_prefix(samples, F.col("area_ratio") <= 0)


@query("j7_nearest_sample", "d_sample", sql="""
, refs AS (SELECT track_id, t_ms + 1000 AS reference_ms FROM d_sample WHERE sample_index % 10 = 0)
, ranked AS (SELECT s.track_id, sample_index, reference_ms, abs(t_ms - reference_ms) AS gap_ms, row_number() OVER (PARTITION BY s.track_id, sample_index ORDER BY abs(t_ms - reference_ms), reference_ms) AS rn FROM d_sample s JOIN refs r ON s.track_id = r.track_id)
SELECT track_id, sample_index, reference_ms, gap_ms FROM ranked WHERE rn = 1""")
def _j7(samples):
    refs = samples.where("sample_index % 10 = 0").select("track_id", (F.col("t_ms") + 1000).alias("reference_ms"), F.col("sample_index").alias("reference_id"))
    return T.nearest(samples.select("track_id", "sample_index", "t_ms"), refs, "track_id").select("track_id", "sample_index", "reference_ms", "gap_ms")


_OTHER = ", other AS (SELECT track_id - 1 AS track_id, sample_index, t_ms, area_ratio, state, x_min, y_min, x_max, y_max FROM stated WHERE track_id > 1)"


def _pairs(samples):
    stated = T.track_states(samples)
    columns = ["track_id", "sample_index", "t_ms", "area_ratio", "state", "x_min", "y_min", "x_max", "y_max"]
    return T.aligned(stated.select(*columns), stated.where("track_id > 1").withColumn("track_id", F.col("track_id") - 1).select(*columns))


@query("j8_align_tracks", "d_sample", sql="""
, a AS (SELECT track_id, sample_index, t_ms, t_ms * 90 AS pts FROM d_sample), b AS (SELECT track_id, sample_index, t_ms + CASE WHEN sample_index % 97 = 3 THEN 1 ELSE 0 END AS t_ms, pts + CASE WHEN sample_index % 89 = 3 THEN 1 ELSE 0 END AS pts FROM a WHERE sample_index % 101 <> 5)
SELECT a.track_id, a.sample_index, CASE WHEN b.t_ms IS NULL THEN 'unmatched' WHEN a.t_ms <> b.t_ms THEN 'time_differs' ELSE 'pts_differs' END AS rule FROM a LEFT JOIN b USING (track_id, sample_index) WHERE b.t_ms IS NULL OR a.t_ms <> b.t_ms OR a.pts <> b.pts""")
def _j8(samples):
    a = samples.select("track_id", "sample_index", "t_ms", (F.col("t_ms") * 90).alias("source_pts"))
    late = lambda c, n: F.col(c) + F.when(F.col("sample_index") % n == 3, 1).otherwise(0)
    return T.alignment_violations(T.aligned(a, a.where("sample_index % 101 <> 5").withColumns({"t_ms": late("t_ms", 97), "source_pts": late("source_pts", 89)})))


@query("j8_series", "d_sample", sql="""
, s AS (SELECT track_id, sample_index, t_ms, CASE WHEN sample_index % 71 <> 8 THEN t_ms * 90 + CASE WHEN sample_index % 53 = 7 THEN 90000000000 ELSE 0 END END AS pts FROM d_sample WHERE track_id % 9 <> 2 OR sample_index <> 4)
, x AS (SELECT *, row_number() OVER w - 1 AS place, lag(t_ms) OVER w AS before_ms, lag(pts) OVER w AS before_pts FROM s WINDOW w AS (PARTITION BY track_id ORDER BY sample_index))
SELECT track_id, sample_index, 'no_pts' AS rule FROM x WHERE pts IS NULL UNION ALL SELECT track_id, sample_index, 'index_not_contiguous' FROM x WHERE place <> sample_index UNION ALL SELECT track_id, sample_index, 'times_not_rising' FROM x WHERE before_ms >= t_ms UNION ALL SELECT track_id, sample_index, 'pts_not_rising' FROM x WHERE before_pts >= pts""")
def _j8s(samples):
    pts = F.when(F.col("sample_index") % 71 != 8, F.col("t_ms") * 90 + F.when(F.col("sample_index") % 53 == 7, 90_000_000_000).otherwise(0))
    return T.series_violations(samples.where("track_id % 9 <> 2 OR sample_index <> 4").select("track_id", "sample_index", "t_ms", pts.alias("source_pts")))


@query("j9_common_time_union", "d_sample", sql=_STATE + """
, r AS (SELECT track_id // 2 AS series, track_id % 2 AS region, sample_index AS t_ms, x_min, y_min, x_max, y_max FROM stated WHERE state = 'tracked')
SELECT series, t_ms, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM r GROUP BY ALL HAVING count(DISTINCT region) = 2""")
def _j9(samples):
    r = T.track_states(samples).where("state = 'tracked'").select(F.floor(F.col("track_id") / 2).alias("series"), (F.col("track_id") % 2).alias("region"), F.col("sample_index").alias("t_ms"), "x_min", "y_min", "x_max", "y_max")
    return T.common_union(r, 2)


_AGREE = _STATE + _OTHER + """
, p AS (SELECT a.track_id, a.state = b.state AS same, a.area_ratio > 0 AND b.area_ratio > 0 AS ok, greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) AS i,
    (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) AS s, sqrt(((a.x_min + a.x_max) / 2 - (b.x_min + b.x_max) / 2) ** 2 + ((a.y_min + a.y_max) / 2 - (b.y_min + b.y_max) / 2) ** 2) AS d
    FROM stated a JOIN other b ON a.track_id = b.track_id AND a.sample_index = b.sample_index)
, m AS (SELECT track_id, same, CASE WHEN ok THEN i / (s - i) END AS iou, CASE WHEN ok THEN d END AS distance FROM p)
SELECT track_id, count(*) AS samples, count(iou) AS comparable, round(avg(iou), 6) AS mean_iou, round(min(iou), 6) AS min_iou, round(max(iou), 6) AS max_iou, round(avg(distance), 6) AS mean_distance, round(avg(same::INT), 6) AS state_agreement FROM m GROUP BY track_id"""


@query("c6_compare_tracks_aligned", "d_sample", sql=_AGREE)
def _c6(samples):
    return T.agreement_report(T.with_agreement(_pairs(samples).where("left_t_ms IS NOT NULL AND right_t_ms IS NOT NULL")))


@query("a14_agreement_report", "d_sample", sql=_AGREE.replace("SELECT track_id, count(*)", "SELECT track_id % 5 AS series, count(*)").replace("GROUP BY track_id", "GROUP BY track_id % 5"))
def _a14(samples):
    pairs = T.with_agreement(_pairs(samples).where("left_t_ms IS NOT NULL AND right_t_ms IS NOT NULL"))
    return T.agreement_report(pairs.withColumn("series", F.col("track_id") % 5), "series")


@query("c7_compare_track_to_reference", "d_sample", sql="""
, refs AS (SELECT track_id, t_ms + 1000 AS reference_ms, x_min + 10 AS rx0, y_min + 10 AS ry0, x_max + 10 AS rx1, y_max + 10 AS ry1 FROM d_sample WHERE sample_index % 10 = 0)
, ranked AS (SELECT s.*, r.* EXCLUDE (track_id), row_number() OVER (PARTITION BY s.track_id, sample_index ORDER BY abs(t_ms - reference_ms), reference_ms) AS rn FROM d_sample s JOIN refs r ON s.track_id = r.track_id)
, i AS (SELECT *, greatest(0, least(x_max, rx1) - greatest(x_min, rx0)) * greatest(0, least(y_max, ry1) - greatest(y_min, ry0)) AS i FROM ranked WHERE rn = 1)
SELECT track_id, count(*) AS samples, round(avg(i / ((x_max - x_min) * (y_max - y_min) + (rx1 - rx0) * (ry1 - ry0) - i)), 6) AS mean_iou FROM i GROUP BY track_id""")
def _c7(samples):
    from reelwork.functions.geometry import iou

    refs = samples.where("sample_index % 10 = 0").select("track_id", (F.col("t_ms") + 1000).alias("reference_ms"), F.col("sample_index").alias("reference_id"))
    boxes = samples.where("sample_index % 10 = 0").select("track_id", (F.col("t_ms") + 1000).alias("reference_ms"), *[(F.col(c) + 10).alias(f"r_{c}") for c in ("x_min", "y_min", "x_max", "y_max")])
    near = T.nearest(samples, refs, "track_id").join(boxes, ["track_id", "reference_ms"])
    return near.groupBy("track_id").agg(F.count("*").alias("samples"), F.round(F.avg(iou(box(), box("r_"))), 6).alias("mean_iou"))


@query("f27_mask_iou", "d_sample", sql="""
, w AS (SELECT track_id, sample_index, [area_word, x_min * 7919, y_min * 104729] AS a, [x_max * 7919, x_min * 7919, y_max * 104729] AS b FROM (SELECT *, components * 1299709 AS area_word FROM d_sample))
, c AS (SELECT track_id, sample_index, bit_count(a[1] & b[1]) + bit_count(a[2] & b[2]) + bit_count(a[3] & b[3]) AS i, bit_count(a[1] | b[1]) + bit_count(a[2] | b[2]) + bit_count(a[3] | b[3]) AS u FROM w)
SELECT track_id, sample_index, round(CASE WHEN u > 0 THEN i / u END, 6) AS iou FROM c""")
def _f27(samples):
    a = F.array(F.col("components") * 1299709, F.col("x_min") * 7919, F.col("y_min") * 104729)
    b = F.array(F.col("x_max") * 7919, F.col("x_min") * 7919, F.col("y_max") * 104729)
    return samples.select("track_id", "sample_index", F.round(T.mask_iou(a, b), 6).alias("iou"))


_BOXED = "area_ratio > 0 OR sample_index % 5 = 0"
_FILED = "(area_ratio > 0 AND sample_index % 11 <> 0) OR (area_ratio = 0 AND sample_index % 7 = 0)"


@query("v9_samples", "d_sample", sql=f"""
, s AS (SELECT track_id, sample_index, area_ratio, probability + CASE WHEN sample_index % 43 = 1 THEN 1 ELSE 0 END AS p, CASE WHEN {_BOXED} THEN x_min END AS x0, CASE WHEN sample_index % 31 = 2 THEN x_min ELSE x_max END AS x1, {_FILED} AS filed, CASE WHEN area_ratio > 0 OR sample_index % 13 = 0 THEN 'tracked' ELSE 'lost' END AS state FROM d_sample)
SELECT track_id, sample_index, 'area_over_one' AS rule FROM s WHERE area_ratio > 1 UNION ALL SELECT track_id, sample_index, 'negative_area' FROM s WHERE area_ratio < 0 UNION ALL SELECT track_id, sample_index, 'probability_range' FROM s WHERE p < 0 OR p > 1 UNION ALL SELECT track_id, sample_index, 'empty_box' FROM s WHERE x0 >= x1
UNION ALL SELECT track_id, sample_index, 'geometry_of_empty_mask' FROM s WHERE area_ratio = 0 AND x0 IS NOT NULL UNION ALL SELECT track_id, sample_index, 'file_of_empty_mask' FROM s WHERE area_ratio = 0 AND filed UNION ALL SELECT track_id, sample_index, 'empty_not_lost' FROM s WHERE area_ratio = 0 AND state <> 'lost'
UNION ALL SELECT track_id, sample_index, 'mask_file_missing' FROM s WHERE area_ratio <> 0 AND NOT filed""")
def _v9(samples):
    boxed = {c: F.when(F.expr(_BOXED), F.col(c)) for c in ("x_min", "y_min", "y_max")}
    x_max = F.when(F.expr(_BOXED), F.when(F.col("sample_index") % 31 == 2, F.col("x_min")).otherwise(F.col("x_max")))
    given = {"probability": F.col("probability") + F.when(F.col("sample_index") % 43 == 1, 1).otherwise(0), "mask_sha256": F.when(F.expr(_FILED), "file"), "state": F.when((F.col("area_ratio") > 0) | (F.col("sample_index") % 13 == 0), "tracked").otherwise("lost")}
    return T.sample_violations(samples.withColumns(given | boxed | {"x_max": x_max}))


@query("v10_session_manifest", "d_sample", sql="""
, m AS (SELECT track_id, count(*) + CASE WHEN track_id % 6 = 0 THEN 1 ELSE 0 END AS samples, 20 + CASE WHEN track_id % 8 = 0 THEN 1 ELSE 0 END AS declared_seed, count(*) AS n FROM d_sample GROUP BY track_id)
SELECT track_id, 'sample_count' AS rule FROM m WHERE samples <> n UNION ALL SELECT track_id, 'seed_frame' FROM m WHERE declared_seed <> 20""")
def _v10(samples):
    m = samples.groupBy("track_id").agg(F.count("*").alias("n")).select("track_id", (F.col("n") + F.when(F.col("track_id") % 6 == 0, 1).otherwise(0)).alias("samples"), (20 + F.when(F.col("track_id") % 8 == 0, 1).otherwise(0)).alias("declared_seed"))
    return T.session_violations(samples, m)


_HEAD_COUNTS = "count(*) FILTER (WHERE state = 'lost') AS lost, count(*) FILTER (WHERE state = 'drift_suspected') AS drift_suspected, count(*) FILTER (WHERE state = 'low_confidence') AS low_confidence, count(*) FILTER (WHERE state = 'tracked') AS tracked, count(*) AS n, max(t_ms) AS last_ms, min(t_ms) AS first_ms"
# what a track declares, made of its true counts; in SQL that Spark and DuckDB share
_HEAD = {
    "total_samples": "n + CASE WHEN track_id % 31 = 1 THEN 1 ELSE 0 END", "tracked": "tracked + CASE WHEN track_id % 29 = 2 THEN 1 ELSE 0 END", "seed_index": "CASE WHEN track_id % 37 = 3 THEN 100000 ELSE 20 END", "seed_ms": "first_ms + CASE WHEN track_id % 23 = 4 THEN -1 ELSE 5 END",
    "seed_pts": "CASE WHEN track_id % 4 <> 0 THEN seed_there * 90 + CASE WHEN track_id % 19 = 5 THEN 1 ELSE 0 END END", "seed_sha256": "CASE WHEN track_id % 4 <> 0 OR track_id % 8 = 0 THEN 'hash' END", "seed_width": "CASE WHEN track_id % 4 <> 0 THEN 1920 END", "seed_height": "CASE WHEN track_id % 4 <> 0 THEN 1080 END",
    "target_id": "CASE WHEN track_id % 17 <> 6 THEN 't' END", "session_id": "'s'", "manifest_sha256": "'m'", "start_ms": "first_ms", "end_ms": "CASE WHEN track_id % 5 = 0 THEN NULL WHEN track_id % 41 = 7 THEN first_ms WHEN track_id % 43 = 8 THEN last_ms ELSE last_ms + 1 END",
    "start_pts": "CASE WHEN track_id % 47 <> 9 THEN CASE WHEN track_id % 53 = 10 THEN 90 ELSE 0 END END", "tb_num": "1", "tb_den": "90000", "prompt_type": "CASE WHEN track_id % 3 = 0 THEN 'polygon' ELSE 'box' END", "prompt_box": "track_id % 3 <> 0 AND track_id % 14 <> 1 OR track_id % 15 = 0", "polygon_points": "CASE WHEN track_id % 3 = 0 THEN 2 + track_id % 2 WHEN track_id % 16 = 2 THEN 3 END",
}
_HEAD_SQL = ", ".join(f"{v} AS {k}" for k, v in _HEAD.items())


@query("v9_tracks", "d_sample", sql=_STATE + f"""
, timed AS (SELECT track_id, sample_index, t_ms, state, CASE WHEN track_id % 59 = 11 AND sample_index = 3 THEN 'other' ELSE 'decoded_source_pts' END AS timing_basis, t_ms * 90 AS source_pts FROM stated)
, c AS (SELECT track_id, {_HEAD_COUNTS}, max(CASE WHEN sample_index = 20 THEN t_ms END) AS seed_there FROM timed GROUP BY track_id)
, h AS (SELECT track_id, lost, drift_suspected, low_confidence, {_HEAD_SQL} FROM c)
, s AS (SELECT t.track_id, count(*) AS n, count(*) FILTER (WHERE state = 'tracked') AS n_tracked, count(DISTINCT timing_basis) AS bases, max(CASE WHEN sample_index = seed_index THEN source_pts END) AS pts_there, count(*) FILTER (WHERE timing_basis = 'decoded_source_pts' AND t_ms <> (source_pts - start_pts) // 90) AS untimed,
    count(*) FILTER (WHERE t_ms < start_ms OR t_ms >= end_ms) AS outside FROM timed t JOIN h USING (track_id) GROUP BY t.track_id)
, r AS (SELECT *, prompt_type = 'box' AS boxed FROM h JOIN s USING (track_id))
SELECT track_id, unnest(list_concat(CASE WHEN total_samples <> n THEN ['total_samples'] END, CASE WHEN lost + drift_suspected + low_confidence + tracked <> total_samples THEN ['counts_not_covering'] END, CASE WHEN tracked <> n_tracked THEN ['state_counts'] END, CASE WHEN seed_index >= total_samples THEN ['seed_outside'] END,
    CASE WHEN bases > 1 THEN ['several_timing_bases'] END, CASE WHEN seed_pts IS NULL AND seed_sha256 IS NOT NULL THEN ['half_seed_lineage'] WHEN seed_pts IS NULL AND seed_width IS NOT NULL THEN ['half_seed_lineage'] END, CASE WHEN target_id IS NULL THEN ['half_shared_identity'] END, CASE WHEN start_pts IS NULL THEN ['half_timing_lineage'] END,
    CASE WHEN seed_pts IS NOT NULL AND seed_pts IS DISTINCT FROM pts_there THEN ['seed_pts'] END, CASE WHEN untimed > 0 THEN ['times_not_of_pts'] END, CASE WHEN end_ms <= start_ms THEN ['empty_interval'] END, CASE WHEN seed_ms < start_ms OR seed_ms >= end_ms THEN ['seed_time_outside'] END, CASE WHEN outside > 0 AND end_ms IS NOT NULL THEN ['samples_outside'] END,
    CASE WHEN boxed AND NOT prompt_box THEN ['box_missing'] END, CASE WHEN boxed AND polygon_points IS NOT NULL THEN ['polygon_not_expected'] END, CASE WHEN NOT boxed AND prompt_box THEN ['box_not_expected'] END, CASE WHEN NOT boxed AND coalesce(polygon_points, 0) < 3 THEN ['polygon_points'] END)) AS rule FROM r""")
def _v9t(samples):
    basis = F.when((F.col("track_id") % 59 == 11) & (F.col("sample_index") == 3), "other").otherwise("decoded_source_pts")
    s = T.track_states(samples).select("track_id", "sample_index", "t_ms", "state", basis.alias("timing_basis"), (F.col("t_ms") * 90).alias("source_pts"))
    of = lambda x: F.count_if(F.col("state") == x).alias(x)
    c = s.groupBy("track_id").agg(of("lost"), of("drift_suspected"), of("low_confidence"), of("tracked"), F.count("*").alias("n"), F.max("t_ms").alias("last_ms"), F.min("t_ms").alias("first_ms"), F.max(F.when(F.col("sample_index") == 20, F.col("t_ms"))).alias("seed_there"))
    heads = c.selectExpr("track_id", "lost", "drift_suspected", "low_confidence", *[f"{v} AS {k}" for k, v in _HEAD.items()])
    return T.track_violations(heads, s)


@query("v10_shared_session", "d_sample", sql="""
, f AS (SELECT track_id AS session_id, sample_index + CASE WHEN track_id % 13 = 1 AND sample_index > 5 THEN 1 ELSE 0 END AS sample_index, t_ms + CASE WHEN track_id % 17 = 2 AND sample_index = 4 THEN 900000000 ELSE 0 END AS t_ms, (t_ms + CASE WHEN track_id % 19 = 3 AND sample_index = 4 THEN 900000000 ELSE 0 END) * 90 AS source_pts FROM d_sample)
, s AS (SELECT session_id, min(t_ms) AS start_ms, CASE WHEN session_id % 23 = 4 THEN min(t_ms) WHEN session_id % 29 = 5 THEN max(t_ms) ELSE max(t_ms) + 1 END AS end_ms, 2 + CASE WHEN session_id % 31 = 6 THEN 1 ELSE 0 END AS target_count, count(*) AS n FROM f GROUP BY session_id)
, t AS (SELECT session_id, unnest([0, 1]) AS k FROM s), targets AS (SELECT session_id, CASE WHEN session_id % 37 = 7 THEN 't' ELSE concat('t', k) END AS target_id, CASE WHEN session_id % 41 = 8 THEN 100000 ELSE 2 + k END AS seed_index, CASE WHEN session_id % 43 = 9 THEN 1 ELSE 0 END AS off_ms, CASE WHEN session_id % 47 = 10 THEN 1 ELSE 0 END AS off_pts,
    CASE WHEN session_id % 53 = 11 THEN [n + 1, -1] WHEN session_id % 7 = 5 THEN [n, 1] ELSE [n - 1, 1] END AS counts, n FROM t JOIN s USING (session_id))
, o AS (SELECT f.*, start_ms, end_ms, row_number() OVER w - 1 AS place, lag(f.t_ms) OVER w AS before_ms, lag(source_pts) OVER w AS before_pts FROM f JOIN s USING (session_id) WINDOW w AS (PARTITION BY f.session_id ORDER BY sample_index))
SELECT session_id, 'empty_interval' AS rule FROM s WHERE start_ms >= end_ms UNION ALL SELECT session_id, 'target_count' FROM s WHERE target_count <> 2 UNION ALL SELECT DISTINCT session_id, 'duplicate_target' FROM (SELECT session_id FROM targets GROUP BY session_id, target_id HAVING count(*) > 1)
UNION ALL SELECT DISTINCT session_id, 'index_not_contiguous' FROM o WHERE sample_index <> place UNION ALL SELECT DISTINCT session_id, 'times_not_rising' FROM o WHERE t_ms <= before_ms UNION ALL SELECT DISTINCT session_id, 'pts_not_rising' FROM o WHERE source_pts <= before_pts
UNION ALL SELECT DISTINCT session_id, 'times_not_of_pts' FROM o WHERE t_ms <> source_pts // 90 AND NOT (source_pts // 90 = end_ms AND t_ms = end_ms - 1) UNION ALL SELECT DISTINCT session_id, 'frames_outside' FROM o WHERE t_ms < start_ms OR t_ms >= end_ms
UNION ALL SELECT DISTINCT session_id, 'seed_outside' FROM targets WHERE (session_id, seed_index) NOT IN (SELECT (session_id, sample_index) FROM f) UNION ALL SELECT DISTINCT session_id, 'seed_pts' FROM targets SEMI JOIN f ON f.session_id = targets.session_id AND f.sample_index = seed_index WHERE off_pts > 0
UNION ALL SELECT DISTINCT session_id, 'seed_time' FROM targets SEMI JOIN f ON f.session_id = targets.session_id AND f.sample_index = seed_index WHERE off_ms > 0 UNION ALL SELECT DISTINCT session_id, 'negative_count' FROM targets WHERE counts[2] < 0 UNION ALL SELECT DISTINCT session_id, 'counts_not_covering' FROM targets WHERE counts[1] + counts[2] <> n""")
def _v10s(samples):
    i, k = F.col("track_id"), F.col("sample_index")
    late = lambda n, r: F.when((i % n == r) & (k == 4), 900_000_000).otherwise(0)
    f = samples.select(i.alias("session_id"), (k + F.when((i % 13 == 1) & (k > 5), 1).otherwise(0)).alias("sample_index"), (F.col("t_ms") + late(17, 2)).alias("t_ms"), ((F.col("t_ms") + late(19, 3)) * 90).alias("source_pts"))
    sid = F.col("session_id")
    g = f.groupBy("session_id").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("_last"), F.count("*").alias("n"))
    sessions = g.select("session_id", "start_ms", F.when(sid % 23 == 4, F.col("start_ms")).when(sid % 29 == 5, F.col("_last")).otherwise(F.col("_last") + 1).alias("end_ms"), (2 + F.when(sid % 31 == 6, 1).otherwise(0)).alias("target_count"), F.lit(0).alias("start_pts"), F.lit(1).alias("tb_num"), F.lit(90_000).alias("tb_den"))
    t = g.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seed_index", F.when(sid % 41 == 8, 100_000).otherwise(2 + F.col("k")))
    at = f.select("session_id", F.col("sample_index").alias("seed_index"), "t_ms", "source_pts")
    counts = F.when(sid % 53 == 11, F.array(F.col("n") + 1, F.lit(-1).cast("long"))).when(sid % 7 == 5, F.array(F.col("n"), F.lit(1).cast("long"))).otherwise(F.array(F.col("n") - 1, F.lit(1).cast("long")))
    targets = t.join(at, ["session_id", "seed_index"], "left").select(
        "session_id", F.when(sid % 37 == 7, "t").otherwise(F.concat(F.lit("t"), "k")).alias("target_id"), "seed_index", (F.coalesce("t_ms", F.lit(0)) + F.when(sid % 43 == 9, 1).otherwise(0)).alias("seed_ms"), (F.coalesce("source_pts", F.lit(0)) + F.when(sid % 47 == 10, 1).otherwise(0)).alias("seed_pts"), counts.alias("counts"),
    )
    return T.shared_session_violations(sessions, f, targets)
