"""Crop paths and whether they may be used (views d_sample and d_crop)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import crops as T
from reelwork.operators.compare import box
from reelwork.operators.rounds import cut_lineage
from reelwork.plans.base import query

_W = "PARTITION BY track_id ORDER BY sample_index"
_TOUCH = "(x_min <= 5 OR y_min <= 5 OR x_max >= 995 OR y_max >= 995)"


@query("j10_soft_extent_join", "d_sample", sql="""
, c AS (SELECT track_id, t_ms, (x_min + x_max) / 2 - 150 AS lft FROM d_sample), p AS (SELECT track_id, t_ms, x_min, x_max FROM d_sample WHERE sample_index % 3 <> 0)
SELECT c.track_id, c.t_ms, round(coalesce(greatest(0.0::DOUBLE, least(x_max, lft + 300) - greatest(x_min, lft)) / (x_max - x_min), 0), 6) AS visible FROM c LEFT JOIN p ON c.track_id = p.track_id AND c.t_ms = p.t_ms""")
def _j10(samples):
    crops = samples.select("track_id", "t_ms", (T.center("x") - 150).alias("left"))
    return T.soft_extent_visibility(crops, samples.where("sample_index % 3 <> 0"), 300.0)


def _smooth_sql(tag: str, source: str) -> str:
    """tag: source with smooth_x and smooth_y of want_x and want_y, one sample after the other."""
    return f"""
, {tag}_n AS MATERIALIZED (SELECT *, row_number() OVER ({_W}) AS place, count(*) OVER (PARTITION BY track_id) AS n FROM {source})
, {tag}_f AS (SELECT track_id, place, n, want_x::DOUBLE AS x, want_y::DOUBLE AS y FROM {tag}_n WHERE place = 1 UNION ALL SELECT n.track_id, n.place, n.n, 0.34::DOUBLE * n.want_x + 0.66::DOUBLE * f.x, 0.34::DOUBLE * n.want_y + 0.66::DOUBLE * f.y FROM {tag}_f f JOIN {tag}_n n ON n.track_id = f.track_id AND n.place = f.place + 1)
, {tag}_b AS (SELECT track_id, place, x, y FROM {tag}_f WHERE place = n UNION ALL SELECT f.track_id, f.place, 0.34::DOUBLE * f.x + 0.66::DOUBLE * b.x, 0.34::DOUBLE * f.y + 0.66::DOUBLE * b.y FROM {tag}_b b JOIN {tag}_f f ON f.track_id = b.track_id AND f.place = b.place - 1)
, {tag} AS (SELECT n.*, b.x AS smooth_x, b.y AS smooth_y FROM {tag}_n n JOIN {tag}_b b USING (track_id, place))"""


@query("w6_ema_smooth", "d_sample", sql=", c AS (SELECT track_id, sample_index, (x_min + x_max) / 2 AS want_x, (y_min + y_max) / 2 AS want_y FROM d_sample)" + _smooth_sql("e", "c") + " SELECT track_id, sample_index, round(smooth_x, 6) AS smoothed FROM e")
def _w6(samples):
    return T.ema_smooth(samples.withColumn("x", T.center("x")), {"x": "smoothed"}).select("track_id", "sample_index", F.round("smoothed", 6).alias("smoothed"))


def _rounds(n: int) -> str:
    out = ", s0 AS (SELECT track_id, sample_index, (x_min + x_max) / 2 - 250 AS d, 100.0::DOUBLE AS lo, 600.0::DOUBLE AS hi, greatest(100.0::DOUBLE, least(600.0::DOUBLE, (x_min + x_max) / 2 - 250)) AS v FROM d_sample)"
    for k in range(n):
        out += f"""
, m{k} AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s{k} WINDOW w AS ({_W}))
, s{k + 1} AS (SELECT track_id, sample_index, d, lo, hi, greatest(lo, least(hi, 0.58::DOUBLE * d + 0.42::DOUBLE * CASE WHEN a IS NULL AND b IS NULL THEN d WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END)) AS v FROM m{k})"""
    return out


@query("w7_projected_smooth", "d_sample", sql=_rounds(12) + " SELECT track_id, sample_index, round(v, 6) AS smoothed FROM s12")
def _w7(samples):
    s = samples.select("track_id", "sample_index", (T.center("x") - 250).alias("d"), F.lit(100.0).alias("lo"), F.lit(600.0).alias("hi"))
    return T.projected_smooth(s, ("d", "lo", "hi", "smoothed")).select("track_id", "sample_index", F.round("smoothed", 6).alias("smoothed"))


@query("w8_crop_kinematics", "d_sample", sql=f"""
, p AS (SELECT *, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y, t_ms / 1000 AS sec FROM d_sample)
, v AS (SELECT track_id, sample_index, greatest(0.001, sec - lag(sec) OVER w) AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS ({_W})), v2 AS (SELECT *, CASE WHEN dx IS NOT NULL THEN sqrt((dx / dt) ** 2 + (dy / dt) ** 2) END AS v FROM v)
, a AS (SELECT *, abs(v - lag(v) OVER ({_W})) / dt AS a FROM v2), j AS (SELECT *, abs(a - lag(a) OVER ({_W})) / dt AS j FROM a)
SELECT track_id, round(coalesce(max(v), 0), 6) AS max_speed, round(coalesce(max(a), 0), 6) AS max_acceleration, round(coalesce(max(j), 0), 6) AS max_jerk FROM j GROUP BY track_id""")
def _w8(samples):
    p = samples.select("track_id", "sample_index", T.center("x").alias("x"), T.center("y").alias("y"), (F.col("t_ms") / 1000).alias("sec"))
    return T.crop_kinematics(p, "x", "y", "sec")


@query("f12_cover_transform", "d_sample", sql="""
, s AS (SELECT DISTINCT track_id, 640 + track_id % 50 * 32 AS sw, 480 + track_id % 7 * 100 AS sh FROM d_sample), a AS (SELECT *, sw / sh AS aspect FROM s)
, b AS (SELECT *, CASE WHEN aspect >= 1080 / 1920 THEN greatest(2, ceil(1920 * 1.2::DOUBLE / 2) * 2) END AS th, CASE WHEN aspect < 1080 / 1920 THEN greatest(2, ceil(1080 * 1.2::DOUBLE / 2) * 2) END AS fw FROM a)
, c AS (SELECT track_id, coalesce(fw, greatest(2, ceil(th * aspect / 2) * 2))::BIGINT AS scaled_width, coalesce(th, greatest(2, ceil(fw / aspect / 2) * 2))::BIGINT AS scaled_height FROM b)
SELECT *, scaled_width > 1080 AS pan_x, scaled_height > 1920 AS pan_y FROM c""")
def _f12(samples):
    s = samples.select("track_id").distinct().select("track_id", (640 + F.col("track_id") % 50 * 32).alias("sw"), (480 + F.col("track_id") % 7 * 100).alias("sh"))
    return s.select("track_id", *[c.alias(n) for n, c in T.cover_transform(F.col("sw"), F.col("sh"), 1080, 1920, 1.2).items()])


@query("f13_axis_constraints", "d_sample", sql="""
, a AS (SELECT track_id, sample_index, greatest(0.0::DOUBLE, x_max - 250.0::DOUBLE) AS lo, least(750.0::DOUBLE, x_min::DOUBLE) AS up,
    greatest(0.0::DOUBLE, least(750.0::DOUBLE, CASE sample_index % 3 WHEN 0 THEN x_min WHEN 1 THEN x_max - 250 ELSE (x_min + x_max) / 2 - 125 END)) AS edge FROM d_sample)
SELECT track_id, sample_index, CASE WHEN lo <= up + 1e-6 THEN lo ELSE edge END AS lower, CASE WHEN lo <= up + 1e-6 THEN up ELSE edge END AS upper, lo <= up + 1e-6 AS feasible, lo > up + 1e-6 AND sample_index % 2 = 0 AS controlled FROM a""")
def _f13(samples):
    i = F.col("sample_index")
    priority = F.when(i % 3 == 0, "preserve_start").when(i % 3 == 1, "preserve_end").otherwise("balanced")
    overflow = F.when(i % 2 == 0, "controlled_clip").otherwise("preserve_all")
    limits = T.axis_constraints(F.col("x_min").cast("double"), F.col("x_max").cast("double"), F.lit(250.0), priority, overflow)
    return samples.select("track_id", "sample_index", *[c.alias(n) for n, c in limits.items()])


_SEEN_SHARES = "greatest(0.0::DOUBLE, least(x_max, 500.0::DOUBLE) - greatest(x_min, 200.0::DOUBLE)) / (x_max - x_min) AS w, greatest(0.0::DOUBLE, least(y_max, 600.0::DOUBLE) - greatest(y_min, 100.0::DOUBLE)) / (y_max - y_min) AS h"


@query("f14_crop_visibility", "d_sample", sql=f"""
SELECT track_id, sample_index, x_min >= 200 AND x_max <= 500 AND y_min >= 100 AND y_max <= 600 AS contained, round(w, 6) AS visible_width, round(h, 6) AS visible_height, round(w * h, 6) AS visible_area FROM (SELECT *, {_SEEN_SHARES} FROM d_sample)""")
def _f14(samples):
    v = T.crop_visibility(box(), F.lit(200.0), F.lit(100.0), F.lit(300.0), F.lit(500.0))
    return samples.select("track_id", "sample_index", v["contained"].alias("contained"), *[F.round(v[k], 6).alias(k) for k in ("visible_width", "visible_height", "visible_area")])


@query("f15_boundary_contact", "d_sample", sql=f"SELECT track_id, count(*) FILTER (WHERE {_TOUCH}) AS contacts, round(count(*) FILTER (WHERE {_TOUCH}) / count(*), 6) AS ratio FROM d_sample GROUP BY track_id")
def _f15(samples):
    n = F.count_if(T.boundary_contact(box()))
    return samples.groupBy("track_id").agg(n.alias("contacts"), F.round(n / F.count("*"), 6).alias("ratio"))


@query("f16_target_fits", "d_sample", sql="SELECT track_id, sample_index, CASE WHEN sample_index % 2 = 0 THEN (x_max - x_min) <= 220.0 ELSE (x_max - x_min) * 1.08::DOUBLE <= 220.0 END AS fits FROM d_sample")
def _f16(samples):
    return samples.select("track_id", "sample_index", T.target_fits(F.col("x_max") - F.col("x_min"), F.lit(220.0), F.col("sample_index") % 2 == 0).alias("fits"))


_ZOOM = """
, g AS (SELECT track_id, max((x_max - x_min) * (1 + track_id % 4)) AS w, max(y_max - y_min) AS h FROM d_sample GROUP BY track_id), z AS (SELECT track_id, greatest(1.0::DOUBLE, least(1.35::DOUBLE, 2.0::DOUBLE, 1920 / (w / 1000 * 1920 * 1.45::DOUBLE), 1080 / (h / 1000 * 1080 * 1.45::DOUBLE))) AS a FROM g)
, zooms AS (SELECT track_id, round(CASE WHEN a < 1.035 THEN 1.0::DOUBLE ELSE a END, 6) AS zoom FROM z)"""


def _wide(samples):
    """Boxes of several sizes, so that some tracks leave room for a zoom and some do not."""
    return samples.withColumn("x_max", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * (1 + F.col("track_id") % 4))


@query("f17_safe_zoom", "d_sample", sql=_ZOOM + " SELECT * FROM zooms")
def _f17(samples):
    return T.safe_zoom(_wide(samples), 1920, 1080, 1.35)


def _path_sql(tag: str, source: str, width: int, height: int) -> str:
    """tag: the crop path of source, and tag_audit: a row a track, as crop_path and crop_audit give them."""
    even = lambda v: f"greatest(2, ceil(({v}) / 2) * 2)"
    wide = f"source_width / source_height >= {width} / {height}"
    out = _smooth_sql(f"{tag}_s", source) + f"""
, {tag}_a AS (SELECT *, CASE WHEN {wide} THEN {even(f'{even(f"{height} * zoom")} * source_width / source_height')} ELSE {even(f"{width} * zoom")} END AS sw, CASE WHEN {wide} THEN {even(f"{height} * zoom")} ELSE {even(f'{even(f"{width} * zoom")} / (source_width / source_height)')} END AS sh FROM {tag}_s)
, {tag}_v AS (SELECT *, {width} * 1000 / sw AS vx, {height} * 1000 / sh AS vy, (x_max - x_min) * (safety - 1) / 2 AS mx, (y_max - y_min) * (safety - 1) / 2 AS my FROM {tag}_a)
, {tag}_p AS (SELECT *, greatest(0::DOUBLE, x_min - mx) AS lx, least(1000::DOUBLE, x_max + mx) AS hx, greatest(0::DOUBLE, y_min - my) AS ly, least(1000::DOUBLE, y_max + my) AS hy FROM {tag}_v)"""
    for a, before, after in (("x", "p", "q"), ("y", "q", "r")):
        fits = f"greatest(0::DOUBLE, h{a} - v{a}) <= least(greatest(0::DOUBLE, 1000 - v{a}), l{a}) + 1e-6"
        out += f"""
, {tag}_{after}0 AS (SELECT *, {fits} AS fit_{a}, greatest(0::DOUBLE, least(greatest(0::DOUBLE, 1000 - v{a}), CASE edge_priority WHEN 'preserve_start' THEN l{a} WHEN 'preserve_end' THEN h{a} - v{a} ELSE (l{a} + h{a}) / 2 - v{a} / 2 END)) AS at_{a} FROM {tag}_{before})
, {tag}_{after} AS (SELECT *, CASE WHEN fit_{a} THEN greatest(0::DOUBLE, h{a} - v{a}) ELSE at_{a} END AS lo_{a}, CASE WHEN fit_{a} THEN least(greatest(0::DOUBLE, 1000 - v{a}), l{a}) ELSE at_{a} END AS up_{a}, greatest(0::DOUBLE, least(1000 - v{a}, smooth_{a} - v{a} / 2)) AS d_{a} FROM {tag}_{after}0)"""
    out += f"""
, {tag}_t AS (SELECT *, fit_x AND fit_y AS fits, NOT (fit_x AND fit_y) AND overflow_policy = 'controlled_clip' AS controlled, overflow_policy = 'controlled_clip' OR bool_and(fit_x AND fit_y) OVER (PARTITION BY track_id) AS smoothing FROM {tag}_r)
, {tag}_k0 AS (SELECT *, greatest(lo_x, least(up_x, d_x)) AS cx, greatest(lo_y, least(up_y, d_y)) AS cy, cx AS px, cy AS py FROM {tag}_t)"""
    for k in range(12):
        step = lambda a: f"greatest(lo_{a}, least(up_{a}, 0.58::DOUBLE * d_{a} + 0.42::DOUBLE * coalesce((lag(p{a}) OVER w + lead(p{a}) OVER w) / 2, lag(p{a}) OVER w, lead(p{a}) OVER w, d_{a})))"
        out += f"\n, {tag}_k{k + 1} AS (SELECT * REPLACE ({step('x')} AS px, {step('y')} AS py) FROM {tag}_k{k} WINDOW w AS ({_W}))"
    return out + f"""
, {tag}_o AS (SELECT *, CASE WHEN smoothing THEN px ELSE cx END AS lft, CASE WHEN smoothing THEN py ELSE cy END AS top FROM {tag}_k12)
, {tag} AS (SELECT *, greatest(0::DOUBLE, least(x_max, lft + vx) - greatest(x_min, lft)) / (x_max - x_min) AS see_x, greatest(0::DOUBLE, least(y_max, top + vy) - greatest(y_min, top)) / (y_max - y_min) AS see_y,
    lx >= lft - 1e-6 AND hx <= lft + vx + 1e-6 AND ly >= top - 1e-6 AND hy <= top + vy + 1e-6 AS held, lft * sw / 1000 AS pixel_x, top * sh / 1000 AS pixel_y FROM {tag}_o)
, {tag}_m0 AS (SELECT *, greatest(0.001, seconds - lag(seconds) OVER w) AS dt, abs(pixel_x - lag(pixel_x) OVER w) AS dx, abs(pixel_y - lag(pixel_y) OVER w) AS dy FROM {tag} WINDOW w AS ({_W}))
, {tag}_m1 AS (SELECT *, dx / dt AS sx, dy / dt AS sy, sqrt((dx / dt) ** 2 + (dy / dt) ** 2) AS sp FROM {tag}_m0), {tag}_m2 AS (SELECT *, abs(sp - lag(sp) OVER ({_W})) / dt AS ac FROM {tag}_m1), {tag}_m AS (SELECT *, abs(ac - lag(ac) OVER ({_W})) / dt AS je FROM {tag}_m2)
, {tag}_audit AS (SELECT track_id, count(*) AS samples, round(first(vx), 4) AS view_x, round(first(vy), 4) AS view_y, max(x_max - x_min) AS max_width, max(y_max - y_min) AS max_height, bool_and(fits) AS all_feasible, bool_or(controlled) AS controlled_clip, count(*) FILTER (WHERE NOT held) AS not_contained,
    round(least(1, min(see_x)), 6) AS min_visible_width, round(least(1, min(see_y)), 6) AS min_visible_height, round(least(1, min(see_x * see_y)), 6) AS min_visible_area,
    round(coalesce(max(sx), 0), 4) AS max_speed_x, round(coalesce(max(sy), 0), 4) AS max_speed_y, round(coalesce(max(sp), 0), 4) AS max_speed, round(coalesce(max(ac), 0), 4) AS max_acceleration, round(coalesce(max(je), 0), 4) AS max_jerk,
    count(*) FILTER (WHERE x_min <= 5 OR x_max >= 995) AS x_contacts, count(*) FILTER (WHERE y_min <= 5 OR y_max >= 995) AS y_contacts, count(*) FILTER (WHERE {_TOUCH}) AS contacts, round(count(*) FILTER (WHERE {_TOUCH}) / count(*), 6) AS contact_ratio FROM {tag}_m GROUP BY track_id)"""


# one contract a series, in SQL that Spark and DuckDB share
_CONTRACT = """series % 3 = 0 AS allow_clipping, CASE WHEN series % 5 = 0 THEN 'controlled_clip' ELSE 'preserve_all' END AS overflow_policy, CASE series % 4 WHEN 0 THEN 'preserve_start' WHEN 1 THEN 'preserve_end' ELSE 'balanced' END AS edge_priority,
    CASE WHEN series % 2 = 0 THEN 'center_crop' ELSE 'fit_with_background' END AS fallback_strategy, CASE WHEN series % 29 = 7 THEN CAST(1.2 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS sample_aspect, CASE WHEN series % 2 = 0 THEN 'subtle' ELSE 'detail' END AS zoom_intent"""
_WIDTH, _HEIGHT = "CASE series % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1440 ELSE 720 END", "CASE series % 3 WHEN 2 THEN 1440 ELSE 1080 END"
_SIZES = f"""CASE WHEN region = 1 AND series % 37 = 5 THEN NULL ELSE {_WIDTH} END AS source_width, {_HEIGHT} + CASE WHEN region = 1 AND series % 31 = 4 THEN 8 ELSE 0 END AS source_height,
    CASE WHEN region = 1 AND series % 41 = 6 THEN NULL ELSE {_WIDTH} END AS width, {_HEIGHT} + CASE WHEN region = 1 AND series % 23 = 9 THEN 60 ELSE 0 END AS height"""
_LINEAGE = f"""
, sizes AS (SELECT DISTINCT series, region, {_SIZES} FROM d_crop WHERE region < 2)
, lineage AS (SELECT series, min(source_width) AS source_width, min(source_height) AS source_height, 'track_source_geometry_mismatch:' || CASE WHEN count(*) > count(source_width) OR count(*) > count(source_height) THEN 'missing_seed_dimensions' WHEN count(DISTINCT (source_width, source_height)) > 1 THEN 'required_tracks_disagree'
    WHEN count(*) > count(width) OR count(*) > count(height) THEN 'missing_analysis_dimensions' WHEN bool_or(abs(width / height / (source_width / source_height) - 1) > greatest(0.01, 2 / least(width, height))) THEN 'analysis_aspect_disagrees' END AS mismatch FROM sizes GROUP BY series)
, contracts AS (SELECT *, {_CONTRACT} FROM lineage)"""


def _contracts(crops):
    tracks = crops.where("region < 2").select("series", "region").distinct().selectExpr("series", "region", *_split(_SIZES))
    return T.source_lineage(tracks).selectExpr("*", *_split(_CONTRACT))


def _split(text: str) -> list[str]:
    """The columns of a list; no expression in these has a comma outside of parentheses."""
    return [x.strip() for x in text.split(",")]


_F30 = """
, b AS (SELECT series AS track_id, sample_index, t_ms / 1000 AS seconds, x_min, y_min, x_max, y_max, contracts.source_width, contracts.source_height, 1.0::DOUBLE AS zoom, CASE WHEN allow_clipping THEN 1.0::DOUBLE ELSE 1.08::DOUBLE END AS safety, overflow_policy, edge_priority, (x_min + x_max) / 2 AS want_x, (y_min + y_max) / 2 AS want_y
    FROM d_crop JOIN contracts USING (series) WHERE region = 0 AND state = 'tracked')"""


def _boxes(crops):
    rows = crops.where("region = 0 AND state = 'tracked'").join(_contracts(crops), "series")
    return rows.withColumnRenamed("series", "track_id").withColumns({"seconds": F.col("t_ms") / 1000, "safety": F.when(F.col("allow_clipping"), 1.0).otherwise(1.08)})


@query("f30_crop_geometry", "d_crop", sql=_LINEAGE + _F30 + _path_sql("path", "b", 1080, 1920) + " SELECT * FROM path_audit")
def _f30(crops):
    return T.crop_audit(T.crop_path(_boxes(crops), 1080, 1920))


@query("f30_crop_path", "d_crop", sql=_LINEAGE + _F30 + _path_sql("path", "b", 1080, 1920) + " SELECT track_id, sample_index, round(lft, 4) AS lft, round(top, 4) AS top, fits, controlled, held, round(see_x * see_y, 6) AS visible FROM path")
def _f30p(crops):
    p = T.crop_path(_boxes(crops), 1080, 1920)
    return p.select("track_id", "sample_index", F.round("left", 4).alias("lft"), F.round("top", 4).alias("top"), F.col("feasible").alias("fits"), "controlled", F.col("contained").alias("held"), F.round("visible_area", 6).alias("visible"))


def _times_sql(tag: str, regions: str) -> str:
    """tag: the times of the regions with the box around them, and tag_cover: the coverage of a series."""
    return f"""
, {tag}_s AS (SELECT * FROM d_crop WHERE {regions}), {tag}_n AS (SELECT series, count(DISTINCT region) AS n FROM {tag}_s GROUP BY series)
, {tag} AS (SELECT series, t_ms, count(DISTINCT region) FILTER (WHERE state = 'tracked') = max(n) AS usable, min(x_min) FILTER (WHERE state = 'tracked') AS x_min, min(y_min) FILTER (WHERE state = 'tracked') AS y_min, max(x_max) FILTER (WHERE state = 'tracked') AS x_max, max(y_max) FILTER (WHERE state = 'tracked') AS y_max FROM {tag}_s JOIN {tag}_n USING (series) GROUP BY series, t_ms)
, {tag}_g AS (SELECT series, max(t_ms - before) AS gap FROM (SELECT series, t_ms, lag(t_ms) OVER (PARTITION BY series ORDER BY t_ms) AS before FROM {tag} WHERE usable) GROUP BY series)
, {tag}_c AS (SELECT series, count(*) FILTER (WHERE usable) AS common, 1 - count(*) FILTER (WHERE usable) / count(*) AS unavailable, coalesce(min(t_ms) FILTER (WHERE usable) - min(t_ms), max(t_ms) - min(t_ms)) AS head, coalesce(max(t_ms) - max(t_ms) FILTER (WHERE usable), max(t_ms) - min(t_ms)) AS tail FROM {tag} GROUP BY series)
, {tag}_w AS (SELECT series, count(*) FILTER (WHERE state = 'low_confidence') AS low FROM {tag}_s GROUP BY series)
, {tag}_cover AS (SELECT *, low = 0 AND common >= 2 AND round(unavailable, 6) <= 0.20 AND head <= 200 * 1.35 + 35 AND tail <= 200 * 1.35 + 35 AND coalesce(gap, 0) <= 200 * 2.25 + 35 AS passed FROM {tag}_c JOIN {tag}_w USING (series) LEFT JOIN {tag}_g USING (series))"""


_SAFETY = "CASE WHEN allow_clipping THEN 1.0::DOUBLE ELSE 1.08::DOUBLE END"
_CODES = lambda *pairs: "concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for when, code in pairs) + ")"
_TOUCHES = lambda when: ((when, "source_boundary_contact"), (when, "not_recoverable_by_pan"))
_F28 = (
    _LINEAGE + _times_sql("need", "region < 2") + _times_sql("joint", "true") + f"""
, starts AS (SELECT series, min(t_ms) AS start FROM need GROUP BY series), joint_ok AS (SELECT series, common FROM joint_cover WHERE passed)
, b AS (SELECT a.series AS track_id, row_number() OVER (PARTITION BY a.series ORDER BY a.t_ms) - 1 AS sample_index, a.t_ms, (a.t_ms - start) / 1000 AS seconds, a.x_min, a.y_min, a.x_max, a.y_max, source_width, source_height, 1.0::DOUBLE AS zoom, {_SAFETY} AS safety, overflow_policy, edge_priority,
    CASE WHEN jn.common = nc.common AND j.usable THEN (j.x_min + j.x_max) / 2 ELSE (a.x_min + a.x_max) / 2 END AS want_x, CASE WHEN jn.common = nc.common AND j.usable THEN (j.y_min + j.y_max) / 2 ELSE (a.y_min + a.y_max) / 2 END AS want_y
    FROM need a JOIN starts USING (series) JOIN contracts USING (series) JOIN need_cover nc USING (series) LEFT JOIN joint j ON a.series = j.series AND a.t_ms = j.t_ms LEFT JOIN joint_ok jn ON jn.series = a.series WHERE a.usable)
, seed_box AS (SELECT series, count(DISTINCT t_ms + CASE WHEN series % 19 = 2 THEN region ELSE 0 END) AS times, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM d_crop WHERE region < 2 AND sample_index = 0 GROUP BY series)
, s AS (SELECT series AS track_id, 0 AS sample_index, 0.0::DOUBLE AS seconds, x_min, y_min, x_max, y_max, times, source_width, source_height, 1.0::DOUBLE AS zoom, {_SAFETY} AS safety, overflow_policy, edge_priority, (x_min + x_max) / 2 AS want_x, (y_min + y_max) / 2 AS want_y FROM seed_box JOIN contracts USING (series))"""
    + _path_sql("path", "b", 1080, 1920) + _path_sql("anchor", "s", 1080, 1920) + f"""
, soft_keys AS (SELECT p.track_id, p.t_ms, lft, top, vx, vy, d.x_min AS x0, d.y_min AS y0, d.x_max AS x1, d.y_max AS y1 FROM path p JOIN (SELECT DISTINCT series FROM d_crop WHERE region = 2) r ON p.track_id = r.series LEFT JOIN (SELECT * FROM d_crop WHERE region = 2 AND state = 'tracked') d ON d.series = p.track_id AND d.t_ms = p.t_ms)
, soft AS (SELECT track_id AS series, count(x0) = count(*) AND min(coalesce(greatest(0::DOUBLE, least(x1, lft + vx) - greatest(x0, lft)) / (x1 - x0) * (greatest(0::DOUBLE, least(y1, top + vy) - greatest(y0, top)) / (y1 - y0)), 0)) + 1e-6 >= 0.72 AS soft_passed FROM soft_keys GROUP BY track_id)
, held_seed AS (SELECT track_id AS series, times = 1 AND (overflow_policy = 'controlled_clip' OR fits AND held) AS anchor_held, controlled AS anchor_clip, {_TOUCH} AS anchor_touches FROM anchor)
, j0 AS (SELECT c.*, coalesce(v.low, 0) > 0 AS weak, coalesce(v.common, 0) AS common, coalesce(v.passed, false) AS covered, head, tail, a.* EXCLUDE (track_id), coalesce(anchor_held, false) AS anchor_held, anchor_clip, anchor_touches, coalesce(soft_passed, true) AS soft_passed
    FROM contracts c LEFT JOIN need_cover v USING (series) LEFT JOIN path_audit a ON a.track_id = c.series LEFT JOIN held_seed h USING (series) LEFT JOIN soft USING (series))
, j1 AS (SELECT *, NOT covered OR common < 2 AS uncovered, max_width * {_SAFETY} > view_x AS wide, max_height * {_SAFETY} > view_y AS tall, CASE WHEN weak THEN 'required_region_tracking_confidence_failed' WHEN common < 2 THEN 'fewer_than_two_usable_tracking_samples' ELSE 'required_region_tracking_coverage_failed' END AS why FROM j0)
, j2 AS (SELECT *, CASE WHEN abs(sample_aspect - 1) > 1e-6 THEN 'aspect' WHEN mismatch IS NOT NULL THEN 'lineage' WHEN uncovered AND fallback_strategy = 'center_crop' AND anchor_held THEN 'anchor' WHEN uncovered THEN 'uncovered'
    WHEN overflow_policy = 'preserve_all' AND NOT all_feasible THEN 'too_large' WHEN overflow_policy = 'preserve_all' AND not_contained > 0 THEN 'not_contained' ELSE 'tracked' END AS kind FROM j1)
, j3 AS (SELECT series, CASE kind WHEN 'anchor' THEN 'seed_anchor_crop' WHEN 'tracked' THEN 'tracked_crop' ELSE fallback_strategy END AS strategy,
    CASE kind WHEN 'aspect' THEN 'non_square_pixel_aspect_ratio_requires_static_reframe' WHEN 'lineage' THEN mismatch WHEN 'anchor' THEN why || '_used_static_seed_anchor' WHEN 'uncovered' THEN why WHEN 'too_large' THEN 'required_region_union_too_large_for_safe_9x16_crop' WHEN 'not_contained' THEN 'required_region_containment_gate_failed' END AS reason,
    CASE kind WHEN 'aspect' THEN 'non_square_pixel_aspect_ratio_requires_static_reframe' WHEN 'lineage' THEN 'track_source_geometry_mismatch'
    WHEN 'anchor' THEN {_CODES(("true", "required_region_tracking_coverage_failed"), ("true", "seed_anchor_static_hold"), ("true", "motion_outside_seed_unverified"), ("weak", "required_region_low_confidence"), ("anchor_clip", "controlled_required_region_clip"), *_TOUCHES("anchor_touches"))}
    WHEN 'uncovered' THEN {_CODES(("weak", "required_region_low_confidence"), ("true", "required_region_unavailable"))} WHEN 'too_large' THEN {_CODES(("wide", "required_region_too_wide"), ("tall", "required_region_too_tall"), ("NOT wide AND NOT tall", "required_region_not_containable"))} WHEN 'not_contained' THEN 'required_region_not_contained'
    ELSE {_CODES(("controlled_clip", "controlled_required_region_clip"), ("NOT soft_passed", "soft_extent_visibility_below_floor"), ("head > 145 OR tail > 145", "analysis_edge_hold_long"), *_TOUCHES("contacts > 0"), ("max_speed > 720", "crop_motion_fast"), ("max_acceleration > 1800", "crop_motion_acceleration_high"))} END AS risks FROM j2)
SELECT series, strategy, reason, risks, risks <> '' AS needs_review FROM j3"""
)


@query("f28_vertical_routing", "d_crop", sql=_F28)
def _f28(crops):
    crops = cut_lineage(crops)  # read for the times, coverage, contracts, seeds and extents; the windows of its view are made once
    seeds = crops.where("region < 2 AND sample_index = 0").withColumn("seed_ms", F.col("t_ms") + F.when(F.col("series") % 19 == 2, F.col("region")).otherwise(0))
    preferred = crops.where("region = 2").withColumn("floor", F.lit(0.72))
    routed = T.vertical_routing(crops.where("region < 2"), _contracts(crops), seeds, 200, preferred)
    return routed.withColumn("risks", F.array_join("risks", ","))


@query("f29_horizontal_routing", "d_crop", sql=_LINEAGE + """
, t AS (SELECT * FROM d_crop WHERE region = 0)
, counts AS (SELECT series, count(*) FILTER (WHERE state = 'low_confidence') AS low, count(*) FILTER (WHERE state = 'tracked') AS usable, max(x_max - x_min) FILTER (WHERE state = 'tracked') AS mw, max(y_max - y_min) FILTER (WHERE state = 'tracked') AS mh FROM t GROUP BY series)
, scaled AS (SELECT *, CASE zoom_intent WHEN 'subtle' THEN 1.12::DOUBLE ELSE 1.35::DOUBLE END AS requested, CASE WHEN source_width / source_height >= 1920 / 1080 THEN ceil(1080 * source_width / source_height / 2) * 2 ELSE 1920 END AS bw, CASE WHEN source_width / source_height >= 1920 / 1080 THEN 1080 ELSE ceil(1920 / (source_width / source_height) / 2) * 2 END AS bh FROM contracts LEFT JOIN counts USING (series))
, zooms AS (SELECT *, least(2.0::DOUBLE, 1920 / (mw / 1000 * bw * 1.45::DOUBLE), 1080 / (mh / 1000 * bh * 1.45::DOUBLE)) AS safe, greatest(1.0::DOUBLE, least(requested, safe)) AS zoom FROM scaled)
, gated AS (SELECT *, CASE WHEN abs(sample_aspect - 1) > 1e-6 THEN 'aspect' WHEN mismatch IS NOT NULL THEN 'lineage' WHEN coalesce(low, 0) > 0 THEN 'confidence' WHEN coalesce(usable, 0) < 2 THEN 'few' WHEN zoom < 1.035 THEN 'margin' END AS early FROM zooms)
, b AS (SELECT t.series AS track_id, sample_index, t_ms / 1000 AS seconds, x_min, y_min, x_max, y_max, source_width, source_height, zoom, 1.45::DOUBLE AS safety, 'preserve_all' AS overflow_policy, 'balanced' AS edge_priority, (x_min + x_max) / 2 AS want_x, (y_min + y_max) / 2 AS want_y FROM t JOIN gated USING (series) WHERE early IS NULL AND state = 'tracked')""" + _path_sql("path", "b", 1920, 1080) + """
, k AS (SELECT g.*, coalesce(early, CASE WHEN all_feasible AND not_contained = 0 THEN 'tracked' ELSE 'containment' END) AS kind FROM gated g LEFT JOIN path_audit a ON a.track_id = g.series)
SELECT series AS track_id, CASE kind WHEN 'tracked' THEN 'tracked_zoom' ELSE 'original' END AS route,
    CASE kind WHEN 'aspect' THEN 'non_square_pixel_aspect_ratio_requires_static_reframe' WHEN 'lineage' THEN mismatch WHEN 'confidence' THEN 'tracking_confidence_gate_failed' WHEN 'few' THEN 'fewer_than_two_usable_tracking_samples' WHEN 'margin' THEN 'mask_geometry_left_no_safe_zoom_margin' WHEN 'containment' THEN 'tracked_reframe_containment_gate_failed' END AS reason,
    CASE kind WHEN 'tracked' THEN '' ELSE CASE kind WHEN 'aspect' THEN 'non_square_pixel_aspect_ratio_requires_static_reframe' WHEN 'lineage' THEN 'track_source_geometry_mismatch' WHEN 'confidence' THEN 'tracking_low_confidence' WHEN 'few' THEN 'insufficient_high_confidence_tracking_samples' WHEN 'margin' THEN 'tracked_reframe_no_safe_zoom_margin' ELSE 'tracked_reframe_required_region_not_contained' END || ',requested_tracked_reframe_not_applied' END AS risks,
    requested AS requested_zoom, CASE WHEN kind IN ('margin', 'containment', 'tracked') THEN round(safe, 4) END AS safe_zoom, CASE kind WHEN 'tracked' THEN round(zoom, 4) ELSE 1.0::DOUBLE END AS applied_zoom FROM k""")
def _f29(crops):
    contracts = _contracts(crops).withColumnRenamed("series", "track_id")
    samples = crops.where("region = 0").withColumnRenamed("series", "track_id")
    return T.horizontal_routing(samples, contracts).withColumn("risks", F.array_join("risks", ","))
