"""Frame catalogs and trims (view h)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import frames as H
from reelwork.plans.base import query

_H = "h_frame"
_MS = """
, raw AS (SELECT *, frame_pts * tb_num * 1000 AS n, tb_den AS d FROM h_frame)
, ms AS (SELECT event_id, pos, frame_pts, frame_hash, (n - n % d) // d + CASE WHEN 2 * (n % d) > d OR (2 * (n % d) = d AND ((n - n % d) // d) % 2 = 1) THEN 1 ELSE 0 END AS ms FROM raw)
, agg AS (SELECT event_id, count(*) AS n, max(pos) AS last, min(ms) AS a, max(ms) AS b FROM ms GROUP BY event_id)"""


def _events(h):
    return H.with_ms(h).groupBy("event_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("w2_storyboard_to_intervals", _H, sql=_MS + " SELECT event_id, pos, ms AS start_ms, coalesce(lead(ms) OVER (PARTITION BY event_id ORDER BY pos), 60000) AS end_ms FROM ms")
def _w2(h):
    return H.intervals(h, 60_000)


@query("w10_last_included", _H, sql="SELECT event_id, pos, lag(frame_pts) OVER (PARTITION BY event_id ORDER BY pos) AS last_pts FROM h_frame")
def _w10(h):
    return H.last_included(h)


@query("w12_contiguous_run", _H, sql="""
, s AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS place, pos FROM h_frame WHERE NOT (event_id % 3 = 0 AND pos = 2))
SELECT event_id, count(*) AS n, max(pos) - min(pos) + 1 = count(*) AS contiguous FROM s GROUP BY event_id""")
def _w12(h):
    from pyspark.sql import Window as W

    s = h.where("NOT (event_id % 3 = 0 AND pos = 2)").select("event_id", "pos", F.row_number().over(W.partitionBy("event_id").orderBy("pos")).alias("place"))
    return H.contiguous_runs(s)


@query("j1_frame_to_clip", _H, sql=", clips AS (SELECT event_id, 'clip-' || event_id % 100 AS clip FROM h_frame GROUP BY event_id) SELECT event_id, pos, clip FROM h_frame JOIN clips USING (event_id)")
def _j1(h):
    clips = h.select("event_id").distinct().withColumn("clip", F.concat(F.lit("clip-"), (F.col("event_id") % 100).cast("string")))
    return H.frame_to_clip(h, clips).select("event_id", "pos", "clip")


@query("j18_seed_by_exact_pts", _H, sql="""
, f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 AND pos = 2 THEN 7007 ELSE frame_pts END AS pts, tb_num, tb_den FROM h_frame), n AS (SELECT event_id, pts, count(*) AS n, min(round_even(pts * tb_num * 1000 / tb_den, 0)::BIGINT) AS ms FROM f GROUP BY event_id, pts)
, s AS (SELECT DISTINCT event_id, 7007 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS seed_pts, CASE WHEN event_id % 5 = 0 THEN 230 ELSE 234 END AS at_ms FROM h_frame)
SELECT s.event_id, seed_pts, CASE WHEN n IS NULL THEN 'no_such_frame' WHEN n > 1 THEN 'duplicate_pts' WHEN ms <> at_ms THEN 'time_differs' END AS rule FROM s LEFT JOIN n ON s.event_id = n.event_id AND seed_pts = pts""")
def _j18(h):
    f = h.withColumn("frame_pts", F.when((F.col("event_id") % 11 == 0) & (F.col("pos") == 2), 7007).otherwise(F.col("frame_pts")).cast("long"))
    seeds = h.select("event_id").distinct().select("event_id", (7007 + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).cast("long").alias("seed_pts"), F.when(F.col("event_id") % 5 == 0, 230).otherwise(234).alias("seed_time_ms"))
    return H.by_exact_pts(seeds, H.with_ms(f))


@query("j14_trim_for_segment", _H, sql="""
, s AS (SELECT DISTINCT event_id AS segment_id, event_id // 3 AS asset_id, event_id // 2 % 2 AS shot_id, 0 AS shot_start, CASE WHEN event_id % 7 = 0 THEN 250 ELSE 2000 END AS shot_end, CASE WHEN event_id % 4 <> 0 THEN event_id END AS event_id FROM h_frame)
, t AS (SELECT event_id // 3 AS asset_id, event_id // 2 % 2 AS shot_id, event_id, pos * 100 AS in_ms, pos * 100 + 200 AS out_ms FROM h_frame WHERE pos = 2 AND event_id % 6 <> 1)
, g AS (SELECT segment_id, count(*) AS n, min(in_ms) AS i, min(out_ms) AS o FROM s JOIN t ON s.asset_id = t.asset_id AND s.shot_id = t.shot_id AND (s.event_id IS NULL OR s.event_id = t.event_id) GROUP BY segment_id)
, r AS (SELECT s.segment_id, i, o, CASE WHEN n IS NULL THEN 'fallback' WHEN n > 1 THEN 'ambiguous' WHEN shot_start <= i AND i < o AND o <= shot_end THEN 'apply' ELSE 'crosses_shot' END AS outcome FROM s LEFT JOIN g USING (segment_id))
SELECT segment_id, outcome, CASE WHEN outcome = 'apply' THEN i END AS in_ms, CASE WHEN outcome = 'apply' THEN o END AS out_ms FROM r""")
def _j14(h):
    place = {"asset_id": F.floor(F.col("event_id") / 3), "shot_id": F.floor(F.col("event_id") / 2) % 2}
    end = F.when(F.col("event_id") % 7 == 0, 250).otherwise(2000)
    segments = h.select("event_id").distinct().withColumns(place | {"segment_id": F.col("event_id"), "shot_start": F.lit(0), "shot_end": end}).withColumn("event_id", F.when(F.col("segment_id") % 4 != 0, F.col("segment_id")))
    trims = h.where("pos = 2 AND event_id % 6 <> 1").withColumns(place).select("asset_id", "shot_id", "event_id", (F.col("pos") * 100).alias("in_ms"), (F.col("pos") * 100 + 200).alias("out_ms"))
    return H.trim_for_segment(segments, trims)


@query("j24_evidence_bracket", _H, sql=_MS + " SELECT event_id, greatest(100, a) AS from_ms, least(1500, b + CASE WHEN n > 1 THEN floor((b - a) / (n - 1)) ELSE 0 END)::BIGINT AS to_ms FROM agg")
def _j24(h):
    events = h.select("event_id").distinct().withColumns({"start_ms": F.lit(100), "end_ms": F.lit(1500)})
    return H.evidence_bracket(events, H.with_ms(h))


@query("p8_matching_dense_seed", _H, sql="SELECT event_id, pos, frame_pts FROM h_frame WHERE pos = 1 + event_id % 3 AND event_id % 5 <> 0 AND event_id % 4 <> 0")
def _p8(h):
    s = h.select("event_id").distinct().select("event_id", (1 + F.col("event_id") % 3).cast("long").alias("pos"), (F.col("event_id") % 5 != 0).alias("visible"), F.when(F.col("event_id") % 4 != 0, "matched").otherwise("ambiguous").alias("status"))
    return H.matching_dense_seed(s, h)


@query("p9_predicate_seed_frame", _H, sql="""
, l AS (SELECT event_id, list(pos ORDER BY pos) AS p FROM h_frame GROUP BY event_id)
SELECT event_id, CASE event_id % 4 WHEN 1 THEN p[1] WHEN 2 THEN p[2] WHEN 3 THEN p[len(p) // 2 + 1] END AS seed_pos FROM l""")
def _p9(h):
    l = h.groupBy("event_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'seed' WHEN 2 THEN 'transition' ELSE 'interval' END")
    return l.select("event_id", H.predicate_seed(kind, F.col("p")).alias("seed_pos"))


def _trims(h):
    e = _events(h)
    notes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") + 2)), lambda x: F.concat(F.lit("n"), x.cast("string")))
    status = F.expr("CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'proposed' ELSE 'rejected' END")
    return e.select("event_id", "n", "last", status.alias("status"), (F.col("event_id") % 2 == 0).alias("reviewed"), (F.col("event_id") % 7 != 0).alias("usable"), F.when(F.col("event_id") % 4 < 2, F.lit(1)).alias("hold_start"), F.when(F.col("event_id") % 4 != 1, F.col("last")).alias("hold_end"), F.slice(notes, 1, 8).alias("notes"))


@query("p5_accepted_trims", _H, sql="SELECT DISTINCT event_id, event_id % 3 = 0 AND event_id % 2 = 0 OR event_id % 3 = 1 AS accepted FROM h_frame")
def _p5(h):
    return H.accepted_trims(_trims(h), True)


@query("p17_normalize_hold", _H, sql="""
, e AS (SELECT event_id, count(*) AS n, max(pos) AS last FROM h_frame GROUP BY event_id), x AS (SELECT *, event_id % 4 IN (1, 2, 3) AND event_id % 4 <> 0 AND (event_id % 4 = 1 OR event_id % 4 >= 2) AS half, list_transform(range(1, least(8, n + 2) + 1), lambda i: 'n' || i) AS notes FROM e)
SELECT event_id, CASE WHEN NOT half THEN 1::BIGINT END AS hold_start, CASE WHEN NOT half THEN last END AS hold_end,
    array_to_string(CASE WHEN half AND len(notes) < 8 THEN list_append(notes, 'hold_incomplete') WHEN half THEN list_concat(notes[1:7], [notes[8] || '; hold_incomplete']) ELSE notes END, ',') AS notes FROM x""")
def _p17(h):
    return H.normalize_hold(_trims(h)).select("event_id", "hold_start", "hold_end", F.array_join("notes", ",").alias("notes"))


@query("p19_apply_trim_review", _H, sql="""
, t AS (SELECT DISTINCT event_id, CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'proposed' ELSE 'rejected' END AS status, event_id % 7 <> 0 AS usable, CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS verdict FROM h_frame)
SELECT event_id, CASE WHEN verdict IS NULL OR (verdict = 'approve' AND NOT usable) THEN status WHEN verdict = 'approve' THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN verdict = 'approve' AND NOT usable THEN 'unusable_approved' END AS rule FROM t""")
def _p19(h):
    reviews = h.select("event_id").distinct().where("event_id % 5 < 2").select("event_id", F.when(F.col("event_id") % 5 == 0, "approve").otherwise("reject").alias("verdict"))
    return H.apply_reviews(_trims(h), reviews)


@query("f31_trim_decision", _H, sql=_MS + """
, g AS (SELECT event_id, min(CASE WHEN pos = 2 THEN ms END) AS in_ms, max(ms) AS out_ms FROM ms GROUP BY event_id)
SELECT event_id, in_ms, out_ms, greatest(0, in_ms - 750) AS handle_start, least(2000 + event_id % 500, out_ms + 1000) AS handle_end FROM g WHERE in_ms < out_ms""")
def _f31(h):
    return H.trim_decision(h, 2000 + F.col("event_id") % 500)


# coarse trims of an event; in SQL that Spark and DuckDB share
_COARSE = {
    "in_ms": "a + CASE WHEN event_id % 17 = 3 THEN b ELSE 0 END", "out_ms": "b + event_id % 3 * 40", "allowed_start": "200 + event_id % 100", "allowed_end": "1400", "hold_start_ms": "CASE WHEN event_id % 2 = 0 THEN a + event_id % 900 END", "hold_end_ms": "CASE WHEN event_id % 2 = 0 THEN b + event_id % 5 - 2 END", "reset_ms": "CASE WHEN event_id % 3 = 0 THEN a - 1 + event_id % 2 END",
    "duration_ms": "b + event_id % 200", "start_pts": "CASE WHEN event_id % 4 = 0 THEN 1000 END", "tb_num": "1", "tb_den": "30000",
}
_COARSE_SQL = _MS + f", t AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _COARSE.items())} FROM agg)"


def _coarse(h):
    g = H.with_ms(h).groupBy("event_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    return g.selectExpr("event_id", *[f"{v} AS {k}" for k, v in _COARSE.items()])


@query("f32_video_trim_bounds", _H, sql=_COARSE_SQL + """
SELECT event_id, 'in_outside' AS rule FROM t WHERE in_ms < allowed_start UNION ALL SELECT event_id, 'out_outside' FROM t WHERE out_ms > allowed_end UNION ALL SELECT event_id, 'in_not_before_out' FROM t WHERE in_ms >= out_ms
UNION ALL SELECT event_id, 'hold_start_outside' FROM t WHERE hold_start_ms NOT BETWEEN in_ms AND out_ms UNION ALL SELECT event_id, 'hold_end_outside' FROM t WHERE hold_end_ms NOT BETWEEN in_ms AND out_ms UNION ALL SELECT event_id, 'reset_outside' FROM t WHERE reset_ms NOT BETWEEN in_ms AND out_ms""")
def _f32(h):
    return H.trim_bounds(_coarse(h))


@query("f32_trim_boundaries", _H, sql=_COARSE_SQL + """
, f AS (SELECT t.event_id, min(CASE WHEN ms >= in_ms THEN ms END) AS i, min(CASE WHEN ms >= in_ms THEN frame_pts END) AS ip, min(CASE WHEN ms >= out_ms THEN ms END) AS o, min(CASE WHEN ms >= out_ms THEN frame_pts END) AS op FROM t JOIN ms USING (event_id) GROUP BY t.event_id)
, r AS (SELECT *, CASE WHEN i IS NULL THEN 'in_missing' WHEN o IS NULL AND duration_ms - out_ms > 100 THEN 'out_missing' WHEN o <= i THEN 'not_chronological' END AS rule FROM t JOIN f USING (event_id))
SELECT event_id, CASE WHEN rule IS NULL THEN i END AS in_ms, CASE WHEN rule IS NULL THEN ip END AS in_pts, CASE WHEN rule IS NULL THEN coalesce(o, out_ms) END AS out_ms, CASE WHEN rule IS NULL THEN coalesce(op, coalesce(start_pts, 0) + (out_ms * 30000 + 999) // 1000) END AS out_pts,
    CASE WHEN rule IS NULL THEN CASE WHEN o IS NOT NULL THEN 'first_decoded_frame_at_or_after_request' ELSE 'end_of_stream_time_boundary' END END AS out_kind, rule FROM r""")
def _f32b(h):
    return H.trim_boundaries(_coarse(h), H.with_ms(h))


_NAME = "concat('DF', CASE WHEN event_id % 13 = 0 AND pos = 3 THEN 1 WHEN event_id % 17 = 0 AND pos = 1 THEN 9 ELSE pos END)"


@query("v5_dense_catalog", _H, sql=_MS + f"""
, c AS (SELECT event_id, pos, ms, {_NAME} AS frame_id FROM ms), x AS (SELECT *, count(*) OVER (PARTITION BY event_id, frame_id) AS same, lag(frame_id) OVER w AS before, count(*) OVER (PARTITION BY event_id) AS n FROM c WINDOW w AS (PARTITION BY event_id ORDER BY pos))
SELECT event_id, pos, 'outside_window' AS rule FROM x WHERE ms >= 1500 OR ms < 300 UNION ALL SELECT event_id, pos, 'duplicate_id' FROM x WHERE same > 1 UNION ALL SELECT event_id, pos, 'ids_not_ordered' FROM x WHERE frame_id < before UNION ALL SELECT event_id, pos, 'over_limit' FROM x WHERE n > 6 AND pos = 1""")
def _v5(h):
    return H.dense_catalog_violations(h.withColumn("frame_id", F.expr(_NAME)), 300, 1500, 6)


def _columns(rows, built):
    return rows.withColumns({k: F.expr(v) for k, v in built.items()})


def _built(built):
    return ", ".join(f"{v} AS {k}" for k, v in built.items())


def _told(*rules):
    """The names of the rules whose conditions hold, as DuckDB's list."""
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{rule}' END" for rule, when in rules) + "], lambda x: x IS NOT NULL)"


# selections, proposals and decisions over the frames of an event; in SQL that Spark and DuckDB share
_SELECTION = {
    "visible": "event_id % 4 <> 0", "first": "CASE WHEN event_id % 5 <> 0 THEN 1 END", "recommended": "CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 1 + event_id % 3 END", "last": "CASE WHEN event_id % 5 <> 0 THEN n END",
    "target_id": "CASE WHEN event_id % 3 = 0 THEN 't' WHEN event_id % 11 = 0 THEN '' END", "target_description": "CASE WHEN event_id % 6 = 0 OR event_id % 9 = 1 THEN 'text' END", "status": "CASE event_id % 13 WHEN 0 THEN 'not_visible' WHEN 1 THEN 'matched' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'target_mismatch' END",
}
_RULES_V6 = (
    ("ids_missing", "visible AND (first IS NULL OR recommended IS NULL OR last IS NULL)"), ("status_of_visible", "visible AND status IN ('not_visible', 'target_mismatch')"), ("order", "visible AND (first > recommended OR recommended > last)"), ("fields_not_expected", "NOT visible AND coalesce(first, recommended, last)::VARCHAR IS NOT NULL OR NOT visible AND coalesce(target_id, target_description) IS NOT NULL"),
    ("status_of_invisible", "NOT visible AND status IN ('matched', 'ambiguous')"), ("half_target", "(coalesce(target_id, '') = '') <> (coalesce(target_description, '') = '')"),
)
_COUNTED = ", e AS (SELECT event_id, count(*) AS n FROM h_frame GROUP BY event_id)"


@query("v6_dense_selection", _H, sql=f"{_COUNTED}, s AS (SELECT *, {_built(_SELECTION)} FROM e) SELECT event_id, unnest({_told(*_RULES_V6)}) AS rule FROM s")
def _v6(h):
    return H.selection_violations(_columns(_events(h), _SELECTION))


_PHASES = {"usable": "event_id % 7 <> 0", "requires_review": "event_id % 19 <> 3", "a": "CASE WHEN event_id % 5 <> 1 THEN concat('DF', 1 + event_id % 2) END", "b": "CASE WHEN event_id % 6 <> 2 THEN concat('DF', n) END", "c": "CASE WHEN event_id % 3 = 0 THEN 'DF1' END", "d": "CASE WHEN event_id % 4 < 2 THEN 'DF2' END", "again": "event_id % 23 = 4"}
_RULES_V7 = (
    ("review_not_required", "NOT requires_review"), ("repeated_phase", "again AND a IS NOT NULL"), ("in_out_missing", "usable AND (a IS NULL OR b IS NULL)"), ("single_frame", "usable AND a = b"), ("frames_of_unusable", "NOT usable AND coalesce(a, b, c, d) IS NOT NULL"), ("half_hold", "(c IS NULL) <> (d IS NULL)"),
)


@query("v7_trim_proposals", _H, sql=f"{_COUNTED}, s AS (SELECT *, {_built(_PHASES)} FROM e) SELECT event_id, unnest({_told(*_RULES_V7)}) AS rule FROM s")
def _v7(h):
    phase = lambda name, c, when=None: F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), F.struct(F.lit(name).alias("phase"), F.col(c).alias("frame_id")))
    chosen = F.array_compact(F.array(phase("recommended_in", "a"), phase("hold_start", "c"), phase("hold_end", "d"), phase("recommended_out", "b"), phase("recommended_in", "a", F.col("again"))))
    return H.phase_violations(_columns(_events(h), _PHASES).withColumn("selections", chosen))


_TIMES = {
    "usable": "event_id % 7 <> 0", "requires_review": "event_id % 19 <> 3", "in_ms": "CASE WHEN event_id % 5 <> 1 THEN event_id % 9 * 1000 END", "out_ms": "CASE WHEN event_id % 6 <> 2 THEN n * 1000 END", "hold_start_ms": "CASE WHEN event_id % 3 = 0 THEN 2000 END", "hold_end_ms": "CASE WHEN event_id % 4 < 3 THEN event_id % 5 * 1000 END",
    "reset_ms": "CASE WHEN event_id % 14 = 0 THEN 1000 END",
}
_RULES_TIMES = (
    ("review_not_required", "NOT requires_review"), ("in_out_missing", "usable AND (in_ms IS NULL OR out_ms IS NULL)"), ("not_chronological", "usable AND out_ms <= in_ms"), ("times_of_unusable", "NOT usable AND coalesce(in_ms, out_ms, hold_start_ms, hold_end_ms, reset_ms) IS NOT NULL"), ("half_hold", "(hold_start_ms IS NULL) <> (hold_end_ms IS NULL)"),
    ("hold_not_chronological", "hold_end_ms < hold_start_ms"),
)


@query("v7_video_trims", _H, sql=f"{_COUNTED}, s AS (SELECT *, {_built(_TIMES)} FROM e) SELECT event_id, unnest({_told(*_RULES_TIMES)}) AS rule FROM s")
def _v7v(h):
    return H.video_trim_violations(_columns(_events(h), _TIMES))


_DECISIONS = {
    "usable": "event_id % 7 <> 0", "first_frame": "CASE WHEN event_id % 7 <> 0 OR event_id % 2 = 0 THEN 'DF1' END", "in_ms": "CASE WHEN event_id % 11 <> 5 AND event_id % 7 <> 0 THEN event_id % 6 * 1000 END", "out_ms": "CASE WHEN event_id % 7 <> 0 THEN n * 1000 END", "in_pts": "CASE WHEN event_id % 7 <> 0 THEN 1 END",
    "out_pts": "CASE WHEN event_id % 7 <> 0 THEN 2 END", "handle_in_ms": "CASE WHEN event_id % 13 <> 6 THEN event_id % 6 * 1000 - 500 + event_id % 3 * 400 END", "handle_out_ms": "n * 1000 + 700 - event_id % 4 * 300", "status": "CASE event_id % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' ELSE 'rejected' END",
    "requires_review": "event_id % 3 = 0 OR event_id % 17 = 2", "verdict": "CASE WHEN event_id % 3 = 1 THEN 'approved' WHEN event_id % 3 = 2 AND event_id % 5 <> 0 THEN 'rejected' WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 2 = 0 THEN 'approved' END WHEN event_id % 29 = 0 THEN 'approved' END",
}
_WHOLE = "(first_frame IS NOT NULL AND in_ms IS NOT NULL AND out_ms IS NOT NULL AND in_pts IS NOT NULL AND out_pts IS NOT NULL)"
_RULES_DECISION = (
    ("bounds_missing", f"usable AND NOT {_WHOLE}"), ("empty_interval", f"usable AND {_WHOLE} AND out_ms <= in_ms"), ("handles_missing", f"usable AND {_WHOLE} AND (handle_in_ms IS NULL OR handle_out_ms IS NULL)"), ("outside_handles", f"usable AND {_WHOLE} AND handle_in_ms IS NOT NULL AND handle_out_ms IS NOT NULL AND (handle_in_ms > in_ms OR out_ms > handle_out_ms)"),
    ("bounds_of_unusable", "NOT usable AND coalesce(first_frame, in_ms::VARCHAR, out_ms::VARCHAR, in_pts::VARCHAR, out_pts::VARCHAR) IS NOT NULL"), ("proposed_but_reviewed", "status = 'proposed' AND (NOT requires_review OR verdict IS NOT NULL)"), ("reviewed_without_record", "status <> 'proposed' AND (requires_review OR verdict IS NULL)"), ("verdict_differs", "status <> 'proposed' AND verdict <> status"),
)


@query("v7_trim_decisions", _H, sql=f"{_COUNTED}, s AS (SELECT *, {_built(_DECISIONS)} FROM e) SELECT event_id, unnest({_told(*_RULES_DECISION)}) AS rule FROM s")
def _v7d(h):
    return H.trim_decision_violations(_columns(_events(h), _DECISIONS))


# temporal selections over the frames of an event; in SQL that Spark and DuckDB share
_PICK = {
    "required_at": "CASE event_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'seed' WHEN 2 THEN 'transition' ELSE 'interval' END", "match_status": "CASE WHEN event_id % 13 = 0 THEN 'ambiguous' ELSE 'matched' END", "predicate_status": "CASE WHEN event_id % 29 = 1 THEN 'not_applicable' ELSE 'satisfied' END",
    "coverage_claim": "CASE WHEN event_id % 17 = 2 THEN 'everything' WHEN event_id % 13 = 0 THEN 'no_positive_claim' WHEN event_id % 4 < 2 THEN 'single_frame_only' WHEN event_id % 4 = 2 THEN 'transition_samples_only' ELSE 'sampled_frames_only' END",
    "candidate_id": "CASE WHEN event_id % 4 = 0 THEN 'f1' END", "seed_id": "CASE WHEN event_id % 4 = 1 THEN 'f2' WHEN event_id % 19 = 3 THEN 'f1' END", "pre_id": "CASE WHEN event_id % 4 = 2 THEN 'f1' END", "apex_id": "CASE WHEN event_id % 4 = 2 THEN concat('f', 2 + event_id % 3) END", "post_id": "CASE WHEN event_id % 4 = 2 THEN 'f3' END",
    "second": "CASE WHEN event_id % 4 = 3 THEN concat('f', 1 + event_id % 3) END", "status": "CASE WHEN event_id % 11 = 4 THEN 'inferred' ELSE 'observed' END", "other": "CASE WHEN event_id % 23 = 5 THEN 'c' ELSE 'b' END", "observed": "event_id % 31 <> 6", "skipped": "CASE WHEN event_id % 7 = 3 THEN 'f1' ELSE '' END",
}


@query("v12_predicate_selection", _H, sql=f"""
, e AS (SELECT event_id, list(concat('f', pos) ORDER BY pos) AS catalog_ids FROM h_frame GROUP BY event_id), p AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _PICK.items())} FROM e)
, q AS (SELECT *, list_filter([candidate_id, seed_id, pre_id, apex_id, post_id], lambda x: x IS NOT NULL) AS chosen, CASE WHEN second IS NOT NULL THEN ['f1', second] ELSE []::VARCHAR[] END AS picked, match_status = 'matched' AND predicate_status = 'satisfied' AS positive, list_filter(['f1', 'f2', 'f3'], lambda x: x <> skipped) AS seen FROM p)
, s AS (SELECT *, CASE required_at WHEN 'candidate' THEN candidate_id IS NOT NULL AND len(chosen) = 1 WHEN 'seed' THEN seed_id IS NOT NULL AND len(chosen) = 1 WHEN 'transition' THEN len(chosen) = 3 AND seed_id IS NULL AND apex_id NOT IN ('f1', 'f3') ELSE len(chosen) = 0 END AS shape, CASE WHEN required_at = 'interval' THEN picked ELSE chosen END AS selected FROM q)
, w AS (SELECT *, positive AND shape AS well, list_filter(seen, lambda x: list_contains(selected, x)) AS told FROM s)
SELECT event_id, unnest(list_concat(CASE WHEN predicate_status = 'not_applicable' THEN ['not_applicable'] END, CASE WHEN NOT positive AND len(chosen) + len(picked) > 0 THEN ['frames_without_claim'] END, CASE WHEN NOT positive AND coverage_claim <> 'no_positive_claim' THEN ['claim_without_frames'] END,
    CASE WHEN positive AND NOT shape THEN ['stage_shape'] END, CASE WHEN positive AND coverage_claim = 'everything' THEN ['coverage_claim'] END, CASE WHEN positive AND second = 'f1' THEN ['repeated_interval_frame'] END, CASE WHEN well AND len(list_filter(selected, lambda x: NOT list_contains(seen, x))) > 0 THEN ['frame_without_evidence'] END,
    CASE WHEN well AND len(told) > 0 AND status <> 'observed' THEN ['participant_not_observed'] END, CASE WHEN well AND len(told) > 0 AND NOT observed THEN ['predicate_not_observed'] END, CASE WHEN well AND required_at = 'transition' AND apex_id <> 'f2' AND list_contains(seen, apex_id) THEN ['wrong_phase'] END,
    CASE WHEN well AND required_at = 'transition' AND NOT (1 < coalesce(list_position(catalog_ids, apex_id), 0) AND coalesce(list_position(catalog_ids, apex_id), 0) < coalesce(list_position(catalog_ids, 'f3'), 0)) THEN ['transition_order'] END,
    CASE WHEN len(list_filter(list_concat(chosen, picked, seen), lambda x: NOT list_contains(catalog_ids, x))) > 0 THEN ['unknown_frame'] END, CASE WHEN other <> 'b' THEN ['participants_differ'] END, CASE WHEN well AND required_at = 'interval' AND picked <> ['f1', 'f2'] THEN ['interval_not_contiguous']
    WHEN well AND required_at = 'interval' AND len(catalog_ids) < 2 THEN ['interval_not_contiguous'] END)) AS rule FROM w""")
def _v12(h):
    e = h.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list("pos")), lambda p: F.concat(F.lit("f"), p)).alias("catalog_ids")).withColumns({k: F.expr(v) for k, v in _PICK.items()})
    statuses = F.array(F.struct(F.lit("a").alias("target_id"), F.lit("observed").alias("status")), F.struct(F.col("other").alias("target_id"), F.col("status").alias("status")))
    frame = lambda f, phase: F.struct(F.lit(f).alias("frame_id"), statuses.alias("statuses"), F.col("observed").alias("observed"), F.lit(phase).alias("phase"))
    evidence = F.filter(F.array(frame("f1", "precondition"), frame("f2", "apex"), frame("f3", "postcondition")), lambda x: x["frame_id"] != F.col("skipped"))
    picked = F.when(F.col("second").isNotNull(), F.array(F.lit("f1"), F.col("second"))).otherwise(F.array().cast("array<string>"))
    return H.predicate_violations(e.withColumns({"evidence": evidence, "interval_ids": picked, "participants": F.array(F.lit("b"), F.lit("a"))}))
