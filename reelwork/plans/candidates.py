"""Ranked candidates and policy (view e)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.operators import candidates as K
from reelwork.operators.projection import projected_choices
from reelwork.plans.base import query

_E = "e_candidate"
_POLICY = K.Policy(minimum_evidence_confidence=0.02)
_CODES = """
, flags AS (SELECT *, (role = 'hard_core' OR atomic) AND min_visible < 1.0 AND atomic AS a1, (role = 'hard_core' OR atomic) AND min_visible < 1.0 AND NOT atomic AS h1, role = 'soft_extent' AND min_visible + 1e-6 < CASE WHEN atomic THEN 1.0 ELSE 0.95 END::DOUBLE AS s1,
    role2 = 'hard_core' AND (NOT assessed2 OR min_visible2 < 1.0) AS h2, assessed2 AND role2 = 'soft_extent' AND min_visible2 < 0.72 AS s2, assessed2 AND role2 = 'overlay_keepout' AND overlap2 > 0 AS o2 FROM e_candidate)
, coded AS (SELECT *, list_filter([CASE WHEN NOT lineage_ok THEN 'source_lineage_invalid' END, CASE WHEN NOT single_shot THEN 'shot_boundary_crossing' END, CASE WHEN confidence < 0.02 THEN 'evidence_confidence_below_minimum' END,
    CASE WHEN semantic_status = 'ambiguous' THEN 'target_ambiguity_above_maximum' WHEN semantic_status = 'not_visible' THEN 'semantic_match_below_minimum' END, CASE WHEN NOT confidence_ok THEN 'track_confidence_below_minimum' END, CASE WHEN NOT coverage_ok THEN 'track_coverage_below_minimum' END,
    CASE WHEN NOT checkpoints_ok THEN 'identity_switch_detected' END, CASE WHEN a1 THEN 'atomic_region_clipped' END, CASE WHEN h1 THEN 'hard_core_not_fully_retained' END, CASE WHEN s1 THEN 'soft_extent_below_minimum' END,
    CASE WHEN h2 AND NOT h1 THEN 'hard_core_not_fully_retained' END, CASE WHEN s2 AND NOT s1 THEN 'soft_extent_below_minimum' END, CASE WHEN o2 THEN 'overlay_keepout_violated' END,
    CASE WHEN max_speed > 720 THEN 'crop_speed_above_maximum' END, CASE WHEN max_acceleration > 1800 THEN 'crop_acceleration_above_maximum' END, CASE WHEN max_jerk > 7200 THEN 'crop_jerk_above_maximum' END,
    CASE WHEN geometry_fingerprint <> expected_fingerprint THEN 'geometry_fingerprint_mismatch' END, CASE WHEN strategy = 'center_crop' THEN 'no_feasible_presentation' END], lambda x: x IS NOT NULL) AS codes FROM flags)
, judged AS (SELECT *, len(codes) = 0 AS passed FROM coded)"""
_RECOVER = """CASE WHEN list_contains(codes, 'shot_boundary_crossing') THEN 'split_at_shot_boundary' WHEN codes = ['overlay_keepout_violated'] THEN 'reposition_overlay'
    WHEN list_has_any(codes, ['crop_speed_above_maximum', 'crop_acceleration_above_maximum', 'crop_jerk_above_maximum']) THEN 'try_simpler_motion'"""
_REVIEW = "WHEN list_has_any(codes, ['semantic_match_below_minimum', 'target_ambiguity_above_maximum', 'identity_switch_detected', 'source_lineage_invalid']) THEN 'review_required' ELSE 'fit_with_background' END"
_WON = _CODES + """
, g AS (SELECT chapter, min(CASE WHEN strategy <> 'fit_with_background' AND passed THEN rank END) AS crop, min(CASE WHEN strategy = 'fit_with_background' THEN rank END) AS fit, min(rank) AS first FROM judged GROUP BY chapter)
, won AS (SELECT chapter, 'c' || coalesce(crop, fit, first) AS winner, coalesce(crop, fit, first) AS winner_rank, CASE WHEN crop IS NOT NULL THEN 'accepted_crop' WHEN fit IS NOT NULL THEN 'deferred_fit' ELSE 'policy_blocked_preview_fit' END AS outcome FROM g)
, tried AS (SELECT judged.*, outcome, winner_rank FROM judged JOIN won USING (chapter) WHERE outcome <> 'accepted_crop' OR rank <= winner_rank)
, routed AS (SELECT *, CASE WHEN passed THEN 'accept' ELSE """ + _RECOVER + " WHEN rank < max(rank) OVER (PARTITION BY chapter) THEN 'try_next_candidate' " + _REVIEW + " END AS action FROM tried)"
_TEXT = "array_to_string(codes, ',') AS codes"
_SELECTED = "SELECT chapter, 'c' || (1 + chapter % 3) AS selected FROM e_candidate GROUP BY chapter"


def _region(name, role, atomic, assessed, visible, required, overlap):
    parts = {"region_id": F.lit(name), "role": role, "atomic": atomic, "assessed": assessed, "min_visible": visible.cast("double"), "required_visible": required.cast("double"), "overlap": overlap.cast("double")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _full(c):
    """The candidates with their two regions and their fingerprints."""
    first = F.when((F.col("role") == "hard_core") | F.col("atomic"), 1.0).when(F.col("role") == "soft_extent", 0.95).otherwise(0.0)
    second = F.when(F.col("role2") == "hard_core", 1.0).when(F.col("role2") == "soft_extent", 0.72).otherwise(0.0)
    regions = F.array(_region("r1", F.col("role"), F.col("atomic"), F.lit(True), F.col("min_visible"), first, F.lit(0.0)), _region("r2", F.col("role2"), F.lit(False), F.col("assessed2"), F.col("min_visible2"), second, F.col("overlap2")))
    return c.withColumns({"regions": regions, "source_fingerprint": F.concat(F.lit("s"), F.col("source_id").cast("string")), "track_fingerprints": F.array(F.concat(F.lit("t"), F.col("frame_id").cast("string")))})


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


def _selected(c):
    return c.select("chapter").distinct().withColumn("selected", F.concat(F.lit("c"), (1 + F.col("chapter") % 3).cast("string")))


@query("f18_failure_codes", _E, sql=_CODES + f" SELECT chapter, candidate_id, {_TEXT} FROM judged")
def _f18(c):
    return _joined(K.with_codes(_full(c), _POLICY).select("chapter", "candidate_id", "codes"), "codes")


@query("f19_choose_recovery", _E, sql=_CODES + " SELECT chapter, candidate_id, " + _RECOVER + """
    WHEN chapter % 2 = 0 AND list_has_any(codes, ['semantic_match_below_minimum', 'target_ambiguity_above_maximum', 'track_confidence_below_minimum', 'track_coverage_below_minimum']) THEN 'try_alternate_seed' WHEN rank < 3 THEN 'try_next_candidate' """ + _REVIEW + " AS action FROM judged")
def _f19(c):
    return K.with_codes(_full(c), _POLICY).select("chapter", "candidate_id", K.recovery(F.col("codes"), F.col("rank") < 3, F.col("chapter") % 2 == 0).alias("action"))


_ERROR = "CASE frame_id % 6 WHEN 0 THEN 'Error: ambiguous target' WHEN 1 THEN 'TARGET_MISMATCH' WHEN 2 THEN 'low confidence' WHEN 3 THEN 'fewer_than_two samples' WHEN 4 THEN 'Shot crosses boundary' ELSE 'other' END"


@query("f20_codes_from_error", _E, sql="SELECT chapter, candidate_id, CASE frame_id % 6 WHEN 0 THEN 'target_ambiguity_above_maximum' WHEN 1 THEN 'semantic_match_below_minimum' WHEN 2 THEN 'track_confidence_below_minimum' WHEN 3 THEN 'track_coverage_below_minimum' WHEN 4 THEN 'shot_boundary_crossing' ELSE 'no_feasible_presentation' END AS code FROM e_candidate")
def _f20(c):
    return c.select("chapter", "candidate_id", K.codes_from_error(F.expr(_ERROR)).alias("code"))


_ENTITY = "CASE frame_id % 8 WHEN 0 THEN 'person' WHEN 1 THEN 'screen' WHEN 2 THEN 'text_region' WHEN 3 THEN 'phone_screen' WHEN 4 THEN 'ui_element' WHEN 5 THEN 'logo' WHEN 6 THEN 'other' ELSE 'product' END"
_LABEL = "CASE frame_id % 3 WHEN 0 THEN concat('..Clip ', candidate_id, ':', role, '!') WHEN 1 THEN '?!' ELSE concat('Ad_', candidate_id, '.v2') END"


@query("f21_region_kind", _E, sql=f"""
, n AS (SELECT chapter, candidate_id, {_ENTITY} AS k, trim(regexp_replace({_LABEL}, '[^A-Za-z0-9_.:-]+', '-', 'g'), '-.') AS t FROM e_candidate)
SELECT chapter, candidate_id, CASE WHEN k = 'text_region' THEN 'text_region' WHEN k IN ('phone_screen', 'screen', 'ui_element') THEN 'ui_region' WHEN k = 'logo' THEN 'graphic' WHEN k = 'other' THEN 'other' ELSE 'subject' END AS kind, CASE WHEN t = '' THEN 'region' ELSE t END AS token FROM n""")
def _f21(c):
    from reelwork.functions.text import safe_token

    return c.select("chapter", "candidate_id", K.region_kind(F.expr(_ENTITY)).alias("kind"), safe_token(F.expr(_LABEL)).alias("token"))


@query("p14_execution_role", _E, sql="SELECT chapter, candidate_id, r AS execution_role, CASE r WHEN 'hard_core' THEN 1.0 WHEN 'overlay_keepout' THEN 0.0 ELSE coalesce(g, 0.72) END::DOUBLE AS floor FROM (SELECT *, CASE WHEN role = 'overlay_keepout' THEN 'overlay_keepout' WHEN role = 'hard_core' OR atomic THEN 'hard_core' ELSE 'soft_extent' END AS r, CASE WHEN frame_id % 2 = 0 THEN 0.8 END AS g FROM e_candidate)")
def _p14(c):
    given = F.when(F.col("role") == "overlay_keepout", "avoid_overlay").otherwise(F.col("role"))
    out = c.withColumn("execution_role", K.execution_role(given, F.col("role") == "hard_core", F.col("atomic")))
    return out.select("chapter", "candidate_id", "execution_role", K.visibility_floor(F.col("execution_role"), F.when(F.col("frame_id") % 2 == 0, 0.8)).alias("floor"))


@query("t4_rank_preflights", _E, sql=_CODES + " SELECT chapter, candidate_id, passed, row_number() OVER (PARTITION BY chapter ORDER BY NOT passed, rank, candidate_id) AS place FROM judged")
def _t4(c):
    return K.rank_preflights(_full(c), _POLICY).select("chapter", "candidate_id", "passed", "place")


@query("t5_first_accepted", _E, sql=_WON + " SELECT chapter, winner, winner_rank, outcome FROM won")
def _t5(c):
    return K.first_accepted(_full(c), _POLICY)


@query("t5_attempts", _E, sql=_WON + " SELECT chapter, candidate_id, outcome FROM tried")
def _t5a(c):
    return K.attempts(_full(c), _POLICY).select("chapter", "candidate_id", "outcome")


@query("t6_selected_first", _E, sql=f", s AS ({_SELECTED}) SELECT chapter, candidate_id, row_number() OVER (PARTITION BY chapter ORDER BY candidate_id <> selected, rank, candidate_id) AS new_rank FROM e_candidate JOIN s USING (chapter)")
def _t6(c):
    return K.selected_first(c.join(_selected(c), "chapter"), F.col("candidate_id") == F.col("selected")).select("chapter", "candidate_id", "new_rank")


@query("t7_topk_contract", _E, sql=f"""
, s AS ({_SELECTED}), g AS (SELECT chapter, count(*) AS n, count(DISTINCT frame_id) AS frames, list(candidate_id) AS ids FROM e_candidate GROUP BY chapter), j AS (SELECT * FROM g JOIN s USING (chapter))
SELECT chapter, 'count' AS rule FROM j WHERE n < 2 OR n > 4 UNION ALL SELECT chapter, 'same_evidence' FROM j WHERE frames < n UNION ALL SELECT chapter, 'selected_missing' FROM j WHERE NOT list_contains(ids, selected) UNION ALL SELECT chapter, 'selected_not_first' FROM j WHERE selected <> 'c1'""")
def _t7(c):
    return K.topk_violations(c, _selected(c))


@query("t8_alternatives", _E, sql=f", s AS ({_SELECTED}) SELECT chapter, candidate_id FROM e_candidate JOIN s USING (chapter) WHERE candidate_id <> selected")
def _t8(c):
    return K.alternatives(c, _selected(c)).select("chapter", "candidate_id")


@query("p11_candidate_options", _E, sql="SELECT chapter, candidate_id, option FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY rank, candidate_id) AS option FROM e_candidate) WHERE option <= 3 AND (chapter % 5 <> 0 OR option = 1)")
def _p11(c):
    return K.candidate_options(c, 3, F.col("chapter") % 5 == 0).select("chapter", "candidate_id", "option")


@query("p12_resolve_intent", _E, sql="""
, x AS (SELECT chapter, candidate_id, CASE WHEN frame_id % 3 = 0 THEN ['core:' || frame_id, 'soft:' || source_id] WHEN frame_id % 3 = 1 THEN ['soft:' || source_id] ELSE [] END AS r, CASE WHEN frame_id % 2 = 0 THEN 'own ' || frame_id END AS t FROM e_candidate)
SELECT chapter, candidate_id, array_to_string(CASE WHEN len(r) > 0 THEN r ELSE ['brief:' || chapter] END, ',') AS regions, coalesce(CASE WHEN len(r) = 2 THEN r[1] END, t, 'brief ' || chapter) AS target FROM x""")
def _p12(c):
    none = F.array().cast("array<string>")
    text = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    r = F.when(F.col("frame_id") % 3 == 0, F.array(text("core:", "frame_id"), text("soft:", "source_id"))).when(F.col("frame_id") % 3 == 1, F.array(text("soft:", "source_id"))).otherwise(none)
    own = c.select("chapter", "candidate_id", r.alias("regions"), F.when(F.col("frame_id") % 2 == 0, text("own ", "frame_id")).alias("target"))
    brief = c.select("chapter").distinct().select("chapter", F.array(text("brief:", "chapter")).alias("regions"), text("brief ", "chapter").alias("target"))
    return _joined(K.resolve_intent(own, brief), "regions")


def _planned(c):
    return c.select("chapter", "candidate_id", F.when(F.col("frame_id") % 3 == 0, "original").otherwise("tracked").alias("strategy"), F.when(F.col("frame_id") % 2 == 0, "subtle").otherwise("none").alias("zoom"), F.when(F.col("frame_id") % 4 == 0, F.lit("center")).alias("focus"))


@query("p15_canonicalize_plan", _E, sql="SELECT chapter, candidate_id, CASE WHEN frame_id % 3 <> 0 AND frame_id % 2 = 0 THEN 'subtle' ELSE 'none' END AS zoom, CASE WHEN frame_id % 3 <> 0 AND frame_id % 4 = 0 THEN 'center' END AS focus FROM e_candidate")
def _p15(c):
    return K.canonical_plan(_planned(c))[0].select("chapter", "candidate_id", "zoom", "focus")


@query("p15_plan_changes", _E, sql="""
SELECT concat(chapter, '.', candidate_id, '.zoom') AS path, 'subtle' AS before, 'none' AS after, 'original_has_no_zoom' AS rule FROM e_candidate WHERE frame_id % 3 = 0 AND frame_id % 2 = 0
UNION ALL SELECT concat(chapter, '.', candidate_id, '.focus'), 'center', NULL, 'original_has_no_focus' FROM e_candidate WHERE frame_id % 3 = 0 AND frame_id % 4 = 0""")
def _p15c(c):
    return K.canonical_plan(_planned(c))[1]


@query("p16_canonicalize_open_edit", _E, sql="SELECT chapter, candidate_id, round(min_visible, 6) AS before, 1.0::DOUBLE AS after FROM e_candidate WHERE (role = 'hard_core' OR atomic) AND min_visible <> 1.0")
def _p16(c):
    return K.canonical_regions(c)[1]


@query("p18_target_description", _E, sql="SELECT chapter, candidate_id, CASE WHEN frame_id % 3 = 0 THEN 'target ' || frame_id WHEN frame_id % 3 = 1 THEN role || '; ' || semantic_status ELSE role END AS target FROM e_candidate")
def _p18(c):
    target = F.when(F.col("frame_id") % 3 == 0, F.concat(F.lit("target "), F.col("frame_id").cast("string")))
    return c.select("chapter", "candidate_id", K.target_text(F.col("role"), F.when(F.col("frame_id") % 3 == 1, F.col("semantic_status")), target).alias("target"))


@query("p21_semantic_review_reasons", _E, sql="""
, r AS (SELECT *, CASE frame_id % 5 WHEN 0 THEN 'text_region' WHEN 1 THEN 'ui_region' ELSE 'subject' END AS kind, CASE WHEN frame_id % 4 = 0 THEN 0.95 ELSE 0.92 END AS floor FROM e_candidate)
, g AS (SELECT chapter, count(*) FILTER (WHERE role = 'hard_core') AS cores, bool_or(role <> 'overlay_keepout' AND (kind <> 'subject' OR atomic)) AS atomic, bool_or(role = 'overlay_keepout') AS keepout, max(CASE WHEN strategy = 'fit_with_background' THEN 'too wide' END) AS fallback, bool_and(min_visible >= floor) FILTER (WHERE role = 'soft_extent') AS soft FROM r GROUP BY chapter)
SELECT chapter, concat_ws(',', CASE WHEN cores > 1 THEN 'multiple_hard_core_regions' END, CASE WHEN atomic THEN 'atomic_text_or_ui_region' END, CASE WHEN keepout THEN 'overlay_keepout_requires_layout_gate' END, CASE WHEN fallback IS NOT NULL THEN 'fallback_applied' END, CASE WHEN NOT soft THEN 'soft_extent_visibility_below_floor' END) AS reasons FROM g""")
def _p21(c):
    r = c.withColumns({"kind": F.when(F.col("frame_id") % 5 == 0, "text_region").when(F.col("frame_id") % 5 == 1, "ui_region").otherwise("subject"), "floor": F.when(F.col("frame_id") % 4 == 0, 0.95).otherwise(0.92)})
    geometries = r.groupBy("chapter").agg(F.max(F.when(F.col("strategy") == "fit_with_background", "too wide")).alias("fallback_reason"), F.bool_and(F.when(F.col("role") == "soft_extent", F.col("min_visible") >= F.col("floor"))).alias("soft_extents_passed"))
    return _joined(K.review_reasons(r, geometries), "reasons")


@query("p1_compact_cards", _E, sql="""
, c AS (SELECT chapter, string_agg(concat(rank, ':', candidate_id, ':', frame_id, ':', role), ',' ORDER BY rank) AS cards FROM e_candidate GROUP BY chapter), r AS (SELECT chapter, source_id, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM e_candidate GROUP BY ALL)
SELECT chapter, cards, relations FROM c JOIN (SELECT chapter, string_agg(concat(source_id, '=', roles), ',' ORDER BY source_id) AS relations FROM r GROUP BY chapter) USING (chapter)""")
def _p1(c):
    out = K.compact_candidates(c)
    cards = F.transform("cards", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["candidate_id"], x["frame_id"].cast("string"), x["role"]))
    relations = F.transform("relations", lambda x: F.concat(x["source_id"].cast("string"), F.lit("="), F.array_join(x["roles"], "|")))
    return out.select("chapter", F.array_join(cards, ",").alias("cards"), F.array_join(relations, ",").alias("relations"))


@query("p2_compact_cards_v3", _E, sql="SELECT chapter, string_agg(concat(rank, ':', candidate_id, ':', frame_id), ',' ORDER BY rank) AS cards FROM e_candidate GROUP BY chapter")
def _p2(c):
    cards = F.transform("cards", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["candidate_id"], x["frame_id"].cast("string")))
    return K.compact_candidates(c, False).select("chapter", F.array_join(cards, ",").alias("cards"))


@query("a17_reframe_summary", _E, sql=_WON + " SELECT (SELECT count(*) FROM won) AS chapters, (SELECT count(*) FROM won WHERE winner_rank > 1) AS switched, (SELECT count(*) FROM won WHERE outcome = 'policy_blocked_preview_fit') AS blocked, (SELECT count(*) FROM routed) AS attempts, (SELECT count(*) FROM routed WHERE action = 'review_required') AS review_required")
def _a17(c):
    return K.reframe_summary(_full(c), _POLICY)


@query("a17_code_histogram", _E, sql=_WON + " SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM tried) GROUP BY code")
def _a17h(c):
    return K.code_histogram(_full(c), _POLICY)


_SEEDED = "CASE WHEN frame_id % 3 <> 0 AND NOT passed AND NOT list_contains(codes, 'shot_boundary_crossing') AND codes <> ['overlay_keepout_violated'] AND NOT list_has_any(codes, ['crop_speed_above_maximum', 'crop_acceleration_above_maximum', 'crop_jerk_above_maximum']) AND list_has_any(codes, [" + ", ".join(f"'{c}'" for c in K.TARGETING) + "]) THEN 'try_alternate_seed' ELSE action END"


@query("c10_auto_route", _E, sql=_WON + f" SELECT chapter, candidate_id, {_TEXT}, {_SEEDED} AS action, outcome FROM routed")
def _c10(c):
    tried = _full(c).withColumn("seeds_tried", F.when(F.col("frame_id") % 3 == 0, 1).otherwise(0))
    return _joined(K.auto_route(tried, _POLICY).select("chapter", "candidate_id", "codes", "action", "outcome"), "codes")


@query("a20_quality_risks", _E, sql=_CODES + ", x AS (SELECT chapter, unnest(codes) AS code FROM judged) SELECT j.chapter, coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM x WHERE x.chapter = j.chapter), '') AS risks FROM (SELECT DISTINCT chapter FROM judged) j")
def _a20(c):
    return _joined(K.quality_risks(_full(c), _POLICY), "risks")


@query("u2_same_ordered_ids", _E, sql="""
, a AS (SELECT DISTINCT chapter FROM e_candidate), p AS (SELECT chapter, row_number() OVER (ORDER BY chapter) AS position FROM a), q AS (SELECT chapter, row_number() OVER (ORDER BY CASE WHEN chapter % 1000 = 1 THEN chapter + 1.5 ELSE chapter END) AS position FROM a)
SELECT position, p.chapter AS left_id, q.chapter AS right_id FROM p FULL JOIN q USING (position) WHERE p.chapter IS DISTINCT FROM q.chapter""")
def _u2(c):
    ids = c.select("chapter").distinct()
    place = lambda order: ids.select("chapter", F.row_number().over(W.orderBy(order)).alias("position"))
    return K.ordered_mismatches(place(F.col("chapter")), place(F.when(F.col("chapter") % 1000 == 1, F.col("chapter") + 1.5).otherwise(F.col("chapter"))), "chapter")


@query("u3_union_ids", _E, sql="SELECT chapter, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT chapter, frame_id AS id FROM e_candidate UNION SELECT chapter, source_id FROM e_candidate) GROUP BY chapter")
def _u3(c):
    return _joined(K.union_ids(c), "ids")


# which entities a candidate classes, and what its event has; in SQL that Spark and DuckDB share
_CLASSES = {"required": "concat('n', frame_id % 6)", "preferred": "concat('n', frame_id % 5)", "sacrificable": "concat('n', (frame_id + 1) % 4)", "focus_id": "CASE WHEN frame_id % 3 = 0 THEN concat('n', frame_id % 7) END"}


@query("u4_classified", _E, sql=f"""
, c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _CLASSES.items())} FROM e_candidate), s AS (SELECT *, list_filter([required, preferred, sacrificable, focus_id], lambda x: x IS NOT NULL) AS named, CASE WHEN source_id % 10 = 9 THEN [] ELSE ['n0', 'n1', 'n2', 'n' || source_id % 4, 'n' || (3 + source_id % 2)] END AS known, CASE WHEN source_id % 10 = 9 THEN [] ELSE ['n1', 'n' || source_id % 4] END AS important FROM c)
SELECT chapter, candidate_id, array_to_string(list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(known, x)))), ',') AS unknown, array_to_string(list_sort(list_distinct(list_filter(important, lambda x: x NOT IN (required, preferred, sacrificable)))), ',') AS unclassified FROM s""")
def _u4(c):
    n = lambda k: F.concat(F.lit("n"), k.cast("string"))
    s = F.col("source_id")
    rows = c.withColumns({k: F.expr(v) for k, v in _CLASSES.items()}).select("chapter", "candidate_id", s.alias("asset_id"), F.lit("e").alias("event_id"), *[F.array(k).alias(k) for k in ("required", "preferred", "sacrificable")], "focus_id")
    events = c.select("source_id").distinct().where("source_id % 10 <> 9").select(
        s.alias("asset_id"), F.lit("e").alias("event_id"), F.array(F.lit("n0"), F.lit("n1")).alias("entity_ids"), F.array(F.lit("n1")).alias("primary_ids"), F.array(n(s % 4)).alias("required_ids"), F.array(F.lit("n2")).alias("optional_ids"),
        F.array().cast("array<string>").alias("avoid_overlay_ids"), F.array(n(s % 2 + 3)).alias("target_ids"),
    )
    return _joined(K.classified(rows, events), "unknown", "unclassified")


@query("j19_selected_assets", _E, sql="SELECT source_id, chapter AS first_chapter, rank AS first_rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY chapter, rank) AS rn FROM e_candidate) WHERE rn = 1")
def _j19(c):
    return K.selected_assets(c)


@query("j20_selected_evidence", _E, sql="""
, used AS (SELECT DISTINCT source_id, frame_id FROM e_candidate WHERE rank = 1), cards AS (SELECT DISTINCT source_id, frame_id FROM e_candidate)
SELECT source_id, string_agg(frame_id, ',' ORDER BY frame_id) AS frames FROM cards SEMI JOIN used USING (source_id, frame_id) GROUP BY source_id""")
def _j20(c):
    return _joined(K.selected_evidence(c, c.select("source_id", "frame_id")), "frames")


@query("j15_missing_ids", _E, sql="SELECT chapter, frame_id FROM e_candidate ANTI JOIN (SELECT DISTINCT frame_id FROM e_candidate WHERE rank = 1) USING (frame_id)")
def _j15(c):
    return K.missing_ids(c.select("chapter", "frame_id"), c.where("rank = 1").select("frame_id").distinct(), "frame_id")


_STRATEGY = "CASE frame_id % 4 WHEN 0 THEN 'tracked_crop' WHEN 1 THEN 'seed_anchor_crop' WHEN 2 THEN 'center_crop' ELSE 'blur' END"


@query("f33_preflight_from_geometry", _E, sql=f"""
, x AS (SELECT *, {_STRATEGY} AS applied, source_id % 4 = 0 AS titles, frame_id % 3 = 0 AS known FROM e_candidate)
SELECT chapter, candidate_id, CASE applied WHEN 'seed_anchor_crop' THEN 'static_anchor' WHEN 'blur' THEN 'fit_with_background' ELSE applied END AS presentation, frame_id % 6 <> 0 AS coverage_ok,
    concat('core:true:', CASE WHEN source_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE, ':1.0:0.0|wide:', known, ':', CASE WHEN known THEN 0.75 ELSE 0.0 END::DOUBLE, ':0.72:0.0|logo:', NOT titles, ':1.0:0.0:', CASE WHEN titles THEN 1.0 ELSE 0.0 END::DOUBLE) AS regions,
    sha256(concat('{{"contract_version":"vertical-candidate-geometry-preflight-v1","filter_graph":"crop=', frame_id, '","geometry":{{"applied_strategy":"', applied, '","confidence_passed":null,"coverage_passed":', frame_id % 6 <> 0, ',"lineage_passed":true,"max_acceleration":null,"max_jerk":null,"max_speed":', max_speed,
        ',"min_required_area":', CASE WHEN source_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE, ',"soft_extents":', CASE WHEN known THEN '[{{"region_id":"wide","min_area":0.75}}]' ELSE '[]' END, '}},"source_sha256":"s', source_id, '","track_fingerprint":', CASE WHEN frame_id % 2 = 0 THEN concat('"t', frame_id, '"') ELSE 'null' END, '}}')) AS geometry_fingerprint FROM x""")
def _f33(c):
    soft = F.array(F.struct(F.lit("wide").alias("region_id"), F.lit(0.75).alias("min_area")))
    none = lambda kind: F.lit(None).cast(kind)
    geometry = {"applied_strategy": F.expr(_STRATEGY), "confidence_passed": none("boolean"), "coverage_passed": F.col("frame_id") % 6 != 0, "lineage_passed": F.lit(True), "max_acceleration": none("double"), "max_jerk": none("double"), "max_speed": F.col("max_speed"), "min_required_area": F.when(F.col("source_id") % 5 == 0, 0.5).otherwise(1.0), "soft_extents": F.when(F.col("frame_id") % 3 == 0, soft).otherwise(F.slice(soft, 1, 0))}
    intent = lambda name, role, floor: F.struct(F.lit(name).alias("region_id"), F.lit(role).alias("execution_role"), F.lit(False).alias("atomic"), F.lit(floor).alias("floor"))
    given = {
        "geometry": F.struct(*[v.alias(k) for k, v in geometry.items()]), "intents": F.array(intent("core", "hard_core", 1.0), intent("wide", "soft_extent", 0.72), intent("logo", "overlay_keepout", 0.0)), "source_fingerprint": F.concat(F.lit("s"), F.col("source_id").cast("string")),
        "filter_graph": F.concat(F.lit("crop="), F.col("frame_id").cast("string")), "track_fingerprint": F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("t"), F.col("frame_id").cast("string"))), "titles_rendered": F.col("source_id") % 4 == 0,
    }
    said = lambda r: F.concat_ws(":", *[r[k].cast("string") for k in ("region_id", "assessed", "min_visible", "required_visible", "overlap")])
    text = F.concat_ws("|", *[said(F.get("regions", F.lit(i))) for i in range(3)])  # one a row of the intents above
    return K.preflight_rows(c.withColumns(given)).select("chapter", "candidate_id", F.col("strategy").alias("presentation"), "coverage_ok", text.alias("regions"), "geometry_fingerprint")


@query("f34_audit_bounded_clip", _E, sql=_CODES + f"""
, a AS (SELECT *, passed AND ((role = 'soft_extent' AND min_visible < 1.0) OR (role2 = 'soft_extent' AND min_visible2 < 1.0)) AS applied FROM judged)
SELECT chapter, candidate_id, passed AS approved, applied, array_to_string(codes, ',') AS codes, sha256(concat('{{"approved":', passed, ',"auto_bounded_clip_applied":', applied, ',"candidate_id":"', candidate_id, '","candidate_rank":', rank, ',"failure_codes":[', array_to_string(list_transform(codes, lambda x: '"' || x || '"'), ','),
    '],"geometry_fingerprint":"', geometry_fingerprint, '","policy_id":"auto_bounded_clip_v1","policy_sha256":"{_POLICY.sha256()}","source_fingerprint":"s', source_id, '","track_fingerprints":["t', frame_id, '"]}}')) AS audit_sha256 FROM a""")
def _f34(c):
    return _joined(K.audit_bounded_clip(_full(c), _POLICY), "codes")


_OVERRIDES = """
, o AS (SELECT chapter, 'both' AS aspect, 'c2' AS candidate_id FROM e_candidate WHERE chapter % 4 = 0 AND rank = 1 UNION ALL SELECT chapter, 'vertical', 'c3' FROM e_candidate WHERE chapter % 6 = 0 AND rank = 1 UNION ALL SELECT -chapter, 'horizontal', 'c1' FROM e_candidate WHERE chapter % 50 = 1 AND rank = 1)
, s AS (SELECT chapter, unnest(CASE WHEN aspect = 'both' THEN ['horizontal', 'vertical'] ELSE [aspect] END) AS aspect, candidate_id FROM o)
, bad AS (SELECT chapter, aspect, 'unknown_chapter' AS rule FROM s WHERE chapter NOT IN (SELECT chapter FROM e_candidate) UNION SELECT chapter, aspect, 'unknown_candidate' FROM s WHERE chapter IN (SELECT chapter FROM e_candidate) AND (chapter, candidate_id) NOT IN (SELECT chapter, candidate_id FROM e_candidate)
    UNION SELECT chapter, aspect, 'duplicate_override' FROM s GROUP BY chapter, aspect HAVING count(*) > 1)"""


def _overrides(c):
    first = c.where("rank = 1")
    row = lambda rows, aspect, candidate: rows.select("chapter", F.lit(aspect).alias("aspect"), F.lit(candidate).alias("candidate_id"))
    unknown = first.where("chapter % 50 = 1").withColumn("chapter", -F.col("chapter"))
    return row(first.where("chapter % 4 = 0"), "both", "c2").unionByName(row(first.where("chapter % 6 = 0"), "vertical", "c3")).unionByName(row(unknown, "horizontal", "c1"))


@query("c9_override_violations", _E, sql=_OVERRIDES + " SELECT * FROM bad")
def _c9v(c):
    return K.override_violations(c.select("chapter").distinct(), c, _overrides(c))


@query("c9_apply_overrides", _E, sql=_OVERRIDES + """
, good AS (SELECT * FROM s ANTI JOIN bad USING (chapter, aspect)), p AS (SELECT DISTINCT chapter FROM e_candidate)
SELECT p.chapter, coalesce((SELECT max(candidate_id) FROM good g WHERE g.chapter = p.chapter AND aspect = 'horizontal'), 'c1') AS horizontal_candidate_id, coalesce((SELECT max(candidate_id) FROM good g WHERE g.chapter = p.chapter AND aspect = 'vertical'), 'c1') AS vertical_candidate_id FROM p""")
def _c9(c):
    chapters = c.select("chapter", F.lit("c1").alias("horizontal_candidate_id"), F.lit("c1").alias("vertical_candidate_id")).distinct()
    return K.apply_overrides(chapters, c, _overrides(c))


@query("c16_trim_worklist", _E, sql="""
, g AS (SELECT chapter, max(CASE WHEN rank = 1 THEN frame_id END) AS h, max(CASE WHEN rank = 2 THEN frame_id END) AS v FROM e_candidate GROUP BY chapter)
SELECT chapter, 'both' AS aspect, h AS frame_id FROM g WHERE v IS NULL OR h = v UNION ALL SELECT chapter, 'horizontal', h FROM g WHERE h <> v UNION ALL SELECT chapter, 'vertical', v FROM g WHERE h <> v""")
def _c16(c):
    return K.trim_worklist(c)


# choices of candidates, and the events that they rest on; in SQL that Spark and DuckDB share
_CHOICES = {
    "event_id": "concat('e', source_id % 3)", "observed_visual_evidence": "concat('seen ', frame_id)", "selection_reason": "concat('why ', rank)", "horizontal_strategy": "CASE WHEN frame_id % 2 = 0 THEN 'tracked_reframe' ELSE 'original' END", "zoom_intent": "CASE WHEN frame_id % 2 = 0 THEN 'subtle' ELSE 'none' END",
    "focus_id": "CASE WHEN frame_id % 2 = 0 THEN concat('n', frame_id % 4) END", "vertical_strategy": "CASE WHEN role = 'hard_core' OR frame_id % 3 = 0 THEN 'tracked_crop' ELSE 'fit_with_background' END", "crop_mode": "'strict'", "framing_intent": "concat('keep ', role)",
    "first_required": "CASE WHEN frame_id % 29 = 1 THEN 'n9' ELSE concat('n', frame_id % 4) END", "second_required": "CASE WHEN frame_id % 5 = 0 THEN concat('n', (frame_id + 1) % 4) END", "first_preferred": "concat('n', (frame_id + 1) % 4)", "first_sacrificable": "CASE WHEN frame_id % 7 = 0 THEN 'n3' END", "risk": "CASE WHEN frame_id % 4 = 0 THEN 'edge' ELSE 'none' END",
}
_ENTITY_OF = {"kind": "CASE i % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'text_region' WHEN 2 THEN 'logo' ELSE 'screen' END", "label": "concat('label ', i, ' of ', source_id)", "features": "CASE WHEN i % 2 = 0 THEN ' wide ' ELSE '' END"}
_TEXT_OF = "CASE WHEN {0} = concat('n', source_id % 4) THEN 'target ' || source_id ELSE concat('label ', right({0}, 1), ' of ', source_id, CASE WHEN right({0}, 1) IN ('0', '2') THEN '; wide' ELSE '' END) END"


@query("c8_project_plan", _E, sql=f"""
, c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _CHOICES.items())} FROM e_candidate), i AS (SELECT *, list_filter([first_required, second_required], lambda x: x IS NOT NULL) AS required FROM c)
, t AS (SELECT *, list_filter([first_preferred], lambda x: NOT list_contains(required, x)) AS preferred, CASE WHEN focus_id IS NOT NULL THEN {_TEXT_OF.format("focus_id")} END AS h_target, array_to_string(list_transform(required, lambda x: {_TEXT_OF.format("x")}), ' | ') AS v_target FROM i)
, r AS (SELECT *, CASE WHEN vertical_strategy <> 'tracked_crop' THEN [] ELSE list_concat(list_transform(required, lambda x: 'required ' || x || ' ' || CASE right(x, 1) WHEN '0' THEN 'subject' WHEN '1' THEN 'text_region atomic' WHEN '2' THEN 'graphic atomic' ELSE 'ui_region atomic' END), list_transform(preferred, lambda x: 'preferred ' || x || ' ' || CASE right(x, 1) WHEN '0' THEN 'subject' WHEN '1' THEN 'text_region' WHEN '2' THEN 'graphic' ELSE 'ui_region' END),
    list_transform(list_filter(['n3'], lambda x: NOT list_contains(required, x) AND NOT list_contains(preferred, x) AND first_sacrificable IS NULL), lambda x: 'avoid_overlay ' || x || ' ui_region')) END AS regions FROM t)
, ch AS (SELECT DISTINCT chapter, chapter % 11 = 0 AS lost, 'c' || (1 + chapter % 3) AS h, 'c' || (1 + chapter % 2) AS v FROM e_candidate)
, bad AS (SELECT DISTINCT ch.chapter, 'entity_missing' AS rule FROM ch JOIN r USING (chapter) WHERE NOT lost AND first_required = 'n9' UNION SELECT chapter, 'selection_unknown' FROM ch WHERE NOT lost AND (NOT EXISTS (SELECT 1 FROM r WHERE r.chapter = ch.chapter AND candidate_id = h) OR NOT EXISTS (SELECT 1 FROM r WHERE r.chapter = ch.chapter AND candidate_id = v)))
, good AS (SELECT * FROM ch WHERE NOT lost AND chapter NOT IN (SELECT chapter FROM bad))
, o AS (SELECT g.chapter, string_agg(concat(candidate_id, ' ', zoom_intent, ' ', coalesce(h_target, '-')), ', ' ORDER BY candidate_id <> h, rank) AS horizontal, string_agg(concat(candidate_id, ' ', v_target, ' ', array_to_string(regions, '; ')), ', ' ORDER BY candidate_id <> v, rank) AS vertical FROM good g JOIN r USING (chapter) GROUP BY g.chapter)
SELECT o.chapter, CASE WHEN g.h = g.v THEN a.observed_visual_evidence ELSE concat('16:9: ', a.observed_visual_evidence, ' 9:16: ', b.observed_visual_evidence) END AS observed, CASE WHEN a.risk = b.risk THEN a.risk ELSE concat(a.risk, ',', b.risk) END AS risks, a.frame_id::VARCHAR AS horizontal_frame_id, b.frame_id::VARCHAR AS vertical_frame_id, round(least(a.confidence, b.confidence), 6) AS confidence, horizontal, vertical, NULL AS rule
FROM o JOIN good g USING (chapter) JOIN r a ON a.chapter = o.chapter AND a.candidate_id = h JOIN r b ON b.chapter = o.chapter AND b.candidate_id = v
UNION ALL SELECT chapter, 'No supported Clip Card evidence was selected.', 'No supported source evidence.', NULL, NULL, 0.0, '', '', NULL FROM ch WHERE lost UNION ALL SELECT chapter, NULL, NULL, NULL, NULL, NULL, NULL, NULL, rule FROM bad""")
def _c8(c):
    some = lambda *names: F.array_compact(F.array(*names))
    rows = c.withColumns({k: F.expr(v) for k, v in _CHOICES.items()}).withColumnsRenamed({"rank": "position", "source_id": "asset_id"}).withColumns({"frame_id": F.col("frame_id").cast("string"), "quality_risks": F.array("risk")})
    rows = rows.withColumns({"required": some("first_required", "second_required"), "preferred": some("first_preferred"), "sacrificable": some("first_sacrificable")})
    cards = c.select("source_id").distinct().withColumn("ids", F.sequence(F.lit(0), F.lit(3)))
    entity = c.select("source_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("source_id", F.struct(F.concat(F.lit("n"), F.col("i").cast("string")).alias("entity_id"), *[F.expr(v).alias(k) for k, v in _ENTITY_OF.items()]).alias("e"))
    target = F.array(F.struct(F.concat(F.lit("n"), (F.col("source_id") % 4).cast("string")).alias("entity_id"), F.concat(F.lit("target "), F.col("source_id").cast("string")).alias("target_description")))
    ids, none = F.transform("ids", lambda i: F.concat(F.lit("n"), i.cast("string"))), F.array().cast("array<string>")
    events = cards.join(entity.groupBy("source_id").agg(F.array_sort(F.collect_list("e")).alias("entities")), "source_id").select(
        F.col("source_id").alias("asset_id"), F.explode(F.transform("ids", lambda i: F.concat(F.lit("e"), i.cast("string")))).alias("event_id"), ids.alias("entity_ids"), *[none.alias(f"{k}_ids") for k in ("primary", "required", "optional")], F.array(F.lit("n3")).alias("avoid_overlay_ids"), "entities", target.alias("targets"),
    )
    chapters = c.select("chapter").distinct().select("chapter", F.when(F.col("chapter") % 11 == 0, "not_found").otherwise("supported").alias("evidence_status"), *[F.concat(F.lit("c"), (F.col("chapter") % n + 1).cast("string")).alias(f"{a}_candidate_id") for a, n in (("horizontal", 3), ("vertical", 2))])
    keep = ["chapter", "position", "candidate_id", "asset_id", "event_id", "frame_id", "observed_visual_evidence", "selection_reason", "quality_risks", "horizontal_strategy", "zoom_intent", "focus_id", "vertical_strategy", "crop_mode", "framing_intent", "required", "preferred", "sacrificable", "confidence"]
    made = projected_choices(chapters, rows.select(*keep), events)
    region = lambda r: F.concat_ws(" ", r["role"], r["entity_id"], r["kind"], F.when(r["atomic"], "atomic"))
    horizontal = F.transform("horizontal_candidates", lambda x: F.concat_ws(" ", x["candidate_id"], x["zoom_intent"], F.coalesce(x["target_description"], F.lit("-"))))
    vertical = F.transform("vertical_candidates", lambda x: F.concat_ws(" ", x["candidate_id"], x["target_description"], F.array_join(F.transform(x["regions"], region), "; ")))
    return made.select("chapter", F.col("observed_visual_evidence").alias("observed"), F.array_join("quality_risks", ",").alias("risks"), "horizontal_frame_id", "vertical_frame_id", F.round("confidence", 6).alias("confidence"), F.array_join(horizontal, ", ").alias("horizontal"), F.array_join(vertical, ", ").alias("vertical"), "rule")


# what a candidate refers to; in SQL that Spark and DuckDB share
_REFERS = {
    "asset_id": "source_id + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END", "event_id": "concat('e', CASE WHEN frame_id % 13 = 0 THEN 9 ELSE (source_id + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END) % 3 END)", "entity_id": "CASE WHEN frame_id % 29 = 1 THEN 77 ELSE (source_id + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END) % 4 END",
    "relation": "CASE WHEN rank % 4 = 3 THEN 'primary' ELSE 'event_member' END",
}


@query("v13_plan_evidence", _E, sql=f"""
, frames AS (SELECT frame_id, min(source_id) AS frame_asset, frame_id % 20 * 1000 + 500 AS frame_ms FROM e_candidate WHERE frame_id % 10 <> 0 GROUP BY frame_id), assets AS (SELECT DISTINCT source_id AS asset_id FROM e_candidate WHERE source_id % 19 <> 0)
, r AS (SELECT chapter, candidate_id, frame_id, {", ".join(f"{v} AS {k}" for k, v in _REFERS.items())} FROM e_candidate), j AS (SELECT r.*, a.asset_id IS NOT NULL AS held, frame_asset, frame_ms FROM r LEFT JOIN assets a ON a.asset_id = r.asset_id LEFT JOIN frames f ON f.frame_id = r.frame_id)
, k AS (SELECT chapter, candidate_id, CASE WHEN NOT held THEN 'unknown_asset' WHEN event_id <> concat('e', asset_id % 3) THEN 'unknown_event' WHEN frame_ms IS NULL THEN 'unknown_frame' WHEN frame_asset <> asset_id THEN 'frame_of_other_asset' WHEN frame_ms // 1000 < asset_id % 5 OR frame_ms // 1000 >= asset_id % 5 + 12 THEN 'frame_outside_event'
    WHEN entity_id NOT BETWEEN 0 AND 4 THEN 'unknown_entity' WHEN relation = 'primary' AND entity_id <> asset_id % 5 THEN 'relation_not_backed' WHEN relation = 'event_member' AND entity_id <> asset_id % 4 THEN 'relation_not_backed' END AS rule FROM j)
SELECT * FROM k WHERE rule IS NOT NULL""")
def _v13(c):
    r = c.selectExpr("chapter", "candidate_id", "frame_id", *[f"{v} AS {k}" for k, v in _REFERS.items()]).withColumn("refs", F.array(F.struct(F.col("entity_id").cast("long").alias("entity_id"), "relation")))
    frames = c.where("frame_id % 10 <> 0").groupBy("frame_id").agg(F.min("source_id").alias("frame_asset")).withColumn("frame_ms", F.col("frame_id") % 20 * 1000 + 500)
    ids, a = c.select(F.col("source_id").alias("asset_id")).distinct(), F.col("asset_id")
    longs = lambda *x: F.array(*[(v if not isinstance(v, int) else F.lit(v)).cast("long") for v in x])
    assets = ids.where("asset_id % 19 <> 0").select("asset_id", longs(0, 1, 2, 3, 4).alias("entity_ids"))
    events = ids.select("asset_id", F.concat(F.lit("e"), a % 3).alias("event_id"), (a % 5).alias("start_s"), (a % 5 + 12).alias("end_s"), F.create_map(F.lit("event_member"), longs(a % 4), F.lit("primary"), longs(a % 5)).alias("relations"))
    return K.plan_evidence_violations(r, assets, events, frames)


@query("v17_preflight_contract", _E, sql="""
, p AS (SELECT chapter, candidate_id, rank, confidence + CASE WHEN frame_id % 31 = 2 THEN 1 ELSE 0 END AS confidence, max_speed - CASE WHEN frame_id % 37 = 3 THEN 1000 ELSE 0 END AS max_speed, CASE WHEN frame_id % 41 = 4 THEN geometry_fingerprint ELSE sha256(geometry_fingerprint) END AS g, CASE WHEN frame_id % 43 <> 5 THEN sha256('s') END AS s, CASE WHEN frame_id % 47 = 6 THEN 'ABC' ELSE sha256('t') END AS t, role, role2 FROM e_candidate)
SELECT chapter, candidate_id, unnest(list_concat(CASE WHEN rank NOT BETWEEN 1 AND 4 THEN ['rank_range'] END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN ['confidence_range'] END, CASE WHEN max_speed < 0 THEN ['negative_motion'] END, CASE WHEN len(g) <> 64 THEN ['geometry_hash'] END, CASE WHEN s IS NULL THEN ['source_hash'] END, CASE WHEN t = 'ABC' THEN ['track_hash'] END, CASE WHEN role = role2 THEN ['duplicate_region'] END)) AS rule FROM p""")
def _v17c(c):
    when = lambda n, r, a, b: F.when(F.col("frame_id") % n == r, a).otherwise(b)
    g = F.col("geometry_fingerprint")
    return K.preflight_contract(c.withColumns({
        "confidence": F.col("confidence") + when(31, 2, 1, 0), "max_speed": F.col("max_speed") - when(37, 3, 1000, 0), "geometry_fingerprint": when(41, 4, g, F.sha2(g, 256)), "source_fingerprint": when(43, 5, F.lit(None).cast("string"), F.sha2(F.lit("s"), 256)),
        "track_fingerprints": F.array(when(47, 6, F.lit("ABC"), F.sha2(F.lit("t"), 256))), "region_ids": F.array("role", "role2"),
    }))


@query("v16_region_rules", _E, sql="""
, g AS (SELECT chapter, count(*) FILTER (WHERE role = 'hard_core') AS cores, count(*) FILTER (WHERE role = 'hard_core' AND min_visible < 1.0) AS low, count(*) AS n FROM e_candidate GROUP BY chapter)
SELECT chapter, 'no_required_region' AS rule FROM g WHERE cores = 0 UNION ALL SELECT chapter, 'required_not_full' FROM g WHERE low > 0 UNION ALL SELECT chapter, 'too_many_regions' FROM g WHERE n > 8""")
def _v16(c):
    return K.region_violations(c)


@query("v17_preflight_regions", _E, sql="SELECT chapter, candidate_id, 'full_visibility_required' AS rule FROM e_candidate WHERE (role = 'hard_core' OR atomic) AND min_visible <> 1.0 UNION ALL SELECT chapter, candidate_id, 'keepout_visibility_must_be_zero' FROM e_candidate WHERE role = 'overlay_keepout' AND min_visible <> 0.0")
def _v17(c):
    return K.preflight_violations(c)


@query("v20_policy_patch", _E, sql="""
, q AS (SELECT DISTINCT chapter + CASE WHEN chapter % 50 = 0 THEN 100000000 ELSE 0 END AS chapter, CASE chapter % 3 WHEN 0 THEN 'preserve_start' WHEN 1 THEN 'balanced' END AS edge, chapter % 2 = 0 AS clip, CASE chapter % 5 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'new' END AS bound FROM e_candidate)
, p AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE chapter % 77 = 0)
SELECT DISTINCT chapter, 'unknown_chapter' AS rule FROM p WHERE chapter NOT IN (SELECT chapter FROM e_candidate) UNION ALL SELECT chapter, 'duplicate_chapter' FROM p GROUP BY chapter HAVING count(*) > 1 UNION ALL SELECT DISTINCT chapter, 'edge_needs_clip' FROM p WHERE edge = 'preserve_start' AND NOT clip
UNION ALL SELECT DISTINCT chapter, 'clip_needs_binding' FROM p WHERE clip AND bound IS NULL UNION ALL SELECT DISTINCT chapter, 'binding_differs' FROM p WHERE bound <> 'new'""")
def _v20(c):
    ids = c.select("chapter").distinct()
    key = lambda n: F.col("chapter") % n
    p = ids.select(
        (F.col("chapter") + F.when(key(50) == 0, 100_000_000).otherwise(0)).alias("chapter"), F.when(key(3) == 0, "preserve_start").when(key(3) == 1, "balanced").alias("edge_priority"), (key(2) == 0).alias("controlled_clip"),
        F.when(key(5) == 1, "old").when(key(5) != 0, "new").alias("binding_sha256"), F.lit("new").alias("policy_sha256"),
    )
    p = p.unionByName(p.where("chapter % 77 = 0"))
    return K.policy_violations(p, ids)


@query("v24_replan", _E, sql="""
, s AS (SELECT chapter, candidate_id, rank + CASE WHEN frame_id % 100 = 0 THEN 1 ELSE 0 END AS rank FROM e_candidate), c AS (SELECT chapter, candidate_id, rank FROM e_candidate)
SELECT *, 'stored' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c) UNION ALL SELECT *, 'computed' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s)""")
def _v24(c):
    computed = c.select("chapter", "candidate_id", F.col("rank").cast("long").alias("rank"))
    stored = c.select("chapter", "candidate_id", (F.col("rank") + F.when(F.col("frame_id") % 100 == 0, 1).otherwise(0)).cast("long").alias("rank"))
    return K.replan_differences(stored, computed)


@query("v4_clip_cards", _E, sql="""
, ev AS (SELECT chapter, rank AS place, frame_id AS start_ms, source_id AS entity_id, CASE WHEN frame_id % 8 = 0 THEN 'other' ELSE 'kind-' || source_id % 3 END AS target_kind, lag(frame_id) OVER (PARTITION BY chapter ORDER BY rank) AS before FROM e_candidate)
SELECT chapter, place, 'not_ordered' AS rule FROM ev WHERE before > start_ms UNION ALL SELECT chapter, place, 'unknown_entity' FROM ev WHERE entity_id % 17 = 0 UNION ALL SELECT chapter, place, 'kind_differs' FROM ev WHERE entity_id % 17 <> 0 AND target_kind = 'other'""")
def _v4(c):
    kind = F.concat(F.lit("kind-"), (F.col("source_id") % 3).cast("string"))
    events = c.select("chapter", F.col("rank").alias("place"), F.col("frame_id").alias("start_ms"), F.col("source_id").alias("entity_id"), F.when(F.col("frame_id") % 8 == 0, "other").otherwise(kind).alias("target_kind"))
    return K.clip_card_violations(events, c.where("source_id % 17 <> 0").select(F.col("source_id").alias("entity_id"), kind.alias("entity_kind")))


@query("v4_whole_cards", "b_event", sql="""
, e AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms, event_id) AS place, event_id % 6 AS entity, 3 - event_id % 9 // 2 AS wanted FROM b_event)
, c AS (SELECT asset_id AS card_id, max(duration_ms) - CASE WHEN asset_id % 4 = 0 THEN 864000000 ELSE 0 END AS duration_ms FROM b_event GROUP BY asset_id)
, o AS (SELECT e.*, c.duration_ms AS lasts, lag(end_ms) OVER (PARTITION BY asset_id ORDER BY place) AS before FROM e JOIN c ON c.card_id = e.asset_id)
SELECT card_id + 100000 AS card_id, NULL::BIGINT AS event_id, 'no_events' AS rule FROM c WHERE card_id % 7 = 0 UNION ALL SELECT card_id, NULL, 'duplicate_entity' FROM c WHERE card_id % 5 = 0 UNION ALL SELECT asset_id, event_id, 'empty_interval' FROM o WHERE end_ms <= start_ms
UNION ALL SELECT asset_id, event_id, 'keyframe_outside' FROM o WHERE keyframe_ms < start_ms OR keyframe_ms >= end_ms UNION ALL SELECT asset_id, event_id, 'past_end' FROM o WHERE end_ms > lasts UNION ALL SELECT asset_id, event_id, 'overlap' FROM o WHERE start_ms < before
UNION ALL SELECT asset_id, event_id, 'unknown_entity' FROM o WHERE entity > 3 OR wanted < 0 UNION ALL SELECT asset_id, event_id, 'kind_differs' FROM o WHERE wanted BETWEEN 0 AND 3 AND wanted % 2 <> event_id % 2 UNION ALL SELECT asset_id, event_id, 'opportunity_unknown_entity' FROM o WHERE entity + 1 > 3""")
def _v4w(e):
    place = F.row_number().over(W.partitionBy("asset_id").orderBy("start_ms", "event_id"))
    n, card = F.col("event_id"), F.col("asset_id").alias("card_id")
    cards = e.groupBy(card).agg(F.max("duration_ms").alias("duration_ms")).withColumn("duration_ms", F.col("duration_ms") - F.when(F.col("card_id") % 4 == 0, 864_000_000).otherwise(0))
    entities = cards.select("card_id", F.explode(F.when(F.col("card_id") % 5 == 0, F.array(*map(F.lit, (0, 1, 2, 3, 0)))).otherwise(F.array(*map(F.lit, (0, 1, 2, 3))))).alias("i")).select("card_id", F.col("i").cast("long").alias("entity_id"), F.concat(F.lit("k"), F.col("i") % 2).alias("kind"))
    target = F.struct((3 - F.floor(n % 9 / 2)).cast("long").alias("entity_id"), F.concat(F.lit("k"), n % 2).alias("target_kind"))
    events = e.select(card, place.alias("place"), "event_id", "start_ms", "end_ms", "keyframe_ms", F.array((n % 6).cast("long")).alias("entity_ids"), F.array(target).alias("targets"), F.array(F.array((n % 6 + 1).cast("long"))).alias("opportunities"))
    return K.card_violations(cards.unionByName(cards.where("card_id % 7 = 0").withColumn("card_id", F.col("card_id") + 100_000)), events, entities)
