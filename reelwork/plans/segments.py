"""Timelines, budgets, QA (view g) and text claims (view f)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.functions.text import normalized
from reelwork.operators import segments as G
from reelwork.plans.base import query

_TIME = """
, t AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM g_segment)
, timeline AS (SELECT *, start_ms + duration_ms AS end_ms FROM t)"""
# What a producer says of a segment, spelt alike for Spark and DuckDB.
_SAID = {
    "requires_review": "CASE feature_id % 7 WHEN 0 THEN true WHEN 1 THEN false END", "coverage_passed": "CASE feature_id % 5 WHEN 0 THEN false WHEN 1 THEN true END", "containment_feasible": "feature_id % 11 <> 0",
    "controlled_clip": "feature_id % 13 = 0", "fallback_reason": "CASE feature_id % 9 WHEN 0 THEN 'seed_anchor' WHEN 1 THEN '' END", "risk": "CASE feature_id % 4 WHEN 0 THEN ' zoom ' WHEN 1 THEN '  ' ELSE 'edge' END",
}
_FACTS = ", facts AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _SAID.items()) + " FROM g_segment)"
_REASONS = "concat_ws(',', CASE WHEN requires_review THEN 'manifest_requires_gemini_review' END, CASE WHEN NOT coverage_passed THEN 'required_region_tracking_coverage_failed' END, CASE WHEN NOT containment_feasible THEN 'required_region_full_containment_infeasible' END, CASE WHEN controlled_clip THEN 'controlled_required_region_clip' END, CASE WHEN fallback_reason <> '' THEN 'fallback:' || fallback_reason END, CASE WHEN trim(risk) <> '' THEN 'risk:' || trim(risk) END)"


def _facts(s):
    return s.withColumns({k: F.expr(v) for k, v in _SAID.items()}).withColumn("risk_codes", F.array("risk", "risk"))


@query("w9_timeline_cursor", "g_segment", sql=_TIME + " SELECT project_id, feature_id, start_ms, end_ms FROM timeline")
def _w9(s):
    return G.timeline(s).select("project_id", "feature_id", "start_ms", "end_ms")


@query("a18_budget_check", "g_segment", sql="""
, g AS (SELECT project_id, count(*) AS kept, sum(duration_ms)::BIGINT AS total_ms, bool_or(editorial_role = 'hook') AS has_hook, bool_or(editorial_role = 'closing') AS has_closing FROM g_segment WHERE keep GROUP BY project_id)
SELECT *, total_ms BETWEEN 20000 AND 90000 AS in_budget, total_ms BETWEEN 20000 AND 90000 AND has_hook AND has_closing AS passed FROM g""")
def _a18(s):
    return G.budget_check(s, 20_000, 90_000)


@query("a18_budget_violations", "g_segment", sql="""
, d AS (SELECT project_id, feature_id, CASE WHEN keep THEN 'keep' ELSE 'drop' END AS action FROM g_segment WHERE feature_id % 23 <> 0 UNION ALL SELECT project_id, feature_id, 'drop' FROM g_segment WHERE feature_id % 29 = 0 AND feature_id % 23 <> 0)
, q AS (SELECT project_id, feature_id FROM g_segment WHERE (keep AND feature_id % 19 <> 0 AND feature_id % 23 <> 0) OR (NOT keep AND feature_id % 31 = 0) UNION ALL SELECT project_id, feature_id FROM g_segment WHERE keep AND feature_id % 37 = 0)
, r AS (SELECT project_id, feature_id, editorial_role, unnest([duration_ms, duration_ms + CASE WHEN feature_id % 41 = 0 THEN 40 ELSE 0 END]) AS duration_ms FROM g_segment), one AS (SELECT project_id, feature_id, max(duration_ms) AS ms, max(editorial_role) AS role FROM r GROUP BY ALL)
, t AS (SELECT p.project_id, coalesce(sum(ms), 0) AS total, count(*) FILTER (WHERE role = 'hook') AS hooks, count(*) FILTER (WHERE role = 'closing') AS closings FROM (SELECT DISTINCT project_id FROM d) p LEFT JOIN (SELECT q.project_id, ms, role FROM q JOIN one USING (project_id, feature_id)) x ON p.project_id = x.project_id GROUP BY p.project_id)
SELECT project_id, 'total_time' AS rule FROM t WHERE total NOT BETWEEN 20000 AND 90000 UNION ALL SELECT project_id, 'no_hook' FROM t WHERE hooks = 0 UNION ALL SELECT project_id, 'no_closing' FROM t WHERE closings = 0
UNION ALL SELECT DISTINCT project_id, 'duplicate_decision' FROM (SELECT project_id FROM d GROUP BY project_id, feature_id HAVING count(*) > 1) UNION ALL SELECT DISTINCT project_id, 'duplicate_in_sequence' FROM (SELECT project_id FROM q GROUP BY project_id, feature_id HAVING count(*) > 1)
UNION ALL SELECT DISTINCT project_id, 'sequence_not_kept_set' FROM (SELECT project_id FROM d WHERE action = 'keep' AND feature_id NOT IN (SELECT feature_id FROM q) UNION ALL SELECT project_id FROM q WHERE feature_id NOT IN (SELECT feature_id FROM d WHERE action = 'keep'))
UNION ALL SELECT DISTINCT project_id, 'decisions_not_covering' FROM g_segment WHERE feature_id NOT IN (SELECT feature_id FROM d) UNION ALL SELECT DISTINCT project_id, 'aspects_differ' FROM (SELECT project_id FROM r GROUP BY project_id, feature_id HAVING count(DISTINCT duration_ms) > 1)""")
def _a18v(s):
    action = F.when(F.col("keep"), "keep").otherwise("drop").alias("action")
    decided = s.where("feature_id % 23 <> 0")
    decisions = decided.select("project_id", "feature_id", action).unionByName(decided.where("feature_id % 29 = 0").select("project_id", "feature_id", F.lit("drop").alias("action")))
    listed = s.where("(keep AND feature_id % 19 <> 0 AND feature_id % 23 <> 0) OR (NOT keep AND feature_id % 31 = 0)")
    sequence = listed.unionByName(s.where("keep AND feature_id % 37 = 0")).select("project_id", "feature_id", F.col("pos").alias("position"))
    both = F.array(F.struct(F.lit("horizontal").alias("aspect"), F.col("duration_ms").alias("ms")), F.struct(F.lit("vertical").alias("aspect"), (F.col("duration_ms") + F.when(F.col("feature_id") % 41 == 0, 40).otherwise(0)).alias("ms")))
    durations = s.select("project_id", "feature_id", "editorial_role", F.explode(both).alias("x")).select("project_id", "feature_id", "editorial_role", "x.aspect", F.col("x.ms").alias("duration_ms"))
    return G.budget_violations(decisions, sequence, durations, 20_000, 90_000)


@query("c17_budget_manifest", "g_segment", sql="""
, q AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos DESC) AS position FROM g_segment WHERE keep)
SELECT project_id, feature_id, position AS pos, coalesce(sum(duration_ms) OVER (PARTITION BY project_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM q""")
def _c17(s):
    from pyspark.sql import Window as W

    sequence = s.where("keep").select("project_id", "feature_id", F.row_number().over(W.partitionBy("project_id").orderBy(F.col("pos").desc())).alias("position"))
    return G.budget_manifest(s, sequence).select("project_id", "feature_id", "pos", "start_ms")


@query("f24_duration_ms", "g_segment", sql="SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN duration_ms WHEN feature_id % 3 = 1 THEN duration_ms - 100 END AS duration_ms FROM g_segment")
def _f24(s):
    given = F.when(F.col("feature_id") % 3 == 0, F.col("duration_ms"))
    end = F.when(F.col("feature_id") % 3 == 1, F.col("duration_ms")).otherwise(F.lit(0))
    return s.select("feature_id", G.duration_ms(given, F.lit(100), end).alias("duration_ms"))


# fields of a chapter, in SQL that Spark and DuckDB share
_CHAPTER = {
    "segment_id": "CASE WHEN feature_id % 3 = 0 THEN concat('seg-', feature_id) END", "segment_path": "CASE WHEN feature_id % 3 = 1 THEN concat('out/part/clip.', feature_id, '.mp4') END", "segment_render_fingerprint": "CASE WHEN feature_id % 3 = 2 AND feature_id % 7 <> 0 THEN concat('fingerprint-', feature_id, '-and-more-of-it') END",
    "expected_semantics": "CASE WHEN feature_id % 4 = 0 THEN concat('expect ', feature_id) END", "semantic_intent": "CASE WHEN feature_id % 4 = 1 THEN 'intent' ELSE '' END", "target_description": "CASE WHEN feature_id % 4 = 2 THEN editorial_role END",
    "given_ms": "CASE WHEN feature_id % 5 <> 0 THEN duration_ms END", "source_in_ms": "CASE WHEN feature_id % 10 = 0 THEN 100 END", "source_out_ms": "CASE WHEN feature_id % 10 = 0 THEN 100 + duration_ms END",
    "words": "CASE WHEN keep THEN concat(' ', editorial_role, ' ') ELSE '  ' END", "kind": "CASE feature_id % 6 WHEN 0 THEN 'Signage' WHEN 1 THEN 'face' WHEN 2 THEN 'text' ELSE '' END", "role": "CASE WHEN feature_id % 8 < 4 THEN 'required' WHEN feature_id % 8 = 4 THEN 'preferred' END",
}
_CHAPTERS = f"""
, chapters AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _CHAPTER.items())} FROM facts)
, said AS (SELECT *, coalesce(role, 'required') = 'required' AS needed, list_distinct(list_filter(list_concat([trim(words)], CASE WHEN coalesce(role, 'required') = 'required' AND lower(kind) IN ('signage', 'text') THEN [concat('label ', feature_id % 3), trim(words)] ELSE []::VARCHAR[] END), lambda x: x <> '')) AS texts FROM chapters)
, important AS (SELECT *, CASE WHEN len(texts) = 2 AND texts[1] <> trim(words) THEN list_reverse(texts) ELSE texts END AS important_text FROM said)"""


def _chapters(s):
    c = _facts(s).withColumns({k: F.expr(v) for k, v in _CHAPTER.items()})
    region = F.struct(F.concat(F.lit("r"), F.col("feature_id") % 2).alias("region_id"), F.col("kind").alias("kind"), F.col("role").alias("role"), F.concat(F.lit("label "), F.col("feature_id") % 3).alias("target_description"), F.col("words").alias("label"))
    return c.drop("duration_ms").withColumnRenamed("given_ms", "duration_ms").withColumns({"required_text": F.array("words", F.lit("")), "vertical_regions": F.array(region)})


@query("f25_flatten_text", "g_segment", sql=_FACTS + _CHAPTERS + " SELECT feature_id, array_to_string(important_text, ',') AS text FROM important")
def _f25(s):
    return G.important_text(_chapters(s)).select("feature_id", F.array_join("important_text", ",").alias("text"))


@query("f26_review_reasons", "g_segment", sql=_FACTS + f" SELECT feature_id, {_REASONS} AS reasons FROM facts")
def _f26(s):
    return G.review_reasons(_facts(s)).select("feature_id", F.array_join("reasons", ",").alias("reasons"))


_SEEN = {
    "semantic_match": "CASE WHEN feature_id % 97 = 0 THEN 'mismatch' WHEN feature_id % 13 = 0 THEN 'uncertain' ELSE 'match' END", "target_visibility": "CASE WHEN feature_id % 101 = 0 THEN 'not_visible' WHEN feature_id % 17 = 0 THEN 'partly_visible' ELSE 'clearly_visible' END",
    "important_text_status": "CASE WHEN feature_id % 103 = 0 THEN 'unreadable' WHEN feature_id % 19 = 0 THEN 'partial' ELSE 'complete' END", "issue": "CASE WHEN feature_id % 107 = 0 THEN 'identity_mismatch' WHEN feature_id % 23 = 0 THEN 'motion_blur' END",
}


@query("a16_qa_verdict", "g_segment", sql=_FACTS + f"""
, o AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _SEEN.items())} FROM facts WHERE project_id % 4 <> 1 OR {_REASONS} = '')
, g AS (SELECT project_id, bool_or(semantic_match = 'mismatch' OR target_visibility = 'not_visible' OR important_text_status IN ('not_visible', 'unreadable') OR coalesce(issue, '') IN ('identity_mismatch', 'semantic_mismatch')) AS critical,
    bool_and(semantic_match = 'match' AND target_visibility = 'clearly_visible' AND important_text_status IN ('not_applicable', 'complete') AND issue IS NULL) AS clean, bool_or({_REASONS} <> '') AS open FROM o GROUP BY project_id)
SELECT project_id, CASE WHEN critical THEN 'reject' WHEN clean AND NOT open THEN 'pass' ELSE 'review' END AS verdict FROM g""")
def _a16(s):
    seen = G.review_reasons(_facts(s)).where("project_id % 4 <> 1 OR size(reasons) = 0").withColumns({k: F.expr(v) for k, v in _SEEN.items()})
    return G.qa_verdict(seen.withColumn("issues", F.array_compact(F.array("issue"))), seen)


@query("u1_same_ids", "g_segment", sql="""
, a AS (SELECT DISTINCT feature_id FROM g_segment WHERE keep), b AS (SELECT DISTINCT feature_id FROM g_segment WHERE duration_ms > 5000)
SELECT feature_id, 'left' AS side FROM a WHERE feature_id NOT IN (SELECT feature_id FROM b) UNION ALL SELECT feature_id, 'right' FROM b WHERE feature_id NOT IN (SELECT feature_id FROM a)""")
def _u1(s):
    return G.same_ids(s.where("keep"), s.where("duration_ms > 5000"), ["feature_id"])


@query("v14_open_edit", "g_segment", sql="""
, g AS (SELECT project_id, count(*) AS n, sum(duration_ms) AS total, arg_min(editorial_role, pos) AS first, arg_max(editorial_role, pos) AS last FROM g_segment GROUP BY project_id)
SELECT project_id, 'shot_count' AS rule FROM g WHERE n NOT BETWEEN 10 AND 16 UNION ALL SELECT project_id, 'total_time' FROM g WHERE total NOT BETWEEN 60000 AND 90000 UNION ALL SELECT project_id, 'first_not_hook' FROM g WHERE first <> 'hook' UNION ALL SELECT project_id, 'last_not_closing' FROM g WHERE last <> 'closing'""")
def _v14(s):
    return G.open_edit_violations(s)


@query("v14_rushes", "g_segment", sql="""
, t AS (SELECT DISTINCT project_id, '16:9' AS a FROM g_segment WHERE project_id % 5 <> 0 UNION ALL SELECT DISTINCT project_id, '9:16' FROM g_segment UNION ALL SELECT DISTINCT project_id, '9:16' FROM g_segment WHERE project_id % 7 = 0)
SELECT project_id, 'aspects' AS rule FROM t GROUP BY project_id HAVING count(*) FILTER (WHERE a = '16:9') <> 1 OR count(*) FILTER (WHERE a = '9:16') <> 1 OR count(*) <> 2 UNION ALL SELECT DISTINCT project_id, 'duplicate_select' FROM (SELECT project_id FROM g_segment GROUP BY project_id, feature_id % 40 HAVING count(*) > 1)""")
def _v14r(s):
    of = lambda rows, a: rows.select("project_id").distinct().withColumn("aspect_ratio", F.lit(a))
    timelines = of(s.where("project_id % 5 <> 0"), "16:9").unionByName(of(s, "9:16")).unionByName(of(s.where("project_id % 7 = 0"), "9:16"))
    return G.rushes_violations(timelines, s.select("project_id", F.lit("9:16").alias("aspect_ratio"), (F.col("feature_id") % 40).alias("select_id")))


@query("v15_narrative_trims", "g_segment", sql="""
, e AS (SELECT feature_id AS event_id, feature_id % 10 AS asset, 1000 AS a, 1000 + duration_ms AS b FROM g_segment WHERE feature_id % 17 <> 0), c AS (SELECT project_id, feature_id, feature_id AS event_id, CASE WHEN feature_id % 19 = 0 THEN 99 ELSE feature_id % 10 END AS asset, 1000 - CASE WHEN feature_id % 11 = 0 THEN 1 ELSE 0 END AS i, 1000 + CASE WHEN feature_id % 13 = 0 THEN 0 ELSE duration_ms END AS o FROM g_segment)
SELECT * FROM (SELECT project_id, feature_id, CASE WHEN e.asset IS NULL THEN 'unknown_event' WHEN e.asset <> c.asset THEN 'wrong_asset' WHEN NOT (a <= i AND i < o AND o <= b) THEN 'outside_event' END AS rule FROM c LEFT JOIN e USING (event_id)) WHERE rule IS NOT NULL""")
def _v15t(s):
    events = s.where("feature_id % 17 <> 0").select(F.col("feature_id").alias("event_id"), (F.col("feature_id") % 10).alias("asset_id"), F.lit(1000).alias("event_start"), (1000 + F.col("duration_ms")).alias("event_end"))
    held = lambda n, a, b: F.when(F.col("feature_id") % n == 0, a).otherwise(b)
    chapters = s.select("project_id", "feature_id", F.col("feature_id").alias("event_id"), held(19, F.lit(99), F.col("feature_id") % 10).alias("asset_id"), (1000 - held(11, F.lit(1), F.lit(0))).alias("source_in_ms"), (1000 + held(13, F.lit(0), F.col("duration_ms"))).alias("source_out_ms"))
    return G.narrative_trims(chapters, events)


@query("v15_narrative_plan", "g_segment", sql="""
, p AS (SELECT * FROM g_segment WHERE feature_id % 13 <> 0), g AS (SELECT project_id, min(pos) AS a, max(pos) AS b, count(*) AS n, sum(duration_ms) AS total FROM p GROUP BY project_id)
SELECT project_id, 'order' AS rule FROM g WHERE a <> 1 OR b <> n UNION ALL SELECT project_id, 'total_time' FROM g WHERE total NOT BETWEEN 60000 AND 90000 UNION ALL SELECT DISTINCT project_id, 'missing_feature' FROM g_segment WHERE feature_id % 13 = 0""")
def _v15(s):
    return G.narrative_violations(s.where("feature_id % 13 <> 0"), s)


@query("v18_render_contract", "g_segment", sql="""
, c AS (SELECT project_id, sum(duration_ms)::BIGINT AS total FROM g_segment GROUP BY project_id)
, r AS (SELECT project_id, total, CASE WHEN project_id % 11 = 0 THEN 'b' ELSE 'a' END AS h, CASE WHEN project_id % 9 = 0 THEN 720 ELSE 1080 END AS w, CASE WHEN project_id % 8 = 0 THEN 1080 WHEN project_id % 9 = 0 THEN 1280 ELSE 1920 END AS height, total + CASE WHEN project_id % 6 = 0 THEN 700 ELSE 300 END AS d, total + CASE WHEN project_id % 5 = 0 THEN 0 ELSE 300 END AS dd FROM c)
SELECT project_id, 'hash' AS rule FROM r WHERE h <> 'a' UNION ALL SELECT project_id, 'aspect' FROM r WHERE w * 16 <> height * 9 UNION ALL SELECT project_id, 'size' FROM r WHERE w <> 1080 OR height <> 1920 UNION ALL SELECT project_id, 'declared_duration' FROM r WHERE abs(d - dd) > 250 UNION ALL SELECT project_id, 'duration' FROM r WHERE abs(d - total) > 500""")
def _v18(s):
    when = lambda n, a, b: F.when(F.col("project_id") % n == 0, a).otherwise(b)
    r = s.groupBy("project_id").agg(F.sum("duration_ms").alias("total")).select(
        "project_id", when(11, F.lit("b"), F.lit("a")).alias("sha256"), F.lit("a").alias("declared_sha256"), when(9, F.lit(720), F.lit(1080)).alias("width"), when(8, F.lit(1080), when(9, F.lit(1280), F.lit(1920))).alias("height"), F.lit(1080).alias("declared_width"), F.lit(1920).alias("declared_height"),
        (F.col("total") + when(6, F.lit(700), F.lit(300))).alias("duration_ms"), (F.col("total") + when(5, F.lit(0), F.lit(300))).alias("declared_duration_ms"),
    )
    return G.render_violations(r, s)


_CONTRACT = _FACTS + _CHAPTERS + f"""
, twice AS (SELECT * REPLACE (coalesce(given_ms, source_out_ms - source_in_ms) AS duration_ms) FROM important UNION ALL SELECT * REPLACE (coalesce(given_ms, source_out_ms - source_in_ms) AS duration_ms, pos + 1000 AS pos) FROM important WHERE feature_id % 43 = 0)
, named AS (SELECT *, coalesce(segment_id, CASE WHEN segment_path IS NOT NULL THEN concat('clip.', feature_id) END, segment_render_fingerprint[1:16]) AS name, coalesce(expected_semantics, nullif(semantic_intent, ''), target_description, 'No explicit semantic expectation was recorded; observe conservatively.') AS expected FROM twice)
, timed AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, row_number() OVER (PARTITION BY project_id, feature_id, name ORDER BY pos) AS nth FROM named)
, contract AS (SELECT project_id, feature_id, name AS segment_id, pos, start_ms, start_ms + duration_ms AS end_ms, duration_ms, expected AS expected_semantics, target_description, array_to_string(important_text, ',') AS important_text, CASE WHEN needed THEN 1 ELSE 0 END::BIGINT AS regions, {_REASONS} AS reasons, len(important_text) > 0 AS text_check,
    CASE WHEN name IS NULL THEN 'no_identity' WHEN coalesce(duration_ms, 0) <= 0 THEN 'no_duration' WHEN nth > 1 THEN 'duplicate_identity' END AS rule FROM timed)"""


def _contract(s):
    c = _chapters(s)
    return G.segment_contract(c.unionByName(c.where("feature_id % 43 = 0").withColumn("pos", F.col("pos") + 1000)))


@query("c11_segment_contract", "g_segment", sql=_CONTRACT + " SELECT * FROM contract")
def _c11(s):
    c = _contract(s).withColumns({"important_text": F.array_join("important_text", ","), "reasons": F.array_join("reasons", ","), "regions": F.size("required_regions")})
    return c.drop("required_regions", "requires_review", "risk_codes")


@query("v19_qa_result", "g_segment", sql=_CONTRACT + """
, r AS (SELECT project_id, pos, feature_id + CASE WHEN feature_id % 31 = 0 THEN 1 ELSE 0 END AS got, text_check OR feature_id % 7 = 0 AS checked FROM contract WHERE feature_id % 41 <> 0)
SELECT c.project_id, c.pos, CASE WHEN got IS NULL THEN 'missing' WHEN got <> feature_id THEN 'wrong_segment' ELSE 'text_check' END AS rule FROM contract c LEFT JOIN r ON c.project_id = r.project_id AND c.pos = r.pos WHERE got IS NULL OR got <> feature_id OR checked <> text_check""")
def _v19(s):
    c = _contract(s)
    r = c.where("feature_id % 41 <> 0").select("project_id", "pos", (F.col("feature_id") + F.when(F.col("feature_id") % 31 == 0, 1).otherwise(0)).alias("feature_id"), (F.col("text_check") | (F.col("feature_id") % 7 == 0)).alias("text_check"))
    return G.qa_result_mismatches(c, r)


_READ = "CASE WHEN (claim_id + pos) % 5 = 0 THEN ' - ' ELSE relevant_text END"
_CLAIM = "CASE claim_id % 3 WHEN 0 THEN 'n-o' WHEN 1 THEN 'a f' ELSE 'R.F' END"
_CHOSEN = "CASE claim_id % 7 WHEN 0 THEN 'N O' WHEN 1 THEN 'a-f' END"
_TEXT = f"""
, o AS (SELECT claim_id, pos, {_READ} AS said FROM f_text), n AS (SELECT *, regexp_replace(upper(said), '[^A-Z0-9]', '', 'g') AS key FROM o)
, c AS (SELECT claim_id, key, count(*) AS votes, min(pos) AS first, arg_min(said, pos) AS text FROM n GROUP BY claim_id, key)
, r AS (SELECT *, sum(votes) OVER (PARTITION BY claim_id)::BIGINT AS total, row_number() OVER (PARTITION BY claim_id ORDER BY key <> '' DESC, votes DESC, first) AS rn FROM c)
, k AS (SELECT claim_id, key, text, CASE WHEN key <> '' THEN votes ELSE 0 END AS votes, total, key = regexp_replace(upper({_CLAIM}), '[^A-Z0-9]', '', 'g') AS matches, coalesce(regexp_replace(upper({_CHOSEN}), '[^A-Z0-9]', '', 'g') = key, true) AS methods_agree FROM r WHERE rn = 1)"""


def _consensus(t):
    claims = t.select("claim_id").distinct().select("claim_id", F.expr(_CLAIM).alias("claim_text"), F.expr(_CHOSEN).alias("selected_text"))
    return G.text_consensus(t.withColumn("relevant_text", F.expr(_READ)), claims)


@query("f10_normalize_text", "f_text", sql="SELECT claim_id, pos, regexp_replace(upper(relevant_text), '[^A-Z0-9]', '', 'g') AS text FROM f_text")
def _f10(t):
    return t.select("claim_id", "pos", normalized(F.col("relevant_text")).alias("text"))


@query("a15_text_consensus", "f_text", sql=_TEXT + " SELECT claim_id, text, votes, total FROM k")
def _a15(t):
    return _consensus(t).select("claim_id", "text", "votes", "total")


@query("c19_text_verification", "f_text", sql=_TEXT + " SELECT claim_id, text, votes, total, matches, methods_agree, CASE WHEN NOT methods_agree OR (key <> '' AND votes = total AND NOT matches) THEN 'needs_human_review' WHEN key <> '' AND votes = total THEN 'machine_verified' ELSE 'uncertain' END AS status FROM k")
def _c19(t):
    return _consensus(t)
