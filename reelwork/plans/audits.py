"""Audits of rendered segments (view g), policies and plans (view e)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import audits as A
from reelwork.operators import policies as L
from reelwork.operators.projection import plan_violations
from reelwork.operators.rounds import cut_lineage
from reelwork.plans.base import query
from reelwork.sources.views import SHA

# manifests of rendered segments, and the tracks that lie about; in SQL that Spark and DuckDB share
_TEXTS = {
    "first": """CASE n WHEN 1 THEN concat('{"regions": [{"region_id": "r0", "role": "required"}], "tracks": ["', f0, '"]}') ELSE concat('{"regions": [{"region_id": "r0", "role": "required"}, {"region_id": "r1", "role": "required"}], "tracks": ["', f0, '", "', f1, '"]}') END""",
    "second": """concat('{"contract_version":"feature-vertical-region-tracks-v2","regions":[{"region_id":"r0","role":"required"}', CASE WHEN n = 2 THEN ',{"region_id":"r1","role":"required"}' ELSE '' END, '],"tracks":["', f0, CASE WHEN n = 2 THEN concat('","', f1) ELSE '' END, '"]}')""",
}


def _manifests(engine: str, rows: str) -> str:
    sha = SHA[engine].format
    texts = {k: t.replace("{", "{{").replace("}", "}}") if engine == "spark" else t for k, t in _TEXTS.items()}  # Spark's reader of the text sees fields in braces
    return f"""SELECT *, CASE feature_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'bad' ELSE CASE WHEN n = 0 THEN f0 WHEN v2 THEN {sha(texts["second"])} ELSE {sha(texts["first"])} END END AS track_fingerprint
        FROM (SELECT *, feature_id % 3 AS n, feature_id % 5 = 0 AS v2, {sha("concat('t', feature_id, '-0')")} AS f0, {sha("concat('t', feature_id, '-1')")} AS f1, CASE WHEN feature_id % 19 = 7 THEN 'zz' ELSE concat('c', feature_id % 2) END AS vertical_candidate_id,
            CASE feature_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS failures, CASE WHEN feature_id % 10 = 3 THEN 'too wide' END AS fallback_reason, CASE WHEN feature_id % 8 < 2 THEN feature_id % 8 = 1 END AS requires_review FROM {rows}) x"""


def _tracks(engine: str, rows: str) -> str:
    return f"""SELECT project_id, feature_id, n, v2, track_fingerprint, concat('t', feature_id, '-', i, '-', cp) AS track_id, 'k' AS candidate_id, CASE WHEN n = 2 THEN concat('s', cp) END AS session_id, i AS place, concat('r', i) AS target_id, feature_id % 11 <> 3 AS sha_ok,
        CASE WHEN feature_id % 23 = 5 THEN {SHA[engine].format("'other'")} WHEN i = 0 THEN f0 ELSE f1 END AS fingerprint FROM {rows}, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(cp) WHERE (i = 0 OR n = 2) AND (cp = 0 OR feature_id % 13 = 4)"""


@query("c12_crop_audit", "g_segment", sql=f"""
, m AS ({_manifests("duckdb", "g_segment")}), t AS ({_tracks("duckdb", "m")})
, g AS (SELECT project_id, feature_id, n, v2, track_fingerprint, session_id, count(*) AS tracks, list(fingerprint ORDER BY place) AS fs, bool_and(sha_ok) AS fine FROM t GROUP BY project_id, feature_id, n, v2, track_fingerprint, session_id, CASE WHEN n < 2 THEN track_id END)
, h AS (SELECT *, CASE WHEN n = 0 THEN fs[1] WHEN v2 THEN sha256('{{"contract_version":"feature-vertical-region-tracks-v2","regions":[' || array_to_string(list_transform(range(n), lambda i: '{{"region_id":"r' || i || '","role":"required"}}'), ',') || '],"tracks":["' || array_to_string(fs, '","') || '"]}}')
    ELSE sha256('{{"regions": [' || array_to_string(list_transform(range(n), lambda i: '{{"region_id": "r' || i || '", "role": "required"}}'), ', ') || '], "tracks": ["' || array_to_string(fs, '", "') || '"]}}') END AS hash FROM g)
, k AS (SELECT feature_id, count(*) AS matches FROM h WHERE hash = track_fingerprint AND (n < 2 OR fine) GROUP BY feature_id)
, r AS (SELECT m.*, coalesce(matches, 0) AS matches, CASE WHEN feature_id % 17 = 6 THEN 'not_rendered' WHEN vertical_candidate_id NOT IN ('c0', 'c1', 'c2') THEN 'selection_unknown' WHEN track_fingerprint IS NULL THEN NULL WHEN NOT regexp_full_match(track_fingerprint, '[0-9a-f]{{64}}') THEN 'bad_fingerprint' WHEN coalesce(matches, 0) = 0 THEN 'no_lineage' WHEN matches > 1 THEN 'ambiguous_lineage' END AS rule,
    sum(CASE WHEN feature_id % 17 = 6 THEN 0 ELSE duration_ms END) OVER (PARTITION BY project_id ORDER BY pos)::BIGINT AS end_ms FROM m LEFT JOIN k USING (feature_id))
SELECT project_id, feature_id, end_ms - duration_ms AS start_ms, end_ms, CASE WHEN track_fingerprint IS NOT NULL THEN CASE WHEN v2 THEN ['full_auto_v2_single_track_fingerprint', 'full_auto_v2_single_region_fingerprint', 'full_auto_v2_shared_session_fingerprint'][n + 1] ELSE ['single_track_geometry_fingerprint', 'single_required_region_composite_geometry_fingerprint', 'shared_session_composite_geometry_fingerprint'][n + 1] END END AS match_kind,
    CASE WHEN feature_id % 2 = 0 THEN 'render_manifest_authoritative_geometry' WHEN track_fingerprint IS NULL OR n = 2 THEN NULL WHEN feature_id % 9 = 5 THEN 'current_algorithm_comparison_unavailable' ELSE 'current_algorithm_comparison_not_rendered_geometry' END AS source,
    vertical_candidate_id AS selected, array_to_string(list_filter(['c0', 'c1', 'c2'], lambda c: c <> vertical_candidate_id), ',') AS alternatives, failures = 0 AS contained, fallback_reason IS NULL AS fallback_free, coalesce(requires_review, false) OR feature_id % 6 = 0 AS review, NULL AS rule FROM r WHERE rule IS NULL
UNION ALL SELECT project_id, feature_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, rule FROM r WHERE rule IS NOT NULL""")
def _c12(s):
    spark = s.sparkSession
    m = spark.sql(_manifests("spark", "{rows}"), rows=s)
    tracks = spark.sql(_tracks("spark", "{rows}"), rows=m)
    f = F.col("feature_id")
    region = lambda i: F.when(F.col("n") > i, F.struct(F.lit(f"r{i}").alias("region_id"), F.lit("required").alias("role"), F.lit(False).alias("atomic"), F.lit(f'{{"region_id":"r{i}","role":"required"}}').alias("payload")))
    none = lambda kind: F.lit(None).cast(kind)
    rendered = m.where(f % 17 != 6).select(
        "project_id", "feature_id", "track_fingerprint", F.when(F.col("v2"), A.ROUTING_V2).alias("routing_version"), F.lit("k").alias("candidate_id"), F.array_compact(F.array(region(0), region(1))).alias("regions"), F.when(f % 2 == 0, F.array(F.lit(1))).alias("keyframes"),
        *[none("double").alias(c) for c in (*A.GEOMETRY, "safety")], none("string").alias("overflow_policy"), none("string").alias("edge_priority"), F.lit("clip").alias("source_clip_id"), F.lit(0).alias("source_in_ms"), F.col("duration_ms").alias("source_out_ms"), "duration_ms", none("string").alias("target_description"),
        none("string").alias("crop_mode"), F.lit("tracked_crop").alias("applied_strategy"), "fallback_reason", F.lit(True).alias("coverage_passed"), F.col("failures").alias("containment_failures"), F.lit(True).alias("full_containment_feasible"), F.when(f % 6 == 0, F.array(F.lit("fast"))).alias("risk_codes"), "requires_review",
    )
    cards = m.select("project_id", "feature_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    cards = cards.select("project_id", "feature_id", "position", F.concat(F.lit("c"), F.col("position").cast("string")).alias("candidate_id"), *[none("string").alias(c) for c in A.ALTERNATIVE[1:-1]], none("array<string>").alias("quality_risks"), F.lit("strict").alias("crop_mode"))
    side = F.when(f % 9 != 5, 1920)
    samples = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample_index"), "feature_id").select(
        "track_id", "sample_index", (F.col("sample_index") * 500).alias("t_ms"), F.lit("tracked").alias("state"), (f % 300 + F.col("sample_index") * 9).alias("x_min"), F.lit(100).alias("y_min"), (f % 300 + 120 + F.col("sample_index") * 9).alias("x_max"), F.lit(500).alias("y_max"), side.alias("source_width"), F.when(f % 9 != 5, 1080).alias("source_height"),
    )
    shots = m.select("project_id", "pos", "feature_id", F.lit("title").alias("title"), "vertical_candidate_id")
    made, wrong = A.audit_segments(shots, cards, rendered, tracks.drop("n", "v2", "track_fingerprint"), samples)
    checks = F.col("automated_checks")
    told = made.select(
        "project_id", "feature_id", F.col("timeline_start_ms").alias("start_ms"), F.col("timeline_end_ms").alias("end_ms"), "match_kind", "source", F.col("selected_candidate.candidate_id").alias("selected"), F.array_join(F.transform("alternative_candidates", lambda x: x["candidate_id"]), ",").alias("alternatives"),
        checks["required_region_containment_passed"].alias("contained"), checks["fallback_free"].alias("fallback_free"), F.col("requires_review").alias("review"), none("string").alias("rule"),
    )
    return told.unionByName(wrong, allowMissingColumns=True)


# policies over chapters: what their bindings say, some of it changed; in SQL that Spark and DuckDB share
_X = "CASE WHEN chapter % {0} = 1 THEN 'x' ELSE '' END"
_SAVED = {"saved_catalog": ("catalog", 7), "saved_brief": ("brief", 11), "saved_plan": ("plan", 0), "policy_sidecar": ("side", 13), "sidecar_catalog": ("catalog", 0), "sidecar_source_brief": ("old_brief", 0), "sidecar_source_plan": ("old_plan", 17), "sidecar_source_binding": ("old_binding", 41), "source_catalog": ("catalog", 0), "source_brief": ("old_brief", 43), "source_plan": ("old_plan", 0), "source_request": ("request", 19)}
_HASHES = {kind: f"concat('h{name}', {_X.format(salt) if salt else chr(39) * 2})" for kind, (name, salt) in _SAVED.items()}
_OWN = {"project": "concat('p', CASE WHEN chapter % 29 = 1 THEN 'x' ELSE '' END)", "model": "CASE WHEN chapter % 23 = 1 THEN 'x' ELSE 'm' END", "complete": "CASE WHEN chapter % 47 <> 1 THEN 'm' END", "selection": "CASE WHEN chapter % 53 = 1 THEN 'g' ELSE 'f' END"}
_NAMES = sorted({name for name, _ in _SAVED.values()})
_THERE = "NOT (name = 'request' AND chapter % 31 = 3) AND NOT (name = 'old_plan' AND chapter % 37 = 4)"


@query("v20_policy_lineage", "e_candidate", sql=f"""
, b AS (SELECT DISTINCT chapter, {", ".join(f"{v} AS {k}" for k, v in (_HASHES | _OWN).items())} FROM e_candidate)
, f AS (SELECT chapter, name, 'h' || name AS current FROM b, (SELECT unnest({_NAMES}) AS name) n WHERE {_THERE})
, k AS ({" UNION ALL ".join(f"SELECT chapter, '{kind}' AS kind, '{name}' AS name, {kind} AS saved FROM b" for kind, (name, _) in _SAVED.items())})
, m AS (SELECT k.chapter, kind, saved, current, CASE WHEN current IS NULL THEN 'no_file' ELSE 'differs' END AS rule FROM k LEFT JOIN f ON k.chapter = f.chapter AND k.name = f.name WHERE saved IS DISTINCT FROM current
    UNION ALL SELECT chapter, 'project', project, 'p', 'differs' FROM b WHERE project <> 'p' UNION ALL SELECT chapter, 'selection', 'f', selection, 'differs' FROM b WHERE selection <> 'f' UNION ALL SELECT chapter, 'saved_selection', 'f', selection, 'differs' FROM b WHERE selection <> 'f'
    UNION ALL SELECT chapter, 'saved_sidecar', 'hside', policy_sidecar, 'differs' FROM b WHERE policy_sidecar <> 'hside' UNION ALL SELECT chapter, 'saved_source_binding', 'hold_binding', sidecar_source_binding, 'differs' FROM b WHERE sidecar_source_binding <> 'hold_binding'
    UNION ALL SELECT chapter, 'saved_request_sha256', 'hrequest', source_request, 'differs' FROM b WHERE source_request <> 'hrequest' UNION ALL SELECT chapter, 'saved_model_id', model, complete, 'differs' FROM b WHERE model IS DISTINCT FROM complete
    UNION ALL SELECT chapter, 'source_model_id', NULL, NULL, 'not_complete' FROM b WHERE complete IS NULL)
SELECT chapter, kind, saved, current, rule FROM m""")
def _v20l(c):
    chapters = cut_lineage(c.select("chapter").distinct())  # read for the files and twice for the bindings, which are not made in each candidate's row
    b = chapters.withColumns({k: F.expr(v) for k, v in (_HASHES | _OWN).items()})
    path = lambda name: F.concat(F.lit("/"), F.col("chapter").cast("string"), F.lit(f"/{name}"))
    text, none = F.lit, F.lit(None).cast("string")
    model = {c: text("m") for c in L.MODEL_FIELDS}
    struct = lambda fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    version = {"binding_version": text(L.PLAN_BINDING_VERSION)}
    saved = version | model | {"origin": text(L.POLICY_ORIGIN), "catalog_sha256": F.col("saved_catalog"), "brief_sha256": F.col("saved_brief"), "plan_sha256": F.col("saved_plan"), "model_id": F.col("model"), "request_sha256": text("hrequest"), "reframe_policy_sidecar_sha256": text("hside"), "source_plan_binding_sha256": text("hold_binding"), "selection_fingerprint": text("f")}
    source = version | model | {
        "origin": text("fresh"), "catalog_path": path("catalog"), "catalog_sha256": F.col("source_catalog"), "brief_path": path("old_brief"), "brief_sha256": F.col("source_brief"), "plan_path": path("old_plan"), "plan_sha256": F.col("source_plan"), "request_path": path("request"), "request_sha256": F.col("source_request"), "model_id": F.col("complete"),
        **dict.fromkeys(("pointer_path", "projection_pointer_sha256", "pointer_record_sha256", "record_path", "record_root", "projection_record_sha256"), none), "record": struct(dict.fromkeys(("catalog_sha256", "brief_sha256", "feature_plan_sha256"), none)),
    }
    side = {
        "project_id": F.col("project"), "catalog_id": text("c"), "catalog_path": path("catalog"), "catalog_sha256": F.col("sidecar_catalog"), "source_brief_path": path("old_brief"), "source_brief_sha256": F.col("sidecar_source_brief"), "source_plan_path": path("old_plan"), "source_plan_sha256": F.col("sidecar_source_plan"),
        "source_binding_path": path("old_binding"), "source_binding_sha256": F.col("sidecar_source_binding"), "selection_fingerprint": text("f"),
    }
    policy = {"sidecar_path": path("side"), "sidecar_sha256": F.col("policy_sidecar"), "sidecar_root": F.concat(text("/"), F.col("chapter").cast("string"))}
    bundles = b.select(F.col("chapter").alias("bundle_id"), text("p").alias("project_id"), text("c").alias("catalog_id"), path("catalog").alias("catalog_path"), path("brief").alias("brief_path"), path("plan").alias("plan_path"), F.col("selection").alias("selection_fingerprint"), *[struct(x).alias(n) for n, x in (("saved", saved), ("source", source), ("sidecar", side), ("policy", policy))])
    files = b.select("chapter", F.explode(F.array(*map(F.lit, _NAMES))).alias("name")).where(_THERE).select(F.concat(text("/"), F.col("chapter").cast("string"), text("/"), F.col("name")).alias("path"), F.concat(text("h"), F.col("name")).alias("sha256"))
    return L.binding_mismatches(bundles, files).withColumnRenamed("bundle_id", "chapter")


_V16 = {
    "h_strategy": "CASE WHEN frame_id % 2 = 0 THEN 'tracked_reframe' ELSE 'original' END", "zoom_intent": "CASE WHEN frame_id % 2 = 0 AND frame_id % 13 <> 2 OR frame_id % 17 = 3 THEN 'subtle' ELSE 'none' END", "h_target": "CASE WHEN frame_id % 14 <> 4 THEN concat('t', frame_id) END", "v_strategy": "CASE WHEN frame_id % 3 = 0 THEN 'tracked_crop' ELSE 'fit_with_background' END",
    "v_target": "CASE WHEN frame_id % 5 = 0 THEN concat('t', frame_id) END", "n_regions": "CASE WHEN frame_id % 3 = 0 OR frame_id % 19 = 4 THEN frame_id % 4 ELSE 0 END", "first_role": "CASE WHEN frame_id % 7 = 1 THEN 'preferred' WHEN frame_id % 7 = 2 THEN 'avoid_overlay' ELSE 'required' END", "share": "CASE WHEN frame_id % 11 = 5 THEN 0.5 WHEN frame_id % 11 = 6 THEN 1.0 END",
    "frame": "concat(CASE WHEN frame_id % 31 = 7 THEN 'XF' ELSE 'RF' END, lpad(CAST(frame_id AS VARCHAR(9)), 6, '0'))",
}


@query("v16_plan_contract", "e_candidate", sql=f"""
, c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _V16.items())}, count(*) OVER (PARTITION BY chapter) AS n, count(*) OVER (PARTITION BY chapter, source_id, frame_id) AS same FROM e_candidate)
, o AS (SELECT chapter, candidate_id, unnest(list_filter([CASE WHEN frame LIKE 'XF%' THEN 'frame_id' END, CASE WHEN rank > 4 THEN 'rank_range' END], lambda x: x IS NOT NULL)) AS rule FROM c)
SELECT chapter, 'horizontal' AS aspect, candidate_id, rule FROM o UNION ALL SELECT chapter, 'vertical', candidate_id, rule FROM o
UNION ALL SELECT chapter, 'horizontal', candidate_id, 'reframe_needs_zoom_and_target' FROM c WHERE h_strategy = 'tracked_reframe' AND (zoom_intent = 'none' OR h_target IS NULL) UNION ALL SELECT chapter, 'horizontal', candidate_id, 'zoom_without_reframe' FROM c WHERE h_strategy = 'original' AND zoom_intent <> 'none'
UNION ALL SELECT chapter, 'vertical', candidate_id, 'crop_needs_target' FROM c WHERE v_strategy = 'tracked_crop' AND v_target IS NULL AND (n_regions = 0 OR first_role <> 'required' AND n_regions < 2) UNION ALL SELECT chapter, 'vertical', candidate_id, 'regions_without_crop' FROM c WHERE v_strategy <> 'tracked_crop' AND n_regions > 0
UNION ALL SELECT chapter, 'vertical', candidate_id, 'repeated_entity' FROM c WHERE n_regions = 3 UNION ALL SELECT chapter, 'vertical', candidate_id, 'required_not_whole' FROM c WHERE n_regions > 0 AND first_role = 'required' AND share = 0.5 UNION ALL SELECT chapter, 'vertical', candidate_id, 'keepout_with_share' FROM c WHERE n_regions > 0 AND first_role = 'avoid_overlay' AND share IS NOT NULL
UNION ALL SELECT DISTINCT chapter, NULL, NULL, a || '_two_to_four_options' FROM c, (SELECT unnest(['horizontal', 'vertical']) AS a) WHERE n = 1 OR n > 4 UNION ALL SELECT DISTINCT chapter, NULL, NULL, a || '_same_evidence' FROM c, (SELECT unnest(['horizontal', 'vertical']) AS a) WHERE same > 1
UNION ALL SELECT chapter, NULL, NULL, 'reframe_needs_zoom_and_target' FROM c WHERE rank = 1 AND h_strategy = 'tracked_reframe' AND (zoom_intent = 'none' OR h_target IS NULL) UNION ALL SELECT chapter, NULL, NULL, 'zoom_without_reframe' FROM c WHERE rank = 1 AND h_strategy = 'original' AND zoom_intent <> 'none'
UNION ALL SELECT chapter, NULL, NULL, 'crop_needs_target' FROM c WHERE rank = 1 AND v_strategy = 'tracked_crop' AND v_target IS NULL AND n_regions = 0 UNION ALL SELECT chapter, NULL, NULL, 'vertical_head_differs' FROM c WHERE rank = 1 AND chapter % 10 = 3 AND v_strategy <> 'tracked_crop'""")
def _v16p(c):
    text = F.lit
    none = F.lit(None)

    def region(x, i, name, role, share, entity):
        return F.when(x["n_regions"] > i, F.struct(text(name).alias("region_id"), entity.alias("entity_id"), text("d").alias("target_description"), text("subject").alias("kind"), role.alias("role"), text(False).alias("atomic"), share.cast("double").alias("minimum_visible_fraction"), F.array(text("seen")).alias("observable_relations")))

    def horizontal(x):
        return F.struct(*[x[k] for k in shared], text("e").alias("event_id"), x["frame"].alias("frame_id"), x["h_strategy"].alias("strategy"), x["zoom_intent"].alias("zoom_intent"), x["h_target"].alias("target_description"), text(0.5).alias("confidence"))

    def vertical(x):
        regions = F.array_compact(F.array(region(x, 0, "r0", x["first_role"], x["share"], text("e0")), region(x, 1, "r1", text("required"), none, text("e1")), region(x, 2, "r2", text("preferred"), none, text("e1"))))
        return F.struct(*[x[k] for k in shared], text("e").alias("event_id"), x["frame"].alias("frame_id"), x["v_strategy"].alias("strategy"), x["v_target"].alias("target_description"), regions.alias("regions"), text(0.5).alias("confidence"))

    # only numbers and ids are gathered; what they stand for is made in the chapter's row
    shared = ["candidate_id", "rank", "asset_id"]
    made = ", ".join(f"{v} AS {k}" for k, v in _V16.items()).replace("VARCHAR(9)", "STRING").replace("frame_id", "x.frame_id")
    g = c.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "source_id", "frame_id"))).alias("cards"))
    g = g.withColumn("cards", F.expr(f"transform(cards, x -> struct(x.candidate_id AS candidate_id, CAST(x.rank AS INT) AS rank, x.source_id AS asset_id, {made}))"))
    g = g.select("chapter", F.transform("cards", horizontal).alias("horizontal_candidates"), F.transform("cards", vertical).alias("vertical_candidates"))
    first, second = F.get("horizontal_candidates", F.lit(0)), F.get("vertical_candidates", F.lit(0))
    strategy = F.when((F.col("chapter") % 10 == 3) & (second["strategy"] != "tracked_crop"), "other").otherwise(second["strategy"])
    chapters = g.select(
        "chapter", text("supported").alias("evidence_status"), first["frame_id"].alias("horizontal_frame_id"), second["frame_id"].alias("vertical_frame_id"), first["strategy"].alias("horizontal_strategy"), first["zoom_intent"].alias("horizontal_zoom_intent"), first["target_description"].alias("horizontal_target_description"),
        strategy.alias("vertical_strategy"), second["target_description"].alias("vertical_target_description"), "horizontal_candidates", "vertical_candidates",
    )
    return plan_violations(chapters)
