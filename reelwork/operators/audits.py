"""The audit of a rendered vertical cut: each segment with its lineage, geometry, alternatives, checks and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.operators import crops
from reelwork.operators.rounds import cut_lineage

KEY = ["project_id", "feature_id"]
# fixed values: they go into a hash, or name where geometry comes from
REGION_TRACKS_V2 = "feature-vertical-region-tracks-v2"
ROUTING_V2 = "full-auto-candidate-routing-v2"
AUTHORITATIVE, RECOMPUTED, UNAVAILABLE = "render_manifest_authoritative_geometry", "current_algorithm_comparison_not_rendered_geometry", "current_algorithm_comparison_unavailable"
ALTERNATIVE = ("candidate_id", "source_asset_id", "source_clip_id", "event_id", "frame_id", "observed_visual_evidence", "selection_reason", "quality_risks")
GEOMETRY = ("max_speed_x", "max_speed_y", "max_speed", "max_acceleration")


def spaced_json(json: Column) -> Column:
    """Compact JSON with a blank behind each comma and colon outside of strings."""
    # each match ends at a comma or colon, the next begins there; possessive, so that the stack doesn't grow with the length of a string
    return F.regexp_replace(json, r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:]++)*+[,:])', "$1 ")


def region_tracks_sha256(regions: Column, fingerprints: Column, v2: Column) -> Column:
    """The hash of regions (JSON texts with sorted keys, in order) with the fingerprints of their tracks; in its first form JSON has blanks, in its second a version."""
    quoted = F.transform(fingerprints, lambda f: F.concat(F.lit('"'), f, F.lit('"')))
    body = lambda sep: F.concat(F.lit('"regions":['), F.array_join(regions, ","), F.lit('],"tracks":['), F.array_join(quoted, ","), F.lit("]}"))
    first = spaced_json(F.concat(F.lit("{"), body(",")))
    second = F.concat(F.lit(f'{{"contract_version":"{REGION_TRACKS_V2}",'), body(","))
    return F.sha2(F.when(v2, second).otherwise(first), 256)


def resolve_render_tracks(rendered: DataFrame, tracks: DataFrame) -> DataFrame:
    """(project_id, feature_id, match_kind, session_id, track_ids, rule): the tracks from which a segment was rendered, by the fingerprint that its manifest has.

    rendered: project_id, feature_id, track_fingerprint (null: rendered without one), routing_version, candidate_id (the routed one),
    regions (an array of region_id, role, atomic, payload, the region's JSON). tracks: project_id, feature_id, track_id,
    candidate_id, session_id and place (null outside a session), target_id, sha_ok (the file is the one that the session names),
    fingerprint. A render of several regions needs a session that names just these, in order, each with its hash; one of a
    single region a track of it; one of no region a track outside of sessions. Regions are the required ones, and where the
    routing is of the second version all but keepouts, with tracks of the routed candidate only. None and several are violations.
    """
    v2 = F.coalesce(F.col("routing_version") == ROUTING_V2, F.lit(False))
    held = F.when(v2, F.filter("regions", lambda r: r["role"] != "avoid_overlay")).otherwise(F.filter("regions", lambda r: r["role"] == "required"))
    fine = F.col("track_fingerprint").rlike("^[0-9a-f]{64}$")
    r = rendered.withColumns({"v2": v2, "held": F.coalesce(held, F.array().cast(rendered.schema["regions"].dataType)), "fine": F.coalesce(fine, F.lit(False))})
    asked = r.where("fine").select(*KEY, "track_fingerprint", "v2", F.when(F.col("v2"), F.col("candidate_id")).alias("_candidate"), F.transform("held", lambda x: x["region_id"]).alias("ids"), F.transform("held", lambda x: x["payload"]).alias("payloads"))
    t = tracks.join(asked, KEY).where("_candidate IS NULL OR candidate_id = _candidate")
    several, one = F.size("ids") >= 2, F.size("ids") == 1
    member = F.struct("place", "target_id", "track_id", "fingerprint", "sha_ok")
    sessions = t.where(several & F.col("session_id").isNotNull()).groupBy(*KEY, "candidate_id", "session_id").agg(F.array_sort(F.collect_list(member)).alias("m"), *[F.first(c).alias(c) for c in ("ids", "payloads", "track_fingerprint", "v2")])
    part = lambda f: F.transform("m", lambda x: x[f])
    of_sessions = sessions.where((part("target_id") == F.col("ids")) & F.forall("m", lambda x: x["sha_ok"]) & (region_tracks_sha256(F.col("payloads"), part("fingerprint"), F.col("v2")) == F.col("track_fingerprint")))
    of_region = (F.col("target_id") == F.get("ids", F.lit(0))) & (region_tracks_sha256(F.col("payloads"), F.array("fingerprint"), F.col("v2")) == F.col("track_fingerprint"))
    alone = t.where(~several & F.when(one, of_region).otherwise(F.col("session_id").isNull() & (F.col("fingerprint") == F.col("track_fingerprint"))))
    kind = lambda first, second: F.when(F.col("v2"), second).otherwise(first)
    matches = of_sessions.select(*KEY, kind("shared_session_composite_geometry_fingerprint", "full_auto_v2_shared_session_fingerprint").alias("match_kind"), "session_id", part("track_id").alias("track_ids"))
    of_one = F.when(one, kind("single_required_region_composite_geometry_fingerprint", "full_auto_v2_single_region_fingerprint")).otherwise(kind("single_track_geometry_fingerprint", "full_auto_v2_single_track_fingerprint"))
    matches = matches.unionByName(alone.select(*KEY, of_one.alias("match_kind"), "session_id", F.array("track_id").alias("track_ids")))
    found = matches.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("match_kind", "session_id", "track_ids")).alias("x"))
    n = F.coalesce("n", F.lit(0))
    rule = F.when(F.col("track_fingerprint").isNull(), None).when(~F.col("fine"), "bad_fingerprint").when(n == 0, "no_lineage").when(n > 1, "ambiguous_lineage")
    out = r.join(found, KEY, "left").withColumn("rule", rule)
    chosen = lambda c: F.when(F.col("rule").isNull(), F.col(f"x.{c}")).alias(c)
    return out.select(*KEY, chosen("match_kind"), chosen("session_id"), chosen("track_ids"), "rule")


def geometry_audit(rendered: DataFrame, resolved: DataFrame, samples: DataFrame) -> DataFrame:
    """(project_id, feature_id, source, authoritative, geometry): how the crop moved, as the manifest says; else as today's path of the one track says, for comparison only; else nothing.

    rendered has keyframes (null: the manifest kept none), max_speed_x, max_speed_y, max_speed, max_acceleration, safety, overflow_policy
    and edge_priority (null: 1, preserve_all, balanced). samples: track_id, sample_index, t_ms, state, the box, source_width,
    source_height (null in old tracks, which are not read again).
    """
    told = F.struct(*[F.col(c).cast("double").alias(c) for c in GEOMETRY])
    r = rendered.join(resolved.where("rule IS NULL"), KEY, "left_semi").withColumn("_told", F.col("keyframes").isNotNull())
    one = resolved.where("rule IS NULL AND size(track_ids) = 1").select(*KEY, F.get("track_ids", F.lit(0)).alias("track_id"))
    again = r.where("NOT _told").join(one, KEY).select(*KEY, "track_id", F.coalesce("safety", F.lit(1.0)).alias("safety"), F.coalesce("overflow_policy", F.lit("preserve_all")).alias("overflow_policy"), F.coalesce("edge_priority", F.lit("balanced")).alias("edge_priority"))
    usable = samples.where("state = 'tracked'")
    first = W.partitionBy("_segment").orderBy("sample_index")
    rows = again.withColumn("_segment", F.concat_ws("/", *KEY)).join(usable, "track_id")
    rows = rows.withColumn("seconds", (F.col("t_ms") - F.first("t_ms").over(first)) / 1000).drop("track_id").withColumnRenamed("_segment", "track_id")
    path = crops.crop_path(rows.where("source_width IS NOT NULL AND source_height IS NOT NULL"), 1080, 1920)
    names = rows.select(*KEY, "track_id", F.col("source_width").isNull() | F.col("source_height").isNull()).toDF(*KEY, "track_id", "blind").groupBy(*KEY, "track_id").agg(F.bool_or("blind").alias("blind"))
    made = names.join(crops.crop_audit(path).select("track_id", F.struct(*GEOMETRY).alias("geometry")), "track_id", "left")
    made = made.select(*KEY, F.when(F.col("blind"), UNAVAILABLE).otherwise(RECOMPUTED).alias("source"), F.lit(False).alias("authoritative"), F.when(~F.col("blind"), F.col("geometry")).alias("geometry"))
    return r.where("_told").select(*KEY, F.lit(AUTHORITATIVE).alias("source"), F.lit(True).alias("authoritative"), told.alias("geometry")).unionByName(made)


def ordered_shots(shots: DataFrame, sequence: DataFrame | None = None) -> DataFrame:
    """shots in their own order, or those of a budget's sequence (project_id, feature_id, pos) in its order."""
    return shots if sequence is None else shots.drop("pos").join(sequence.select(*KEY, "pos"), KEY)


def audit_segments(shots: DataFrame, candidates: DataFrame, rendered: DataFrame, tracks: DataFrame, samples: DataFrame, sequence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, violations (project_id, feature_id, rule)) of the segments of rendered cuts.

    shots: project_id, pos, feature_id, title, vertical_candidate_id. candidates: project_id, feature_id, position, ALTERNATIVE and
    crop_mode. rendered: one row a shot, the columns that resolve_render_tracks() and geometry_audit() read, and source_clip_id,
    source_in_ms, source_out_ms, duration_ms, target_description, crop_mode, applied_strategy, fallback_reason, coverage_passed,
    containment_failures, full_containment_feasible, risk_codes, requires_review. A segment with a violation (not rendered,
    selection unknown, no or ambiguous lineage) has no audit, but its time counts on the timeline.
    """
    ordered = ordered_shots(shots, sequence)
    r = rendered.withColumn("_rendered", F.lit(True)).withColumnRenamed("crop_mode", "rendered_crop_mode").withColumnRenamed("candidate_id", "_routed")
    c = candidates.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("position", *ALTERNATIVE, "crop_mode"))).alias("cards"))
    resolved = cut_lineage(resolve_render_tracks(rendered, tracks))  # read for the lineage and for the geometry
    chosen = lambda x: x["candidate_id"] == F.col("vertical_candidate_id")
    time = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(F.col("source_out_ms") - F.col("source_in_ms"))
    s = ordered.join(r, KEY, "left").join(c, KEY, "left").join(resolved.withColumnRenamed("rule", "_lineage"), KEY, "left").join(geometry_audit(rendered, resolved, samples), KEY, "left")
    s = s.withColumns({"selected_candidate": F.get(F.filter("cards", chosen), F.lit(0)), "_time": F.coalesce(time, F.lit(0))})
    end = F.sum("_time").over(W.partitionBy("project_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumns({"timeline_end_ms": end, "timeline_start_ms": end - F.col("_time")})
    rule = lambda known: F.when(F.col("_rendered").isNull(), "not_rendered").when(~known, "selection_unknown").otherwise(F.col("_lineage"))
    s = s.withColumn("rule", rule(F.col("selected_candidate").isNotNull()))
    # what is wrong with a segment needs neither its cards, its geometry nor its place in time
    known = candidates.select(*KEY, F.col("candidate_id").alias("vertical_candidate_id"), F.lit(True).alias("_known")).distinct()
    w = ordered.select(*KEY, "vertical_candidate_id").join(r.select(*KEY, "_rendered"), KEY, "left").join(resolved.select(*KEY, F.col("rule").alias("_lineage")), KEY, "left").join(known, [*KEY, "vertical_candidate_id"], "left")
    wrong = w.select(*KEY, rule(F.col("_known").isNotNull()).alias("rule")).where("rule IS NOT NULL")
    checks = F.struct(
        F.col("coverage_passed").alias("tracking_coverage_passed"), (F.col("containment_failures") == 0).alias("required_region_containment_passed"), "full_containment_feasible", F.col("fallback_reason").isNull().alias("fallback_free"), *GEOMETRY,
    )
    risks = F.coalesce("risk_codes", F.array().cast("array<string>"))
    audits = s.where("rule IS NULL").select(
        *KEY, "pos", "title", "timeline_start_ms", "timeline_end_ms", "source_clip_id", "source_in_ms", "source_out_ms", "selected_candidate", F.transform(F.filter("cards", lambda x: ~chosen(x)), lambda x: F.struct(*[x[f].alias(f) for f in ALTERNATIVE])).alias("alternative_candidates"),
        "applied_strategy", "fallback_reason", "target_description", F.coalesce("rendered_crop_mode", F.col("selected_candidate.crop_mode")).alias("effective_crop_mode"), "match_kind", "track_ids", "source", "authoritative", "geometry",
        checks.alias("automated_checks"), risks.alias("risk_codes"), (F.coalesce("requires_review", F.lit(False)) | (F.size(risks) > 0)).alias("requires_review"), F.lit("pending").alias("human_review"),
    )
    return audits, wrong


def legacy_shots(chapters: DataFrame, brief: DataFrame, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shots, candidates) of a plan with one selection a chapter: the candidate is named by its clip, as a clip's name is no asset's id.

    chapters: project_id, pos, feature_id, event_id, frame_id, observed_visual_evidence, selection_reason, quality_risks. brief:
    project_id, feature_id, title, crop_mode. rendered: project_id, feature_id, source_clip_id.
    """
    only = F.lit("legacy_selected")
    c = chapters.join(brief, KEY).join(rendered.select(*KEY, "source_clip_id"), KEY)
    shots = c.select("project_id", "pos", "feature_id", "title", only.alias("vertical_candidate_id"))
    return shots, c.withColumns({"position": F.lit(1), "candidate_id": only, "source_asset_id": F.lit(None).cast("string")}).select(*KEY, "position", *ALTERNATIVE, "crop_mode")
