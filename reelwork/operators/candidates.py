"""Ranked candidates of chapters: gates, recovery, ranking, overrides and their contracts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.text import canonical_sha256

SOFT_FLOOR = 0.72
MOTION = ("crop_speed_above_maximum", "crop_acceleration_above_maximum", "crop_jerk_above_maximum")
TARGETING = ("semantic_match_below_minimum", "target_ambiguity_above_maximum", "track_confidence_below_minimum", "track_coverage_below_minimum")
REVIEW = ("semantic_match_below_minimum", "target_ambiguity_above_maximum", "identity_switch_detected", "source_lineage_invalid")


@dataclass(frozen=True)
class Policy:
    """Limits of the automatic reframing. Names and defaults are fixed values: they go into the policy's hash."""

    policy_id: str = "auto_bounded_clip_v1"
    max_candidates: int = 4
    max_alternate_seeds_per_candidate: int = 1
    max_repairs: int = 1
    minimum_evidence_confidence: float = 0.0
    max_crop_speed_pixels_per_second: float = 720.0
    max_crop_acceleration_pixels_per_second_squared: float = 1800.0
    max_crop_jerk_pixels_per_second_cubed: float = 7200.0
    require_semantic_checkpoints: bool = False
    allow_safe_center_crop: bool = False

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _rules(*rules: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*rules)))


def _region_codes(region: Column) -> Column:
    """The codes of one region (region_id, role, atomic, assessed, min_visible, required_visible, overlap)."""
    full = (region["role"] == "hard_core") | region["atomic"]
    clipped = F.when(full & (region["min_visible"] < 1.0), F.when(region["atomic"], "atomic_region_clipped").otherwise("hard_core_not_fully_retained"))
    soft = F.when((region["role"] == "soft_extent") & (region["min_visible"] + 1e-6 < region["required_visible"]), F.lit("soft_extent_below_minimum"))
    keepout = F.when((region["role"] == "overlay_keepout") & (region["overlap"] > 0), F.lit("overlay_keepout_violated"))
    unseen = F.array(F.when(full, F.lit("hard_core_not_fully_retained")))
    return F.when(region["assessed"], F.array(clipped, soft, keepout)).otherwise(unseen)


def failure_codes(policy: Policy) -> Column:
    """The gates that a candidate fails, in order, each once.

    Candidates have lineage_ok, single_shot, confidence, semantic_status, confidence_ok, coverage_ok,
    checkpoints_ok (null: not checked), regions (an array, see _region_codes()), max_speed,
    max_acceleration, max_jerk, geometry_fingerprint, expected_fingerprint (null: not compared), strategy.
    """
    say = lambda when, code: F.when(when, F.lit(code))
    switched = ~F.coalesce("checkpoints_ok", F.lit(not policy.require_semantic_checkpoints))
    before = (
        say(~F.col("lineage_ok"), "source_lineage_invalid"), say(~F.col("single_shot"), "shot_boundary_crossing"), say(F.col("confidence") < policy.minimum_evidence_confidence, "evidence_confidence_below_minimum"),
        say(F.col("semantic_status") == "ambiguous", "target_ambiguity_above_maximum"), say(F.col("semantic_status").isin("not_visible", "target_mismatch", "insufficient_evidence"), "semantic_match_below_minimum"),
        say(~F.col("confidence_ok"), "track_confidence_below_minimum"), say(~F.col("coverage_ok"), "track_coverage_below_minimum"), say(switched, "identity_switch_detected"),
    )
    after = (
        say(F.col("max_speed") > policy.max_crop_speed_pixels_per_second, "crop_speed_above_maximum"), say(F.col("max_acceleration") > policy.max_crop_acceleration_pixels_per_second_squared, "crop_acceleration_above_maximum"),
        say(F.col("max_jerk") > policy.max_crop_jerk_pixels_per_second_cubed, "crop_jerk_above_maximum"), say(F.col("geometry_fingerprint") != F.col("expected_fingerprint"), "geometry_fingerprint_mismatch"),
        say((F.col("strategy") == "center_crop") & F.lit(not policy.allow_safe_center_crop), "no_feasible_presentation"),
    )
    # only regions can fail a gate twice, so only their codes go through functions of arrays, which are slow
    of_regions = F.array_distinct(F.flatten(F.transform("regions", _region_codes)))
    text = F.when(of_regions.isNotNull(), F.concat_ws(",", *before, of_regions, *after))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def with_codes(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return candidates.withColumn("codes", failure_codes(policy)).withColumn("passed", F.size("codes") == 0)


def recovery(codes: Column, remaining: Column, seed_remaining: Column | None = None) -> Column:
    """What to try after failed gates; the first rule that holds."""
    has = lambda names: F.arrays_overlap(codes, F.array(*map(F.lit, names)))
    seed_remaining = F.lit(False) if seed_remaining is None else seed_remaining
    only_keepout = (F.size(codes) > 0) & (F.size(F.array_except(codes, F.array(F.lit("overlay_keepout_violated")))) == 0)
    return F.when(has(["shot_boundary_crossing"]), "split_at_shot_boundary").when(only_keepout, "reposition_overlay").when(has(MOTION), "try_simpler_motion").when(seed_remaining & has(TARGETING), "try_alternate_seed").when(remaining, "try_next_candidate").when(has(REVIEW), "review_required").otherwise("fit_with_background")


def codes_from_error(text: Column) -> Column:
    t = F.lower(text)
    any_of = lambda *marks: F.greatest(*[t.contains(m) for m in marks], F.lit(False))
    return F.when(t.contains("ambiguous"), "target_ambiguity_above_maximum").when(any_of("not_visible", "target_mismatch", "insufficient_evidence", "request_match"), "semantic_match_below_minimum").when(t.contains("confidence"), "track_confidence_below_minimum").when(any_of("coverage", "fewer_than_two"), "track_coverage_below_minimum").when(t.contains("shot") & t.contains("boundary"), "shot_boundary_crossing").otherwise("no_feasible_presentation")


def execution_role(role: Column, required: Column, atomic: Column) -> Column:
    return F.when(role == "avoid_overlay", "overlay_keepout").when(required | atomic, "hard_core").otherwise("soft_extent")


def visibility_floor(role: Column, given: Column) -> Column:
    return F.when(role == "hard_core", 1.0).when(role == "overlay_keepout", 0.0).otherwise(F.coalesce(given, F.lit(SOFT_FLOOR)))


def rank_preflights(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """candidates with place: passing ones first, then by rank and id."""
    return with_codes(candidates, policy).withColumn("place", F.row_number().over(W.partitionBy("chapter").orderBy((~F.col("passed")).cast("int"), "rank", "candidate_id")))


def first_accepted(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(chapter, winner, winner_rank, outcome): the first crop that passes in order of rank, else the first that fits with a background, else the first option blocked."""
    c = with_codes(candidates, policy)
    fit = F.col("strategy") == "fit_with_background"
    best = lambda when: F.min(F.when(when, F.struct("rank", "candidate_id")))
    g = c.groupBy("chapter").agg(best(~fit & F.col("passed")).alias("crop"), best(fit).alias("fit"), best(F.lit(True)).alias("first"))
    outcome = F.when(F.col("crop").isNotNull(), "accepted_crop").when(F.col("fit").isNotNull(), "deferred_fit").otherwise("policy_blocked_preview_fit")
    won = F.coalesce("crop", "fit", "first")
    return g.select("chapter", won["candidate_id"].alias("winner"), won["rank"].alias("winner_rank"), outcome.alias("outcome"))


def attempts(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The candidates tried: all up to the accepted crop, or all of them."""
    won = first_accepted(candidates, policy)
    return with_codes(candidates, policy).join(won, "chapter").where((F.col("outcome") != "accepted_crop") | (F.col("rank") <= F.col("winner_rank")))


def auto_route(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Each attempt with its codes, what follows, and the chapter's outcome.

    A column seeds_tried, where there is one, counts the other seeds that a candidate has been tracked from; the policy allows
    max_alternate_seeds_per_candidate of them.
    """
    last = F.max("rank").over(W.partitionBy("chapter"))
    a = attempts(candidates, policy).withColumn("remaining", F.col("rank") < last)
    seeds = F.col("seeds_tried") < policy.max_alternate_seeds_per_candidate if "seeds_tried" in candidates.columns else None
    return a.withColumn("action", F.when(F.col("passed"), "accept").otherwise(recovery(F.col("codes"), F.col("remaining"), seeds)))


def code_histogram(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return attempts(candidates, policy).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def reframe_summary(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row: chapters, attempts, chapters that switched from their first option, blocked ones, and attempts to review."""
    won = first_accepted(candidates, policy).agg(F.count("*").alias("chapters"), F.count_if(F.col("winner_rank") > 1).alias("switched"), F.count_if(F.col("outcome") == "policy_blocked_preview_fit").alias("blocked"))
    tried = auto_route(candidates, policy).agg(F.count("*").alias("attempts"), F.count_if(F.col("action") == "review_required").alias("review_required"))
    return won.crossJoin(tried)


def candidate_options(candidates: DataFrame, most: int, bound: Column) -> DataFrame:
    """The first candidates of each chapter by rank; only the first where a human policy is bound."""
    place = F.row_number().over(W.partitionBy("chapter").orderBy("rank", "candidate_id"))
    return candidates.withColumn("option", place).where((F.col("option") <= most) & (~bound | (F.col("option") == 1)))


def selected_first(candidates: DataFrame, selected: Column) -> DataFrame:
    """candidates with new_rank: the selected one first, the others in their order."""
    return candidates.withColumn("new_rank", F.row_number().over(W.partitionBy("chapter").orderBy((~selected).cast("int"), "rank", "candidate_id")))


def topk_violations(candidates: DataFrame, selected: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(chapter, rule): how many candidates, unique ids and evidence, ranks from 1 without gaps, selected one present and first."""
    different = lambda c: F.size(F.collect_set(c))
    g = candidates.groupBy("chapter").agg(F.count("*").alias("n"), different("frame_id").alias("frames"), F.min("rank").alias("a"), F.max("rank").alias("b"), different("rank").alias("ranks"), F.min_by("candidate_id", "rank").alias("first"), F.collect_set("candidate_id").alias("all")).withColumn("ids", F.size("all"))
    g = g.join(selected, "chapter", "left")
    rules = _rules(
        F.when((F.col("n") < least) | (F.col("n") > most), F.lit("count")), F.when(F.col("ids") < F.col("n"), F.lit("duplicate_id")), F.when(F.col("frames") < F.col("n"), F.lit("same_evidence")),
        F.when((F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("ranks") != F.col("n")), F.lit("ranks")), F.when(F.col("selected").isNull() | ~F.array_contains("all", F.col("selected")), F.lit("selected_missing")), F.when(F.col("selected") != F.col("first"), F.lit("selected_not_first")),
    )
    return g.select("chapter", F.explode(rules).alias("rule"))


def alternatives(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    return candidates.join(selected, "chapter").where("candidate_id <> selected").drop("selected")


def canonical_plan(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates with zoom and focus put right where the strategy is 'original', and the changes (path, before, after, rule)."""
    original = F.col("strategy") == "original"
    fixed = candidates.withColumns({"zoom": F.when(original, F.lit("none")).otherwise(F.col("zoom")), "focus": F.when(~original, F.col("focus"))})
    change = lambda c, after, rule: F.when(original & ~F.col(c).eqNullSafe(after), F.struct(F.concat_ws(".", "chapter", "candidate_id", F.lit(c)).alias("path"), F.col(c).cast("string").alias("before"), after.cast("string").alias("after"), F.lit(rule).alias("rule")))
    changes = F.array_compact(F.array(change("zoom", F.lit("none"), "original_has_no_zoom"), change("focus", F.lit(None).cast("string"), "original_has_no_focus")))
    return fixed, candidates.select(F.explode(changes).alias("x")).select("x.*")


def canonical_regions(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions that are hard cores or atomic get visibility 1; and the changes."""
    full = (F.col("role") == "hard_core") | F.col("atomic")
    fixed = regions.withColumn("min_visible", F.when(full, 1.0).otherwise(F.col("min_visible")))
    changes = regions.where(full & (F.col("min_visible") != 1.0)).select("chapter", "candidate_id", F.round("min_visible", 6).alias("before"), F.lit(1.0).alias("after"))
    return fixed, changes


def resolve_intent(candidates: DataFrame, brief: DataFrame) -> DataFrame:
    """(chapter, candidate_id, regions, target): its own regions, else the brief's; its own target, else the brief's."""
    b = brief.select("chapter", F.col("regions").alias("_regions"), F.col("target").alias("_target"))
    regions = F.when(F.size("regions") > 0, F.col("regions")).otherwise(F.coalesce("_regions", F.array().cast("array<string>")))
    joined = F.array_join(F.filter("regions", lambda x: x.startswith("core:")), "; ")
    target = F.coalesce(F.when(joined != "", joined), "target", "_target")
    return candidates.join(b, "chapter", "left").select("chapter", "candidate_id", regions.alias("regions"), target.alias("target"))


def review_reasons(regions: DataFrame, geometries: DataFrame) -> DataFrame:
    """(chapter, reasons) that call for a semantic review, in order.

    regions: chapter, role (on the renderer's side), kind, atomic. geometries, one a chapter: fallback_reason (null or empty: none)
    and soft_extents_passed, whether each soft extent shows as much as its own floor asks (null: nothing to show). A kind or atom
    counts in what the crop must hold, so not in a keepout.
    """
    crop = F.col("role") != "overlay_keepout"
    g = regions.groupBy("chapter").agg(F.count_if(F.col("role") == "hard_core").alias("cores"), F.bool_or(crop & (F.col("kind").isin("text_region", "ui_region") | F.col("atomic"))).alias("atomic"), F.bool_or(~crop).alias("keepout"))
    all_of = geometries.join(g, "chapter", "left")
    say = lambda when, reason: F.when(when, F.lit(reason))
    reasons = _rules(
        say(F.col("cores") > 1, "multiple_hard_core_regions"), say(F.col("atomic"), "atomic_text_or_ui_region"), say(F.col("keepout"), "overlay_keepout_requires_layout_gate"), say(F.coalesce("fallback_reason", F.lit("")) != "", "fallback_applied"),
        say(~F.coalesce("soft_extents_passed", F.lit(True)), "soft_extent_visibility_below_floor"),
    )
    return all_of.select("chapter", reasons.alias("reasons"))


def preflight_violations(regions: DataFrame) -> DataFrame:
    """(chapter, candidate_id, rule): hard cores and atomic regions need 1, keepouts 0."""
    rules = _rules(F.when(((F.col("role") == "hard_core") | F.col("atomic")) & (F.col("min_visible") != 1.0), F.lit("full_visibility_required")), F.when((F.col("role") == "overlay_keepout") & (F.col("min_visible") != 0.0), F.lit("keepout_visibility_must_be_zero")))
    return regions.select("chapter", "candidate_id", F.explode(rules).alias("rule"))


def preflight_contract(preflights: DataFrame) -> DataFrame:
    """(chapter, candidate_id, rule) of preflights: ranks 1 to 4, confidence 0 to 1, no negative motion, hashes of 64 hex digits, each region once.

    Columns rank, confidence, max_speed, max_acceleration, max_jerk, geometry_fingerprint, source_fingerprint, track_fingerprints and region_ids.
    """
    hexes = lambda c: c.rlike("^[0-9a-f]{64}$")
    negative = (F.col("max_speed") < 0) | (F.col("max_acceleration") < 0) | (F.col("max_jerk") < 0)
    rules = _rules(
        F.when(~F.col("rank").between(1, 4), F.lit("rank_range")), F.when(~F.col("confidence").between(0, 1), F.lit("confidence_range")), F.when(negative, F.lit("negative_motion")),
        F.when(~F.coalesce(hexes(F.col("geometry_fingerprint")), F.lit(False)), F.lit("geometry_hash")), F.when(~F.coalesce(hexes(F.col("source_fingerprint")), F.lit(False)), F.lit("source_hash")), F.when(F.exists("track_fingerprints", lambda x: ~hexes(x)), F.lit("track_hash")),
        F.when(F.size(F.array_distinct("region_ids")) < F.size("region_ids"), F.lit("duplicate_region")),
    )
    return preflights.select("chapter", "candidate_id", F.explode(rules).alias("rule"))


def plan_evidence_violations(candidates: DataFrame, assets: DataFrame, events: DataFrame, frames: DataFrame) -> DataFrame:
    """(chapter, candidate_id, rule): the first reason why a candidate's evidence doesn't exist or doesn't belong together.

    candidates: chapter, candidate_id, asset_id, event_id, frame_id, refs (entity_id, relation). assets: asset_id, entity_ids. events:
    asset_id, event_id, start_s, end_s, relations (a map of relation to entity ids). frames: frame_id, frame_asset, frame_ms; a frame
    lies in an event by whole seconds, start included and end not.
    """
    # what an event and an asset say of the refs is settled at once, so that only flags go on to the next join
    backed = lambda r: F.coalesce(F.array_contains(F.col("relations")[r["relation"]], r["entity_id"]), F.lit(False))
    c = candidates.select("chapter", "candidate_id", "asset_id", "event_id", "frame_id", "refs").join(events.select("asset_id", "event_id", "start_s", "end_s", "relations"), ["asset_id", "event_id"], "left")
    c = c.select("chapter", "candidate_id", "asset_id", "frame_id", "refs", "start_s", "end_s", F.exists("refs", lambda r: ~backed(r)).alias("_unbacked")).join(assets.select("asset_id", F.col("entity_ids").alias("_known")), "asset_id", "left")
    unknown = F.exists("refs", lambda r: ~F.array_contains(F.col("_known"), r["entity_id"]))
    first = F.when(F.col("_known").isNull(), "unknown_asset").when(F.col("start_s").isNull(), "unknown_event")
    c = c.select("chapter", "candidate_id", "asset_id", "frame_id", "start_s", "end_s", first.alias("_first"), F.when(unknown, "unknown_entity").when(F.col("_unbacked"), "relation_not_backed").alias("_last")).join(frames.select("frame_id", "frame_asset", "frame_ms"), "frame_id", "left")
    second = F.floor(F.col("frame_ms") / 1000)
    rule = (
        F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.col("frame_ms").isNull(), "unknown_frame").when(~F.col("frame_asset").eqNullSafe(F.col("asset_id")), "frame_of_other_asset")
        .when((second < F.col("start_s")) | (second >= F.col("end_s")), "frame_outside_event").otherwise(F.col("_last"))
    )
    return c.select("chapter", "candidate_id", rule.alias("rule")).where("rule IS NOT NULL")


def region_violations(regions: DataFrame) -> DataFrame:
    """(chapter, rule): at least one required region, and none of them under full visibility; at most 8."""
    core = F.col("role") == "hard_core"
    g = regions.groupBy("chapter").agg(F.count_if(core).alias("cores"), F.count_if(core & (F.col("min_visible") < 1.0)).alias("low"), F.count("*").alias("n"))
    return g.select("chapter", F.explode(_rules(F.when(F.col("cores") == 0, F.lit("no_required_region")), F.when(F.col("low") > 0, F.lit("required_not_full")), F.when(F.col("n") > 8, F.lit("too_many_regions")))).alias("rule"))


def audit_bounded_clip(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(chapter, candidate_id, approved, applied, codes, audit_sha256); a clip is applied where an approved soft extent is not whole.

    Candidates have source_fingerprint and track_fingerprints too; the hash is that of the audit's canonical JSON.
    """
    soft = F.exists("regions", lambda r: (r["role"] == "soft_extent") & (r["min_visible"] < 1.0))
    c = with_codes(candidates, policy).withColumns({"policy_id": F.lit(policy.policy_id), "policy_sha256": F.lit(policy.sha256()), "candidate_rank": F.col("rank"), "approved": F.col("passed"), "failure_codes": F.col("codes")})
    c = c.withColumn("auto_bounded_clip_applied", F.col("approved") & soft)
    body = canonical_sha256("policy_id", "policy_sha256", "candidate_id", "candidate_rank", "approved", "auto_bounded_clip_applied", "failure_codes", "geometry_fingerprint", "source_fingerprint", "track_fingerprints")
    return c.select("chapter", "candidate_id", "approved", F.col("auto_bounded_clip_applied").alias("applied"), "codes", body.alias("audit_sha256"))


def _by_aspect(overrides: DataFrame) -> DataFrame:
    """An override of both aspects is one of each."""
    aspects = F.when(F.col("aspect") == "both", F.array(F.lit("horizontal"), F.lit("vertical"))).otherwise(F.array("aspect"))
    return overrides.withColumn("aspect", F.explode(aspects))


def override_violations(chapters: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """(chapter, aspect, rule) for overrides (chapter, aspect, candidate_id): known chapters and candidates, one override for a chapter and aspect."""
    o = _by_aspect(overrides)
    known = o.join(chapters.select("chapter", F.lit(True).alias("known")).distinct(), "chapter", "left").join(candidates.select("chapter", "candidate_id", F.lit(True).alias("held")).distinct(), ["chapter", "candidate_id"], "left")
    n = F.count("*").over(W.partitionBy("chapter", "aspect"))
    rules = _rules(F.when(F.col("known").isNull(), F.lit("unknown_chapter")), F.when(F.col("known") & F.col("held").isNull(), F.lit("unknown_candidate")), F.when(n > 1, F.lit("duplicate_override")))
    return known.withColumn("rules", rules).select("chapter", "aspect", F.explode("rules").alias("rule")).distinct()


def apply_overrides(chapters: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """chapters (chapter, horizontal_candidate_id, vertical_candidate_id) with the candidate that an override selects for an aspect.

    An override that override_violations() names changes nothing.
    """
    wrong = override_violations(chapters, candidates, overrides).select("chapter", "aspect").distinct()
    good = _by_aspect(overrides).join(wrong, ["chapter", "aspect"], "left_anti")
    chosen = good.groupBy("chapter").agg(*[F.max(F.when(F.col("aspect") == a, F.col("candidate_id"))).alias(f"_{a}") for a in ("horizontal", "vertical")])
    out = chapters.join(chosen, "chapter", "left")
    return out.withColumns({f"{a}_candidate_id": F.coalesce(f"_{a}", f"{a}_candidate_id") for a in ("horizontal", "vertical")}).drop("_horizontal", "_vertical")


def selected_assets(candidates: DataFrame) -> DataFrame:
    """(source_id, first_use): the clips that the plan uses, with the place of their first use."""
    return candidates.groupBy("source_id").agg(F.min(F.struct("chapter", "rank")).alias("x")).select("source_id", F.col("x.chapter").alias("first_chapter"), F.col("x.rank").alias("first_rank"))


def trim_worklist(candidates: DataFrame) -> DataFrame:
    """(chapter, aspect, frame_id): one request for a chapter whose two aspects share their evidence, else two."""
    g = candidates.groupBy("chapter").agg(F.max(F.when(F.col("rank") == 1, F.col("frame_id"))).alias("h"), F.max(F.when(F.col("rank") == 2, F.col("frame_id"))).alias("v"))
    one = lambda aspect, c: F.struct(F.lit(aspect).alias("aspect"), F.col(c).alias("frame_id"))
    requests = F.when(F.col("v").isNull() | (F.col("h") == F.col("v")), F.array(one("both", "h"))).otherwise(F.array(one("horizontal", "h"), one("vertical", "v")))
    return g.select("chapter", F.explode(requests).alias("x")).select("chapter", "x.aspect", "x.frame_id")


def missing_ids(references: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return references.join(catalog, key, "left_anti")


def policy_violations(patches: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter, rule) for patches (chapter, edge_priority, controlled_clip, binding_sha256, policy_sha256): known chapters, each patched once, an edge priority other than balanced only with a controlled clip, a clip only with a human binding, and a binding of this policy."""
    known = patches.join(chapters.select("chapter", F.lit(True).alias("known")), "chapter", "left")
    n = F.count("*").over(W.partitionBy("chapter"))
    edge = F.coalesce("edge_priority", F.lit("balanced")) != "balanced"
    rules = _rules(
        F.when(F.col("known").isNull(), F.lit("unknown_chapter")), F.when(n > 1, F.lit("duplicate_chapter")), F.when(edge & ~F.col("controlled_clip"), F.lit("edge_needs_clip")),
        F.when(F.col("controlled_clip") & F.col("binding_sha256").isNull(), F.lit("clip_needs_binding")), F.when(F.col("binding_sha256") != F.col("policy_sha256"), F.lit("binding_differs")),
    )
    return known.withColumn("rules", rules).select("chapter", F.explode("rules").alias("rule")).distinct()


def replan_differences(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only one of the plans has, with side."""
    keys = stored.columns
    both = stored.withColumn("_n", F.lit(1)).unionByName(computed.withColumn("_n", F.lit(-1))).repartition(*keys)
    g = both.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "stored").otherwise("computed")
    return g.select(*keys, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))


def quality_risks(candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(chapter, risks): the sorted union of the codes of a chapter's candidates."""
    return with_codes(candidates, policy).groupBy("chapter").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("risks"))


def ordered_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(position, left_id, right_id) where two ordered lists (position, key) differ."""
    left, right = a.select("position", F.col(key).alias("left_id")), b.select("position", F.col(key).alias("right_id"))
    return left.join(right, "position", "full").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def union_ids(candidates: DataFrame) -> DataFrame:
    """(chapter, ids): frame and source ids of all candidates, each once, sorted."""
    return candidates.groupBy("chapter").agg(F.array_sort(F.array_union(F.collect_set("frame_id"), F.collect_set("source_id"))).alias("ids"))


def classified(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(chapter, candidate_id, unknown, unclassified): entities that a candidate names and its event does not have, and important ones of the event that it puts in no class.

    candidates: chapter, candidate_id, asset_id, event_id, required, preferred, sacrificable (arrays of entity ids), focus_id. events:
    asset_id, event_id, the arrays entity_ids, primary_ids, required_ids, optional_ids, avoid_overlay_ids, and target_ids. An event
    that is missing knows and asks for nothing.
    """
    c = candidates.join(events, ["asset_id", "event_id"], "left")
    none = F.array().cast("array<string>")
    known, important = (F.array_distinct(F.concat(*[F.coalesce(x, none) for x in names])) for names in (("entity_ids", "primary_ids", "required_ids", "optional_ids", "avoid_overlay_ids", "target_ids"), ("primary_ids", "required_ids")))
    classes = F.concat("required", "preferred", "sacrificable")
    named = F.concat(classes, F.array_compact(F.array("focus_id")))
    return c.select("chapter", "candidate_id", F.array_sort(F.array_except(named, known)).alias("unknown"), F.array_sort(F.array_except(important, classes)).alias("unclassified"))


def compact_candidates(candidates: DataFrame, with_relations: bool = True) -> DataFrame:
    """One row per chapter: its candidates as an ordered array, and for each source the ordered roles it has."""
    cards = F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "frame_id", "role")))
    g = candidates.groupBy("chapter").agg(cards.alias("cards"))
    if not with_relations:
        return g
    relations = candidates.groupBy("chapter", "source_id").agg(F.array_sort(F.array_distinct(F.collect_list("role"))).alias("roles"))
    nested = relations.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("source_id", "roles"))).alias("relations"))
    return g.join(nested, "chapter")


def selected_evidence(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """cards (source_id, frame_id, ...) that the first candidates use, nested and sorted by source."""
    used = candidates.where("rank = 1").select("source_id", "frame_id").distinct()
    return cards.join(used, ["source_id", "frame_id"], "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_set("frame_id")).alias("frames"))


def target_text(label: Column, features: Column, target: Column) -> Column:
    """The grounding target, else label and features, else the label."""
    return F.coalesce(target, F.when(features.isNotNull(), F.concat_ws("; ", label, features)), label)


def region_kind(entity_kind: Column) -> Column:
    """What a region of such an entity is, on the renderer's side."""
    return F.when(entity_kind == "text_region", "text_region").when(entity_kind.isin("phone_screen", "screen", "ui_element"), "ui_region").when(entity_kind == "logo", "graphic").when(entity_kind == "other", "other").otherwise("subject")


def _each(items: Column, use, few: int = 8) -> Column:
    """transform(items, use); arrays of at most few items, which is what a contract lets a candidate have, are taken item by item, in code that Spark generates, which it doesn't for a lambda."""
    taken = F.slice(F.array(*[use(F.get(items, F.lit(i))) for i in range(few)]), F.lit(1), F.size(items))
    return F.when(F.size(items).between(0, few), taken).otherwise(F.transform(items, use))


def preflight_rows(candidates: DataFrame) -> DataFrame:
    """The preflight of each candidate from what the renderer's geometry says: (chapter, candidate_id, presentation, regions, geometry_fingerprint, expected_fingerprint, and the gates of failure_codes()).

    Candidates have source_fingerprint, filter_graph, track_fingerprint (null: none), titles_rendered,
    intents (an array of region_id, execution_role, atomic, floor) and geometry, a struct whose fields
    stand in order of name, with applied_strategy, coverage_passed, max_* and min_required_area, and
    soft_extents (an array of region_id, min_area). Hard cores share the least visible share of what is required; a soft
    extent that the geometry does not know is not assessed; a keepout is safe where no title is drawn.
    """
    g = F.col("geometry")
    names = {"contract_version": F.lit("vertical-candidate-geometry-preflight-v1"), "filter_graph": F.col("filter_graph"), "geometry": g, "source_sha256": F.col("source_fingerprint"), "track_fingerprint": F.col("track_fingerprint")}
    fingerprint = F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(names.items())]), {"ignoreNullFields": "false"}), 256)

    def assessed(intent: Column) -> Column:
        role, at = intent["execution_role"], F.coalesce(F.array_position(g["soft_extents"]["region_id"], intent["region_id"]), F.lit(0))
        area = F.get(g["soft_extents"]["min_area"], at - 1)  # of the first soft extent of that id; null at -1
        hard = role == "hard_core"
        is_soft = role == "soft_extent"
        return F.struct(
            intent["region_id"].alias("region_id"), role.alias("role"), (intent["atomic"] & ~is_soft).alias("atomic"), F.when(hard, True).when(is_soft, at > 0).otherwise(~F.col("titles_rendered")).alias("assessed"),
            F.when(hard, F.coalesce(g["min_required_area"], F.lit(1.0))).when(is_soft, F.coalesce(area, F.lit(0.0))).otherwise(1.0).alias("min_visible"),
            F.when(hard, 1.0).when(is_soft, intent["floor"]).otherwise(0.0).alias("required_visible"), F.when(~hard & ~is_soft & F.col("titles_rendered"), 1.0).otherwise(0.0).alias("overlap"),
        )

    presentation = F.when(g["applied_strategy"].isin("tracked_crop", "center_crop"), g["applied_strategy"]).when(g["applied_strategy"] == "seed_anchor_crop", "static_anchor").otherwise("fit_with_background")
    return candidates.select(
        "chapter", "candidate_id", "rank", presentation.alias("strategy"), _each(F.col("intents"), assessed).alias("regions"), fingerprint.alias("geometry_fingerprint"), fingerprint.alias("expected_fingerprint"),
        F.coalesce(g["lineage_passed"], F.lit(True)).alias("lineage_ok"), F.lit(True).alias("single_shot"), "confidence", F.lit("matched").alias("semantic_status"), F.coalesce(g["confidence_passed"], F.lit(True)).alias("confidence_ok"),
        F.coalesce(g["coverage_passed"], F.lit(True)).alias("coverage_ok"), F.lit(None).cast("boolean").alias("checkpoints_ok"), *[F.coalesce(g[k], F.lit(0.0)).alias(k) for k in ("max_speed", "max_acceleration", "max_jerk")],
    )


def clip_card_violations(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(chapter, place, rule) for the events (chapter, place, start_ms, entity_id, target_kind) of a card: times in order, entities known, and of the target's kind."""
    e = entities.select("entity_id", "entity_kind").distinct()
    before = F.lag("start_ms").over(W.partitionBy("chapter").orderBy("place"))
    j = events.withColumn("_late", before > F.col("start_ms")).join(e, "entity_id", "left")
    rules = F.array_compact(F.array(F.when(F.col("_late"), F.lit("not_ordered")), F.when(F.col("entity_kind").isNull(), F.lit("unknown_entity")), F.when(F.col("entity_kind") != F.col("target_kind"), F.lit("kind_differs"))))
    return j.select("chapter", "place", F.explode(rules).alias("rule"))


def card_violations(cards: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """(card_id, event_id, rule) of whole clip cards; event_id is null where the card itself is at fault.

    cards: card_id, duration_ms. events: card_id, place, event_id, start_ms, end_ms, keyframe_ms, entity_ids (all that it refers to),
    targets (entity_id, target_kind), opportunities (entity ids of each). entities: card_id, entity_id, kind.
    """
    known = _entities_of(entities)
    heads = cards.join(known, "card_id", "left").join(events.groupBy("card_id").agg(F.count("*").alias("_n"), F.count_distinct("event_id").alias("_ids")), "card_id", "left")
    of_card = _rules(F.when(F.col("_n").isNull(), F.lit("no_events")), F.when(F.col("_ids") < F.col("_n"), F.lit("duplicate_event")), F.when(F.col("_twice"), F.lit("duplicate_entity")))
    before = F.max("end_ms").over(W.partitionBy("card_id").orderBy("place").rowsBetween(-1, -1))
    e = events.withColumn("_before", F.coalesce(before, F.lit(0))).join(cards, "card_id").join(known, "card_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<bigint>")))
    unknown = lambda ids: F.size(F.array_except(ids, F.col("_known"))) > 0
    targets = F.transform("targets", lambda t: t["entity_id"])
    rules = _rules(
        F.when(F.col("end_ms") <= F.col("start_ms"), F.lit("empty_interval")), F.when((F.col("keyframe_ms") < F.col("start_ms")) | (F.col("keyframe_ms") >= F.col("end_ms")), F.lit("keyframe_outside")), F.when(F.col("end_ms") > F.col("duration_ms"), F.lit("past_end")), F.when(F.col("start_ms") < F.col("_before"), F.lit("overlap")),
        F.when(unknown(F.array_distinct(F.concat("entity_ids", targets))), F.lit("unknown_entity")), F.when(F.exists("targets", lambda t: F.exists("_kinds", lambda k: (k["entity_id"] == t["entity_id"]) & (k["kind"] != t["target_kind"]))), F.lit("kind_differs")), F.when(unknown(F.flatten("opportunities")), F.lit("opportunity_unknown_entity")),
    )
    return heads.select("card_id", F.lit(None).cast("long").alias("event_id"), F.explode(of_card).alias("rule")).unionByName(e.select("card_id", "event_id", F.explode(rules).alias("rule")))


def _entities_of(entities: DataFrame) -> DataFrame:
    return entities.groupBy("card_id").agg(F.collect_set("entity_id").alias("_known"), F.collect_set(F.struct("entity_id", "kind")).alias("_kinds"), (F.count_distinct("entity_id") < F.count("*")).alias("_twice"))
