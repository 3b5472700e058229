"""Which events are to be located, with which target, from which frame: one plan over all gates, with a reason for each request that falls out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.operators.tracks import checkpoint_plan

MOST_CHECKPOINTS = 8
INTERVAL = "interval"
# fixed values: they say where a seed comes from, and why an interval may be tracked
KEYFRAME, MIDPOINT = "clip_card_recommended_mmss", "local_event_midpoint_no_model_keyframe"
WHOLE_EVENT, BRACKET = "derived_event_interval", "query_predicate_contiguous_sampled_evidence_bracket"


def _first(items: Column, keep) -> Column:
    return F.get(F.filter(items, keep), F.lit(0))


def resolved_requests(requests: DataFrame, events: DataFrame, locks: DataFrame) -> DataFrame:
    """requests with their event, lock and target, and rule for the first gate that one fails.

    requests: request_id, asset_id, event_id, query_id, query_target_id, target_id, target_description (null where not given), accept_proposal,
    checkpoint_budget, has_decision. events: asset_id, event_id, start_ms, end_ms, keyframe_ms, targets (entity_id, target_description).
    locks: query_id, version, identity_sha256, predicate (required_at, participants, sha256; null: none), targets (target_id, description).
    A target comes from a lock, from the request itself, or from the event's only proposal where that is accepted.
    """
    known = events.select("asset_id", "event_id", "start_ms", "end_ms", "keyframe_ms", F.col("targets").alias("proposals"), F.lit(True).alias("_event"))
    lock = locks.select("query_id", "version", "identity_sha256", "predicate", F.col("targets").alias("locked"), F.lit(True).alias("_lock"))
    r = requests.withColumnsRenamed({"target_id": "_id", "target_description": "_text"}).join(known, ["asset_id", "event_id"], "left").join(lock, "query_id", "left")
    by_lock, explicit = F.col("query_id").isNotNull(), F.col("_id").isNotNull()
    wanted = F.col("query_target_id")
    of_lock = F.when(wanted.isNotNull(), _first(F.col("locked"), lambda t: t["target_id"] == wanted)).when(F.size("locked") == 1, F.get("locked", F.lit(0)))
    only = F.when(F.size("proposals") == 1, F.get("proposals", F.lit(0)))
    predicate = F.col("predicate")
    chosen = F.when(by_lock, of_lock["target_id"]).when(explicit, F.col("_id")).otherwise(only["entity_id"])
    rule = (
        F.when(explicit != F.col("_text").isNotNull(), "half_target").when(explicit & F.col("accept_proposal"), "target_and_proposal").when(wanted.isNotNull() & ~by_lock, "lock_missing").when(F.col("has_decision") & ~by_lock, "lock_missing")
        .when(~F.col("checkpoint_budget").between(0, MOST_CHECKPOINTS), "budget_range").when(by_lock & (explicit | F.col("accept_proposal")), "lock_and_target").when(F.col("_event").isNull(), "unknown_event").when(by_lock & F.col("_lock").isNull(), "unknown_lock")
        .when(by_lock & wanted.isNotNull() & of_lock.isNull(), "unknown_target").when(by_lock & of_lock.isNull(), "target_not_unique").when(~by_lock & ~explicit & ~F.col("accept_proposal"), "target_required").when(~by_lock & ~explicit & only.isNull(), "proposal_not_unique")
        .when(by_lock & F.col("has_decision") & ((F.col("version") < 2) | predicate.isNull()), "decision_not_expected").when(by_lock & predicate.isNotNull() & ~F.col("has_decision"), "decision_missing")
    )
    source = F.when(by_lock, F.concat(F.lit("query_lock_v"), F.col("version").cast("string"))).when(explicit, "explicit_target").otherwise("explicit_acceptance_of_single_clip_card_proposal")
    text = F.when(by_lock, of_lock["description"]).when(explicit, F.col("_text")).otherwise(only["target_description"])
    return r.withColumns({"target_id": chosen, "target_description": text, "target_source": source, "rule": rule}).drop("_id", "_text", "_event", "_lock", "locked", "proposals")


def _because(rows: DataFrame, when: Column, rule: str) -> DataFrame:
    return rows.withColumn("rule", F.coalesce("rule", F.when(when, F.lit(rule))))


def geometry_worklist(requests: DataFrame, events: DataFrame, locks: DataFrame, references: DataFrame, decisions: DataFrame, dense: DataFrame, groundings: DataFrame) -> DataFrame:
    """(request_id, target_id, target_description, target_source, references, seed_ms, seed_pts, seed_source, from_ms, to_ms, eligibility, reused, checkpoint_budget, rule) of each request.

    The first three tables are those of resolved_requests(). references: query_id, target_id, place, sha256, missing (as
    identity_references() finds them). decisions: query_id, asset_id, event_id, target_id, identity_sha256, predicate_sha256, required_at,
    satisfied, seed (frame_id, requested_ms, pts; null for an interval), frames (requested_ms, frame_ms) of an interval. dense: asset_id,
    event_id, target_id, target_description, frame_id, requested_ms, pts of frames that match (as matching_dense_seed() finds them).
    groundings: asset_id, event_id, target_id, requested_ms, pts, single: what is there already. A seed is the decision's, else without a
    lock that of the dense frames, else the event's keyframe, else its middle. rule is null for what is to be done; only such rows
    have a seed. Reused ones need no new grounding.
    """
    r = resolved_requests(requests, events, locks)
    held = references.groupBy("query_id", "target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha256"))), lambda x: x["sha256"]).alias("references"), F.bool_or("missing").alias("_missing"))
    r = _because(r.join(held, ["query_id", "target_id"], "left"), F.col("_missing"), "reference_missing")
    d = decisions.select("query_id", "event_id", *[F.col(c).alias(f"d_{c}") for c in ("asset_id", "target_id", "identity_sha256", "predicate_sha256", "required_at", "satisfied", "seed", "frames")], F.lit(True).alias("_decided"))
    r = r.join(d, ["query_id", "event_id"], "left")
    decided = F.col("has_decision") & F.col("_decided").isNotNull()
    p = F.col("predicate")
    same = (F.col("d_asset_id") == F.col("asset_id")) & (F.col("d_identity_sha256") == F.col("identity_sha256")) & (F.col("d_predicate_sha256") == p["sha256"]) & (F.col("d_required_at") == p["required_at"])
    by_interval = decided & (F.col("d_required_at") == INTERVAL)
    n = F.size("d_frames")
    for when, rule in (
        (F.col("has_decision") & F.col("_decided").isNull(), "decision_missing"), (decided & ~F.coalesce(same, F.lit(False)), "decision_differs"), (decided & ~F.array_contains(p["participants"], F.col("d_target_id")), "not_participant"),
        (decided & ~F.col("d_satisfied"), "predicate_not_satisfied"), (by_interval & (F.coalesce(n, F.lit(0)) < 2), "no_bracket"),
    ):
        r = _because(r, when, rule)
    m = dense.select("asset_id", "event_id", "target_id", "target_description", F.col("frame_id").alias("m_frame"), F.col("requested_ms").alias("m_ms"), F.col("pts").alias("m_pts"))
    r = r.join(m, ["asset_id", "event_id", "target_id", "target_description"], "left")
    seeded, by_dense = decided & F.col("d_seed").isNotNull(), F.col("query_id").isNull() & F.col("m_ms").isNotNull()
    last, before = F.get("d_frames", n - 1), F.get("d_frames", n - 2)
    step = F.greatest(F.lit(1), last["requested_ms"] - before["requested_ms"])
    r = r.withColumns({
        "seed_ms": F.when(seeded, F.col("d_seed.requested_ms")).when(by_dense, F.col("m_ms")).otherwise(F.coalesce("keyframe_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))).cast("long"), "seed_pts": F.when(seeded, F.col("d_seed.pts")).when(by_dense, F.col("m_pts")),
        "seed_source": F.when(seeded, F.concat(F.lit("query_predicate_"), "d_required_at", F.lit(":"), "d_seed.frame_id")).when(by_dense, F.concat(F.lit("dense_frame_id:"), "m_frame", F.lit(":target_matched"))).when(F.col("keyframe_ms").isNotNull(), KEYFRAME).otherwise(MIDPOINT),
        "from_ms": F.when(by_interval, F.greatest("start_ms", F.get("d_frames", F.lit(0))["frame_ms"])).otherwise(F.col("start_ms")), "to_ms": F.when(by_interval, F.least(F.col("end_ms"), last["frame_ms"] + step)).otherwise(F.col("end_ms")), "eligibility": F.when(by_interval, BRACKET).otherwise(WHOLE_EVENT),
    })
    r = _because(r, (F.col("seed_ms") < F.col("from_ms")) | (F.col("seed_ms") >= F.col("to_ms")), "seed_outside")
    g = groundings.select("asset_id", "event_id", "target_id", F.col("requested_ms").alias("seed_ms"), F.col("pts").alias("g_pts"), F.col("single").alias("g_single"))
    r = r.join(g, ["asset_id", "event_id", "target_id", "seed_ms"], "left")
    r = _because(_because(r, F.col("g_pts") != F.col("seed_pts"), "seed_pts_differ"), ~F.col("g_single"), "not_single_match")
    kept = lambda c: F.when(F.col("rule").isNull(), F.col(c)).alias(c)
    seeds = [kept(c) for c in ("seed_ms", "seed_pts", "seed_source", "from_ms", "to_ms", "eligibility")]
    return r.select("request_id", "target_id", "target_description", "target_source", F.coalesce("references", F.array().cast("array<string>")).alias("references"), *seeds, F.when(F.col("rule").isNull(), F.col("g_single").isNotNull()).alias("reused"), "checkpoint_budget", "rule")


def with_checkpoints(worklist: DataFrame, stated: DataFrame) -> DataFrame:
    """worklist with checkpoints, the samples (of stated, whose track_id is the request) at which the identity is to be checked: the most pressing up to the request's budget."""
    plan = checkpoint_plan(stated, MOST_CHECKPOINTS).where("selected").select(F.col("track_id").alias("request_id"), "place", "sample_index")
    mine = worklist.where("rule IS NULL").select("request_id", "checkpoint_budget").join(plan, "request_id").where("place <= checkpoint_budget")
    checks = mine.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample_index"))), lambda x: x["sample_index"]).alias("checkpoints"))
    return worklist.join(checks, "request_id", "left").withColumn("checkpoints", F.coalesce("checkpoints", F.array().cast("array<long>")))


def dropped(worklist: DataFrame) -> DataFrame:
    """(rule, requests): how many requests each gate has turned away, the most first in place."""
    counts = worklist.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("requests"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.col("requests").desc(), "rule")))
