"""Query locks: targets and parents, canonical hashes, lineage and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.text import canonical_sha256, json_sha256, python_json, stripped
from reelwork.operators.rounds import cut_lineage


def ancestors(targets: DataFrame) -> DataFrame:
    """(query_id, target_id, ancestor_id, distance), nearest to farthest, by joins of doubled reach.

    A target on a cycle has itself among its ancestors, see ancestor_violations().
    """
    parents = targets.where("parent_target_id IS NOT NULL").select("query_id", "target_id", F.col("parent_target_id").alias("ancestor_id"))
    found = cut_lineage(parents.join(targets.select("query_id", F.col("target_id").alias("ancestor_id")).distinct(), ["query_id", "ancestor_id"], "left_semi").withColumn("distance", F.lit(1).cast("long")))
    hop, reach = found, 1
    limit = targets.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    while reach < limit:
        ahead = hop.where(F.col("distance") == reach).select("query_id", F.col("target_id").alias("ancestor_id"), F.col("ancestor_id").alias("_far"))
        # every known ancestor, moved on by the reach; then the reach itself doubles
        more = found.select("query_id", F.col("target_id").alias("_t"), F.col("ancestor_id"), "distance").join(ahead, ["query_id", "ancestor_id"])
        more = cut_lineage(more.select("query_id", F.col("_t").alias("target_id"), F.col("_far").alias("ancestor_id"), (F.col("distance") + reach).alias("distance")).where(F.col("distance") <= limit))
        if more.isEmpty():
            break
        found = cut_lineage(found.unionByName(more).distinct())
        hop, reach = found, reach * 2
    return found.select("query_id", "target_id", "ancestor_id", "distance")


def ancestor_violations(targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rule): a parent that is not there, or a target that is its own ancestor."""
    ids = targets.select("query_id", F.col("target_id").alias("parent_target_id")).distinct()
    unknown = targets.where("parent_target_id IS NOT NULL").join(ids, ["query_id", "parent_target_id"], "left_anti").select("query_id", "target_id", F.lit("unknown_parent").alias("rule"))
    cycles = ancestors(targets).where("target_id = ancestor_id").select("query_id", "target_id", F.lit("cycle").alias("rule")).distinct()
    return unknown.unionByName(cycles)


def select_target(targets: DataFrame, wanted: Column) -> DataFrame:
    """(query_id, target_id, rule): the given id, else the only target; otherwise a violation."""
    g = targets.withColumn("_wanted", wanted).groupBy("query_id").agg(F.collect_set("target_id").alias("ids"), F.max("_wanted").alias("w"))
    given = F.col("w").isNotNull()
    rule = F.when(given & ~F.array_contains("ids", F.col("w")), "unknown_target").when(~given & (F.size("ids") != 1), "target_not_unique")
    chosen = F.when(given, F.col("w")).otherwise(F.get("ids", F.lit(0)))
    return g.select("query_id", F.when(rule.isNull(), chosen).alias("target_id"), rule.alias("rule"))


def target_hashes(targets: DataFrame) -> DataFrame:
    """Component hashes: the identity of a target, and of the whole lock in order of its targets."""
    t = targets.withColumn("identity_sha256", canonical_sha256("target_id", "parent_target_id", "target_description"))
    whole = t.groupBy("query_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "identity_sha256"))), lambda x: x["identity_sha256"]), "|"), 256).alias("lock_sha256"))
    return t.join(whole, "query_id").select("query_id", "target_id", "identity_sha256", "lock_sha256")


def lineage_mismatches(saved: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    from reelwork.operators.shots import echo_mismatches

    return echo_mismatches(saved, current, keys, fields)


def bind_lineage(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """(query_id, target_id, lock_sha256, rule): the lock's hashes for a request; its target must exist with the same text."""
    l = locks.select("query_id", "target_id", F.col("target_description").alias("_text"), "lock_sha256")
    j = requests.join(l, ["query_id", "target_id"], "left")
    rule = F.when(F.col("_text").isNull(), "unknown_target").when(F.col("_text") != F.col("target_description"), "text_differs")
    return j.select("query_id", "target_id", F.when(rule.isNull(), F.col("lock_sha256")).alias("lock_sha256"), rule.alias("rule"))


def reusable(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The requests whose keys all agree with a complete cached result, and the others: the work list."""
    good = cache.where("complete").select(*keys).distinct()
    return requests.join(good, keys, "left_semi"), requests.join(good, keys, "left_anti")


def resolve_event_target(events: DataFrame) -> DataFrame:
    """(event_id, target, rule): the lock's target, else the explicit one, else the only accepted proposal; the first two exclude each other."""
    rule = F.when(F.col("lock_target").isNotNull() & F.col("explicit_target").isNotNull(), "lock_and_explicit").when(F.col("lock_target").isNull() & F.col("explicit_target").isNull() & (F.size("accepted") != 1), "proposal_not_unique")
    return events.select("event_id", F.when(rule.isNull(), F.coalesce("lock_target", "explicit_target", F.get("accepted", F.lit(0)))).alias("target"), rule.alias("rule"))


def identity_references(anchors: DataFrame, crops: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, target_id, place, sha256, rule): a target's anchors before its ancestors', positive ones first, the first few; resolved by hash."""
    place = F.row_number().over(W.partitionBy("query_id", "target_id").orderBy("distance", F.col("positive").desc(), "sha256"))
    chosen = anchors.withColumn("place", place).where(F.col("place") <= most)
    found = crops.select("sha256", F.lit(True).alias("there")).distinct()
    return chosen.join(found, "sha256", "left").select("query_id", "target_id", "place", "sha256", F.when(F.col("there").isNull(), "crop_missing").alias("rule"))


def disjoint_violations(locks: DataFrame) -> DataFrame:
    """(query_id, rule): required, preferred and sacrificable are disjoint; cues and exclusions are, whatever their case."""
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    rules = F.array_compact(F.array(F.when(F.arrays_overlap("required", "preferred"), F.lit("required_preferred")), F.when(F.arrays_overlap("required", "sacrificable"), F.lit("required_sacrificable")), F.when(F.arrays_overlap("preferred", "sacrificable"), F.lit("preferred_sacrificable")), F.when(F.arrays_overlap(low("cues"), low("exclusions")), F.lit("cues_exclusions"))))
    return locks.select("query_id", F.explode(rules).alias("rule"))


def lock_violations(targets: DataFrame) -> DataFrame:
    """(query_id, rule): targets are unique, have a text, and name known parents."""
    g = targets.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("d"), F.count_if(F.coalesce(F.col("target_description"), F.lit("")) == "").alias("empty"))
    base = g.select("query_id", F.explode(F.array_compact(F.array(F.when(F.col("d") < F.col("n"), F.lit("duplicate_target")), F.when(F.col("empty") > 0, F.lit("empty_text"))))).alias("rule"))
    ids = targets.select("query_id", F.col("target_id").alias("parent_target_id")).distinct()
    parents = targets.where("parent_target_id IS NOT NULL").join(ids, ["query_id", "parent_target_id"], "left_anti").select("query_id", F.lit("unknown_parent").alias("rule")).distinct()
    return base.unionByName(parents)


def _say(when: Column, rule: str) -> Column:
    return F.when(when, F.lit(rule))


def _blank(c: str) -> Column:
    return F.exists(F.col(c), lambda x: F.btrim(x) == "")


def _repeated(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.size(F.array_distinct(c)) < F.size(c)


def identity_violations(targets: DataFrame) -> DataFrame:
    """(query_id, target_id, rule) for the identity of one target.

    targets: target_id, parent_target_id, scope, identity_cues, context_cues, stable_exclusions, and the anchors
    positive_anchors and negative_anchors of (frame_id, crop_sha256). Lists are never null.
    """
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    whole = F.col("scope") == "whole_instance"
    crops = lambda c: F.transform(F.col(c), lambda x: x["crop_sha256"])
    lists = ("identity_cues", "context_cues", "stable_exclusions")
    rules = F.array_compact(F.array(
        *[_say(_blank(c), f"blank_{c}") for c in lists], *[_say(_repeated(c), f"repeated_{c}") for c in (*lists, "positive_anchors", "negative_anchors")],
        _say(whole & F.col("parent_target_id").isNotNull(), "parent_of_whole_instance"), _say(~whole & F.col("parent_target_id").isNull(), "parent_missing"), _say(F.col("parent_target_id") == F.col("target_id"), "own_parent"),
        _say((F.size("identity_cues") == 0) & (F.size("positive_anchors") == 0), "no_identity"), _say(F.arrays_overlap(low("identity_cues"), low("stable_exclusions")), "cues_exclusions"), _say(F.arrays_overlap(crops("positive_anchors"), crops("negative_anchors")), "crop_both_ways"),
    ))
    return targets.select("query_id", "target_id", F.explode(rules).alias("rule"))


def contract_violations(locks: DataFrame) -> DataFrame:
    """(query_id, rule) for the predicate, framing and approval of locks.

    locks: target_ids of the identity; predicate (null: none) of participant_target_ids, required_at, phases, required_evidence,
    disqualifying_conditions; framing of required_, preferred_, sacrificable_ and overlay_keepout_target_ids, editing_uses and
    aspect_constraints (required_target_ids, target_visibility_constraints of target_id, minimum_visible_fraction, atomic);
    approval of approval_source, policy_reference.
    """
    known, p, f = F.col("target_ids"), F.col("predicate"), F.col("framing")
    unknown = lambda c: F.size(F.array_except(c, known)) > 0
    blank = lambda c: F.exists(c, lambda x: F.btrim(x) == "")
    roles = [f[f"{r}_target_ids"] for r in ("required", "preferred", "sacrificable")]
    aspect = lambda test: F.exists(f["aspect_constraints"], test)
    floors = lambda test: aspect(lambda a: F.exists(a["target_visibility_constraints"], test))
    ids = lambda a: F.transform(a["target_visibility_constraints"], lambda v: v["target_id"])
    policy = F.col("approval.policy_reference")
    auto = F.col("approval.approval_source") == "auto_policy"
    lists = [(p[c], c) for c in ("participant_target_ids", "required_evidence", "disqualifying_conditions")] + [(f[c], c) for c in ("required_target_ids", "preferred_target_ids", "sacrificable_target_ids", "overlay_keepout_target_ids", "editing_uses")]
    rules = F.array_compact(F.array(
        *[_say(blank(c), f"blank_{n}") for c, n in lists], *[_say(_repeated(c), f"repeated_{n}") for c, n in lists],
        _say(F.size(p["participant_target_ids"]) == 0, "no_participant"), _say(unknown(p["participant_target_ids"]), "unknown_participant"), _say((p["required_at"] == "transition") & p["phases"].isNull(), "phases_missing"),
        *[_say(unknown(f[f"{r}_target_ids"]), f"unknown_{r}") for r in ("required", "preferred", "sacrificable", "overlay_keepout")],
        _say(F.arrays_overlap(roles[0], roles[1]) | F.arrays_overlap(roles[0], roles[2]) | F.arrays_overlap(roles[1], roles[2]), "roles_overlap"),
        _say(aspect(lambda a: unknown(a["required_target_ids"])), "aspect_unknown_target"), _say(aspect(lambda a: _repeated(a["required_target_ids"])), "aspect_repeated_target"),
        _say(aspect(lambda a: unknown(ids(a))), "visibility_unknown_target"), _say(aspect(lambda a: _repeated(ids(a))), "visibility_repeated_target"),
        _say(floors(lambda v: (v["minimum_visible_fraction"] <= 0) | (v["minimum_visible_fraction"] > 1)), "visibility_range"), _say(floors(lambda v: v["atomic"] & (v["minimum_visible_fraction"] != 1)), "atomic_not_whole"),
        _say(auto & (F.btrim(F.coalesce(policy, F.lit(""))) == ""), "policy_missing"), _say(~auto & policy.isNotNull(), "policy_not_expected"),
    ))
    return locks.select("query_id", F.explode(rules).alias("rule"))


# --- version 1 locks, proposals and approvals


def migrate_locks(locks: DataFrame) -> DataFrame:
    """Version 1 locks as proposals of version 2 in three layers (identity, predicate, framing), without any loss. One that cannot be moved has a rule and no layers.

    locks: query_id, revision, editorial_goal, claim_source, provenance, targets (target_id, target_description, positive_attributes,
    negative_attributes, reference_frame_ids, reference_crop_hashes), observable_predicate, predicate_phases (precondition, apex,
    postcondition; null: none), required_evidence, negative_constraints, editing_uses, aspect_constraints (aspect_ratio,
    required_target_ids, constraint). Fields of a struct are in the order of their names, as in canonical JSON.
    """
    empty = F.array().cast("array<string>")
    anchor = lambda frame, crop: F.struct(crop.alias("crop_sha256"), frame.alias("frame_id"))
    none = F.array().cast("array<struct<crop_sha256:string,frame_id:string>>")
    target = lambda t: F.struct(
        empty.alias("context_cues"), F.when(F.size(t["positive_attributes"]) > 0, t["positive_attributes"]).otherwise(F.array(t["target_description"])).alias("identity_cues"), none.alias("negative_anchors"),
        F.zip_with(t["reference_frame_ids"], t["reference_crop_hashes"], anchor).alias("positive_anchors"), F.lit("whole_instance").alias("scope"), t["negative_attributes"].alias("stable_exclusions"), t["target_description"].alias("target_description"), t["target_id"].alias("target_id"),
    )
    ids = F.transform("targets", lambda t: t["target_id"])
    phases, stated = F.col("predicate_phases"), F.col("observable_predicate")
    said = F.when(stated != "", stated)
    order = F.struct(phases["apex"].alias("apex"), phases["postcondition"].alias("postcondition"), phases["precondition"].alias("precondition"))
    predicate = F.struct(
        F.col("negative_constraints").alias("disqualifying_conditions"), ids.alias("participant_target_ids"), F.when(phases.isNotNull(), order).alias("phases"), F.concat("query_id", F.lit(":predicate")).alias("predicate_id"), F.when(phases.isNotNull(), "transition").otherwise("seed").alias("required_at"),
        F.col("required_evidence").alias("required_evidence"), F.coalesce(said, F.concat(F.lit("Observable transition: "), phases["precondition"], F.lit("; "), phases["apex"], F.lit("; "), phases["postcondition"])).alias("statement"),
    )
    required = F.array_distinct(F.flatten(F.transform("aspect_constraints", lambda a: a["required_target_ids"])))
    floors = F.array().cast("array<struct<atomic:boolean,minimum_visible_fraction:double,target_id:string>>")
    aspects = F.transform("aspect_constraints", lambda a: F.struct(a["aspect_ratio"].alias("aspect_ratio"), a["constraint"].alias("constraint"), F.lit("forbid").alias("required_target_clipping_policy"), a["required_target_ids"].alias("required_target_ids"), floors.alias("target_visibility_constraints")))
    intent = F.array_join(F.transform("aspect_constraints", lambda a: a["constraint"]), "; ")
    framing = F.struct(
        aspects.alias("aspect_constraints"), F.col("editing_uses").alias("editing_uses"), F.when(intent == "", "Preserve the selected evidence targets for the intended edit.").otherwise(intent).alias("framing_intent"),
        empty.alias("overlay_keepout_target_ids"), F.filter(ids, lambda t: ~F.array_contains(required, t)).alias("preferred_target_ids"), required.alias("required_target_ids"), empty.alias("sacrificable_target_ids"),
    )
    uneven = F.exists("targets", lambda t: F.size(t["reference_frame_ids"]) != F.size(t["reference_crop_hashes"]))
    bare = ((F.size("required_evidence") > 0) | (F.size("negative_constraints") > 0)) & said.isNull() & phases.isNull()
    rule = F.when(F.size("targets") == 0, "no_targets").when(uneven, "anchor_lengths").when(bare, "evidence_without_predicate")
    return locks.select(
        "query_id", F.concat("query_id", F.lit(":migrated-v2")).alias("proposal_id"), "revision", "editorial_goal", F.when(rule.isNull(), F.struct(F.transform("targets", target).alias("targets"))).alias("identity"),
        F.when(rule.isNull() & (said.isNotNull() | phases.isNotNull()), predicate).alias("predicate"), F.when(rule.isNull(), framing).alias("framing"), "claim_source", "provenance", rule.alias("rule"),
    )


def component_hashes(proposals: DataFrame) -> DataFrame:
    """proposals with the hashes of their three layers and composite_sha256 over these and the goal; no predicate is hashed as null. Without an identity there are no hashes."""
    layer = lambda c: json_sha256(F.col(c), nulls=False)
    there = F.col("identity").isNotNull()
    h = proposals.withColumns({"identity_sha256": layer("identity"), "predicate_sha256": F.when(there, F.coalesce(layer("predicate"), F.sha2(F.lit("null"), 256))), "framing_sha256": layer("framing")})
    whole = F.struct(F.lit("evidence-query-v2").alias("contract_version"), *[F.col(c) for c in ("editorial_goal", "framing_sha256", "identity_sha256", "predicate_sha256")])
    return h.withColumn("composite_sha256", F.when(there, json_sha256(whole, nulls=False)))


def approve(proposals: DataFrame, approvals: DataFrame) -> DataFrame:
    """Locks of the proposals that can be moved and are approved, with definition_sha256 over the whole lock; others have a rule instead.

    approvals: query_id, and a struct approval of approval_source, approved_at, approved_by, policy_reference, source_reference.
    """
    source, policy = F.col("approval.approval_source"), F.col("approval.policy_reference")
    rule = (
        F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("approval").isNull(), "not_approved").when((source == "auto_policy") & (F.btrim(F.coalesce(policy, F.lit(""))) == ""), "policy_missing")
        .when((source != "auto_policy") & policy.isNotNull(), "policy_not_expected").when(~source.isin("user_brief", "human_review", "auto_policy"), "unknown_authority")
    )
    body = F.struct("approval", "claim_source", F.lit("evidence-query-lock-v2").alias("contract_version"), "editorial_goal", "framing", "identity", "predicate", "provenance", "query_id", "revision")
    joined = component_hashes(proposals).join(approvals, "query_id", "left").withColumn("rule", rule)
    return joined.withColumn("definition_sha256", F.when(F.col("rule").isNull(), json_sha256(body, nulls=False)))


# --- proposals from reviewed candidates


def propose_candidates(candidates: DataFrame) -> DataFrame:
    """Vertical candidates as proposals in the three layers of component_hashes(); one that cannot be proposed has a rule and no layers.

    candidates: query_id, candidate_id, revision, editorial_goal, claim_source, provenance (created_at, created_by, source_reference), crop_mode,
    target_description, regions (region_id, entity_id, target_description, role, atomic, minimum_visible_fraction, observable_relations,
    exclusions), predicate (null: none; it is never made up from what was observed) and candidate_json, the candidate's canonical JSON.
    A region stands for its entity, or for itself; without a hard core the candidate's own target is required. The proposal's
    name is a hash over the candidate and all layers.
    """
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<crop_sha256:string,frame_id:string>>")
    target_id = lambda r: F.when(F.coalesce(r["entity_id"], F.lit("")) != "", r["entity_id"]).otherwise(F.concat(F.lit("reframe_"), r["region_id"]))
    role = lambda r: F.when(r["role"] == "avoid_overlay", "overlay_keepout").when((r["role"] == "required") | r["atomic"], "hard_core").otherwise("soft_extent")

    def part(name: Column, kind: Column, description: Column, context: Column, exclusions: Column, share: Column, atomic: Column) -> Column:
        return F.struct(name.alias("id"), kind.alias("kind"), stripped(description).alias("words"), context.alias("context"), exclusions.alias("exclusions"), share.cast("double").alias("share"), atomic.alias("atomic"))

    def target(p: Column) -> Column:
        return F.struct(
            p["context"].alias("context_cues"), F.array(p["words"]).alias("identity_cues"), none.alias("negative_anchors"), none.alias("positive_anchors"), F.lit("whole_instance").alias("scope"), p["exclusions"].alias("stable_exclusions"), p["words"].alias("target_description"), p["id"].alias("target_id"),
        )

    # id, kind and words of a region are made once; all else reads them, each step from columns, so that nothing is worked out twice
    given = F.transform("regions", lambda r: part(target_id(r), role(r), r["target_description"], r["observable_relations"], r["exclusions"], r["minimum_visible_fraction"], r["atomic"]))
    own = ~F.array_contains(F.col("_given.kind"), "hard_core") & F.col("target_description").isNotNull()
    subject = part(F.lit("reframe_subject"), F.lit("hard_core"), F.col("target_description"), empty, empty, F.lit(None), F.lit(False))
    of_kind = lambda kind: F.transform(F.filter("_parts", lambda p: p["kind"] == kind), lambda p: p["id"])
    share = lambda p: F.when(p["kind"] == "hard_core", 1.0).otherwise(F.coalesce(p["share"], F.lit(0.72)))
    floors = F.transform(F.filter("_parts", lambda p: p["kind"] != "overlay_keepout"), lambda p: F.struct(p["atomic"].alias("atomic"), share(p).alias("minimum_visible_fraction"), p["id"].alias("target_id")))
    c = candidates.withColumn("_given", given).withColumn("_parts", F.when(own, F.concat("_given", F.array(subject))).otherwise(F.col("_given"))).drop("_given")
    ids, words = F.col("_parts.id"), F.col("_parts.words")
    blank = F.exists(words, lambda w: F.coalesce(w, F.lit("")) == "")
    participants = F.col("predicate.participant_target_ids")
    rule = (
        F.when(F.size("_parts") == 0, "no_identity").when(blank, "blank_description").when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_target").when(F.col("predicate").isNotNull() & (F.size(F.array_except(participants, ids)) > 0), "unknown_participant")
    )
    c = c.withColumns({"required": of_kind("hard_core"), "preferred": of_kind("soft_extent"), "keepouts": of_kind("overlay_keepout"), "rule": rule})
    strict = F.col("crop_mode") == "strict"
    # fixed values: these sentences go into the framing's hash
    duties = F.concat_ws(
        " ", F.when(F.size("required") > 0, F.when(F.col("crop_mode") == "primary_center", "Keep required targets recognizable under the saved controlled clipping policy.").otherwise("Keep required targets fully visible and recognizable.")),
        F.when(F.size("preferred") > 0, F.lit("Retain preferred targets when the frame permits.")), F.when(F.size("keepouts") > 0, F.lit("Keep overlay-protected targets unobscured.")),
    )
    aspect = F.struct(F.lit("9:16").alias("aspect_ratio"), F.lit("Required targets must remain directly visible in the portrait frame.").alias("constraint"), F.when(strict, "forbid").otherwise("allow_controlled").alias("required_target_clipping_policy"), F.col("required").alias("required_target_ids"), floors.alias("target_visibility_constraints"))
    framing = F.struct(
        F.array(aspect).alias("aspect_constraints"), F.array(F.lit("portrait_reframe")).alias("editing_uses"), F.when(duties != "", duties).otherwise("Keep the selected target recognizable.").alias("framing_intent"),
        F.col("keepouts").alias("overlay_keepout_target_ids"), F.col("preferred").alias("preferred_target_ids"), F.col("required").alias("required_target_ids"), empty.alias("sacrificable_target_ids"),
    )
    reference = F.coalesce(F.col("provenance.source_reference"), F.concat(F.lit("feature-vertical-candidate:"), "candidate_id"))
    provenance = F.struct(F.col("provenance.created_at").alias("created_at"), F.col("provenance.created_by").alias("created_by"), reference.alias("source_reference"))
    p = c.withColumns({"identity": F.when(F.col("rule").isNull(), F.struct(F.transform("_parts", target).alias("targets"))), "framing": F.when(F.col("rule").isNull(), framing), "predicate": F.when(F.col("rule").isNull(), F.col("predicate")), "provenance": provenance})
    h = component_hashes(p)
    predicate = F.when(F.col("predicate").isNotNull(), F.col("predicate_sha256"))
    said = F.struct("claim_source", F.lit("feature-vertical-candidate-query-adapter-v1").alias("contract_version"), "editorial_goal", "framing_sha256", "identity_sha256", predicate.alias("predicate_sha256"), "provenance", "revision")
    body = F.concat(F.lit('{"candidate":'), "candidate_json", F.lit(","), F.substr(python_json(F.to_json(said, {"ignoreNullFields": "false"})), F.lit(2)))
    name = F.when(F.col("rule").isNull(), F.concat(F.lit("feature-query-proposal:"), F.substring(F.sha2(body, 256), 1, 24)))
    return h.select("query_id", "candidate_id", name.alias("proposal_id"), "revision", "editorial_goal", "identity", "predicate", "framing", "claim_source", "provenance", "rule")


def newest_approved(candidates: DataFrame, proposals: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, revision, proposal_sha256), violations (query_id, revision, rule)): the newest revision of each query whose chain holds, link by link.

    candidates: query_id, revision, candidate_sha256. proposals: query_id, revision, candidate_sha256 (what it was made from),
    proposal_sha256. approvals: query_id, proposal_sha256 (what was approved), approved_at, decision. The last decision on a
    proposal counts. A proposal needs the candidate of its revision, unchanged, and an approval of just itself.
    """
    c = candidates.select("query_id", "revision", F.col("candidate_sha256").alias("_now"))
    last = approvals.groupBy("query_id", "proposal_sha256").agg(F.max_by("decision", F.struct("approved_at", "decision")).alias("decision"))
    asked = approvals.select("query_id", F.col("proposal_sha256").alias("_approved")).join(proposals.select("query_id", F.col("proposal_sha256").alias("_approved"), F.lit(True).alias("_held")), ["query_id", "_approved"], "left")
    p = proposals.join(c, ["query_id", "revision"], "left").join(last, ["query_id", "proposal_sha256"], "left")
    rule = F.when(F.col("_now").isNull(), "candidate_missing").when(F.col("_now") != F.col("candidate_sha256"), "candidate_changed").when(F.col("decision").isNull(), "not_approved").when(F.col("decision") != "approved", "rejected")
    p = p.withColumn("rule", rule)
    best = p.where("rule IS NULL").groupBy("query_id").agg(F.max(F.struct("revision", "proposal_sha256")).alias("x")).select("query_id", "x.revision", "x.proposal_sha256")
    loose = asked.where("_held IS NULL").select("query_id", F.lit(None).cast("int").alias("revision"), F.lit("approval_of_unknown_proposal").alias("rule")).distinct()
    return best, p.where("rule IS NOT NULL").select("query_id", F.col("revision").cast("int").alias("revision"), "rule").unionByName(loose)
