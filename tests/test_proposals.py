"""Proposals from candidates, and chains of revisions, on literal rows."""

import hashlib
import json

from pyspark.sql import functions as F

from reelwork.operators import locks as L

REGION = "array<struct<region_id: string, entity_id: string, target_description: string, role: string, atomic: boolean, minimum_visible_fraction: double, observable_relations: array<string>, exclusions: array<string>>>"
PREDICATE = "struct<disqualifying_conditions: array<string>, participant_target_ids: array<string>, predicate_id: string>"
CANDIDATE = f"query_id string, candidate_id string, revision int, editorial_goal string, claim_source string, provenance struct<created_at: string, created_by: string, source_reference: string>, crop_mode string, target_description string, regions {REGION}, predicate {PREDICATE}, candidate_json string"


def region(name, entity=None, text="a text", role="required", atomic=False, share=None, relations=(), exclusions=()):
    return (name, entity, text, role, atomic, share, list(relations), list(exclusions))


def row(q, regions=(), target=None, mode="strict", predicate=None):
    return (q, f"c-{q}", 2, "goal", "model_proposal", ("2024", "me", None), mode, target, list(regions), predicate, json.dumps({"candidate_id": f"c-{q}"}, separators=(",", ":")))


def canonical(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_layers_of_a_candidate(spark):
    rows = [
        row("full", [region("r1", "subject", " the subject ", relations=["seen"], exclusions=["shadow"]), region("r2", None, "sign", "preferred", share=0.8), region("r3", "logo", "logo", "avoid_overlay"), region("r4", "part", "part", "preferred", True)]),
        row("own", [region("r1", "x", role="preferred")], " the target ", "primary_center"), row("hard", [region("r1", "x")], "unused"), row("none"), row("blank", [region("r", "x", "  ")]), row("twice", [region("r1", "x"), region("r2", "x")]),
        row("who", [region("r1", "x")], predicate=([], ["y"], "p")), row("said", [region("r1", "x")], predicate=([], ["x"], "p")),
    ]
    made = L.propose_candidates(spark.createDataFrame(rows, CANDIDATE))
    got = {r.query_id: r for r in made.collect()}
    assert {k: r.rule for k, r in got.items() if r.rule} == {"none": "no_identity", "blank": "blank_description", "twice": "repeated_target", "who": "unknown_participant"}
    assert got["none"].identity is None and got["none"].proposal_id is None
    full = got["full"]
    assert [(t.target_id, t.target_description, t.identity_cues, t.context_cues, t.stable_exclusions) for t in full.identity.targets][:2] == [("subject", "the subject", ["the subject"], ["seen"], ["shadow"]), ("reframe_r2", "sign", ["sign"], [], [])]
    f = full.framing
    assert (f.required_target_ids, f.preferred_target_ids, f.overlay_keepout_target_ids) == (["subject", "part"], ["reframe_r2"], ["logo"])
    assert [(x.target_id, x.minimum_visible_fraction, x.atomic) for x in f.aspect_constraints[0].target_visibility_constraints] == [("subject", 1.0, False), ("reframe_r2", 0.8, False), ("part", 1.0, True)]
    assert f.framing_intent == "Keep required targets fully visible and recognizable. Retain preferred targets when the frame permits. Keep overlay-protected targets unobscured."
    own = got["own"].framing
    assert own.required_target_ids == ["reframe_subject"] and own.aspect_constraints[0].required_target_clipping_policy == "allow_controlled" and own.framing_intent.startswith("Keep required targets recognizable under")
    assert got["own"].identity.targets[1].target_description == "the target" and [t.target_id for t in got["hard"].identity.targets] == ["x"]
    assert got["said"].predicate.predicate_id == "p" and got["full"].provenance.source_reference == "feature-vertical-candidate:c-full"


def test_names_are_hashes_over_all_layers(spark):
    made = L.propose_candidates(spark.createDataFrame([row("hard", [region("r1", "x")])], CANDIDATE))
    r = L.component_hashes(made).first()
    identity = {"targets": [{"context_cues": [], "identity_cues": ["a text"], "negative_anchors": [], "positive_anchors": [], "scope": "whole_instance", "stable_exclusions": [], "target_description": "a text", "target_id": "x"}]}
    assert r.identity_sha256 == canonical(identity)
    body = {"candidate": {"candidate_id": "c-hard"}, "claim_source": "model_proposal", "contract_version": "feature-vertical-candidate-query-adapter-v1", "editorial_goal": "goal", "framing_sha256": r.framing_sha256, "identity_sha256": r.identity_sha256, "predicate_sha256": None, "provenance": {"created_at": "2024", "created_by": "me", "source_reference": "feature-vertical-candidate:c-hard"}, "revision": 2}
    assert r.proposal_id == f"feature-query-proposal:{canonical(body)[:24]}"


def test_newest_revision_whose_chain_holds(spark):
    candidates = spark.createDataFrame([("q", 1, "c1"), ("q", 2, "c2"), ("q", 3, "c3x"), ("q", 5, "c5"), ("z", 1, "c1")], "query_id string, revision int, candidate_sha256 string")
    proposals = spark.createDataFrame([("q", 1, "c1", "p1"), ("q", 2, "c2", "p2"), ("q", 3, "c3", "p3"), ("q", 4, "c4", "p4"), ("q", 5, "c5", "p5"), ("z", 1, "c1", "p9")], "query_id string, revision int, candidate_sha256 string, proposal_sha256 string")
    approvals = spark.createDataFrame([("q", "p1", "2024-01", "approved"), ("q", "p2", "2024-02", "rejected"), ("q", "p2", "2024-03", "approved"), ("q", "p3", "2024-03", "approved"), ("q", "p5", "2024-03", "approved"), ("q", "p5", "2024-04", "rejected"), ("q", "p0", "2024-01", "approved")], "query_id string, proposal_sha256 string, approved_at string, decision string")
    best, broken = L.newest_approved(candidates, proposals, approvals)
    assert [tuple(r) for r in best.collect()] == [("q", 2, "p2")]
    assert sorted(map(tuple, broken.collect()), key=str) == sorted([("q", 3, "candidate_changed"), ("q", 4, "candidate_missing"), ("q", 5, "rejected"), ("z", 1, "not_approved"), ("q", None, "approval_of_unknown_proposal")], key=str)
    assert best.where(F.col("query_id") == "z").count() == 0
