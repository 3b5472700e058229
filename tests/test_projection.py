"""Plans as the renderer gets them, on literal rows."""

import pytest
from pyspark.sql import functions as F

from reelwork.operators import projection as P

CANDIDATE = """chapter string, position int, candidate_id string, asset_id string, event_id string, frame_id string, observed_visual_evidence string, selection_reason string, quality_risks array<string>,
    horizontal_strategy string, zoom_intent string, focus_id string, vertical_strategy string, crop_mode string, framing_intent string, required array<string>, preferred array<string>, sacrificable array<string>, confidence double"""
EVENT = """asset_id string, event_id string, entity_ids array<string>, primary_ids array<string>, required_ids array<string>, optional_ids array<string>, avoid_overlay_ids array<string>,
    entities array<struct<entity_id: string, kind: string, label: string, features: string>>, targets array<struct<entity_id: string, target_description: string>>"""
CHAPTER = "chapter string, evidence_status string, horizontal_candidate_id string, vertical_candidate_id string"


def candidate(chapter, position, name, **given):
    row = {
        "chapter": chapter, "position": position, "candidate_id": name, "asset_id": "a", "event_id": "demo", "frame_id": f"RF{position}", "observed_visual_evidence": f"seen {name}", "selection_reason": f"reason {name}", "quality_risks": [], "horizontal_strategy": "original", "zoom_intent": "none",
        "focus_id": None, "vertical_strategy": "fit_with_background", "crop_mode": "strict", "framing_intent": "keep it", "required": ["subject-1"], "preferred": [], "sacrificable": [], "confidence": 0.8,
    }
    return tuple((row | given).values())


@pytest.fixture(scope="module")
def events(spark):
    entities = [("subject-1", "person", "visible subject", "at the center"), ("sign-1", "text_region", "foreground sign", " wide line "), ("bare", "logo", "logo", "  "), *[(f"x{k}", "other", f"x{k}", "") for k in range(9)]]
    row = ("a", "demo", ["subject-1", "sign-1"], ["subject-1"], ["subject-1", "sign-1"], [], ["sign-1", "bare"], entities, [("subject-1", "the visible subject")])
    return spark.createDataFrame([row], EVENT)


@pytest.fixture(scope="module")
def plan(spark, events):
    rows = [
        candidate("one", 1, "candidate-a", vertical_strategy="tracked_crop", preferred=["sign-1", "subject-1"], quality_risks=["r1", "r2"]), candidate("one", 2, "candidate-b", focus_id="subject-1", horizontal_strategy="tracked_reframe", zoom_intent="subtle", confidence=0.7, quality_risks=["r2", "r0"]),
        candidate("same", 1, "only #1", required=["sign-1", "bare"], sacrificable=["bare"], vertical_strategy="tracked_crop"), candidate("same", 2, "other"),
        candidate("lost", 1, "x", event_id="none"), candidate("alien", 1, "x", required=["who"]), candidate("many", 1, "x", required=[f"x{k}" for k in range(9)], vertical_strategy="tracked_crop"), candidate("focus", 1, "x", focus_id="who"), candidate("unpicked", 1, "x"), candidate("odd", 1, "x"),
    ]
    chapters = [("one", "supported", "candidate-a", "candidate-b"), ("same", "partial", "only #1", "only #1"), ("none", "not_found", None, None), ("unpicked", "supported", "x", None), ("odd", "supported", "y", "x"), *[(c, "supported", "x", "x") for c in ("lost", "alien", "many", "focus")]]
    made, violations = P.project_choices(spark.createDataFrame(chapters, CHAPTER), spark.createDataFrame(rows, CANDIDATE), events)
    return {r.chapter: r for r in made.collect()}, sorted(map(tuple, violations.collect()))


def test_choices_become_ranked_candidates(plan):
    c = plan[0]["one"]
    assert (c.horizontal_frame_id, c.vertical_frame_id, c.vertical_strategy, c.confidence) == ("RF1", "RF2", "fit_with_background", 0.7)
    assert [(x.candidate_id, x.rank) for x in c.horizontal_candidates] == [("candidate-a", 1), ("candidate-b", 2)]
    assert [(x.candidate_id, x.rank) for x in c.vertical_candidates] == [("candidate-b", 1), ("candidate-a", 2)]
    assert c.horizontal_target_description is None and c.horizontal_candidates[1].target_description == "the visible subject"
    assert c.observed_visual_evidence == "16:9: seen candidate-a 9:16: seen candidate-b" and c.selection_reason == "16:9: reason candidate-a 9:16: reason candidate-b"
    assert c.quality_risks == ["r1", "r2", "r0"]
    assert c.horizontal_candidates[1].zoom_intent == "subtle" and c.vertical_candidates[0].crop_mode == "strict"


def test_regions_come_from_the_event(plan):
    tracked = plan[0]["one"].vertical_candidates[1]
    assert tracked.target_description == "the visible subject"
    assert [(r.entity_id, r.role, r.kind, r.atomic, r.minimum_visible_fraction) for r in tracked.regions] == [("subject-1", "required", "subject", False, 1.0), ("sign-1", "preferred", "text_region", False, None), ("bare", "avoid_overlay", "graphic", False, None)]
    assert tracked.regions[1].target_description == "foreground sign; wide line" and tracked.regions[2].target_description == "logo"
    assert tracked.regions[0].region_id == "candidate-a.required.subject-1"
    assert tracked.regions[0].observable_relations == ["event_relation=event_member", "event_relation=primary", "event_relation=required", "event_relation=grounding_target", "editorial_framing_intent=keep it"]
    assert plan[0]["one"].vertical_candidates[0].regions == []


def test_one_candidate_for_both_aspects(plan):
    c = plan[0]["same"]
    assert c.observed_visual_evidence == "seen only #1" and c.vertical_target_description == "foreground sign; wide line | logo"
    assert [(r.region_id, r.atomic) for r in c.vertical_candidates[0].regions] == [("only-1.required.sign-1", True), ("only-1.required.bare", True)]


def test_chapters_without_evidence_and_broken_ones(plan):
    c = plan[0]["none"]
    assert (c.horizontal_frame_id, c.horizontal_strategy, c.horizontal_zoom_intent, c.vertical_strategy, c.confidence) == (None, "original", "none", "fit_with_background", 0.0)
    assert c.quality_risks == ["No supported source evidence."] and c.horizontal_candidates == [] and c.vertical_candidates == []
    assert plan[1] == [("alien", "entity_missing"), ("focus", "entity_missing"), ("lost", "event_missing"), ("many", "too_many_regions"), ("odd", "selection_unknown"), ("unpicked", "selection_missing")]
    assert set(plan[0]) == {"one", "same", "none"}


def test_answers_come_back_to_their_candidates(spark, events):
    said = 'a "b"\\c\n\t, [x] 12 é\u2028'
    second = ("a", "second", ["s"], [], [], [], ["o", "o"], [("s", "other", said, None), ("o", "screen", "", " "), ("mute", "logo", None, "big")], [("t", "")])
    more = spark.createDataFrame([second, second], EVENT)  # an event that is there twice counts once
    rows = [
        candidate("mix", 2, "c2", event_id="second", required=["s"], vertical_strategy="tracked_crop"), candidate("mix", 1, "c1", required=["x3", "x1"], focus_id="x0"), candidate("mix", 3, "c3", event_id="second", required=["t", "s"]), candidate("mix", 4, "c4", event_id="second", required=["s", "t"], focus_id="o"),
        candidate("mix", 5, "c5", event_id="second", required=["s"], vertical_strategy="tracked_crop", framing_intent="other"), candidate("mix", 6, "c6", required=[]), candidate("mix", 6, "c7", required=[], confidence=0.1),
        candidate("mute", 1, "x", event_id="second", required=["mute"]), candidate("null", 1, "x", required=[None]), candidate("no event", 1, "x", event_id=None, asset_id=None), candidate("two rules", 1, "x", event_id="none"), candidate("two rules", 2, "y", required=["who"]), candidate(None, 1, "x"),
    ]
    chapters = [("mix", "supported", "c2", "c5"), ("empty", "supported", "x", "x"), ("unsaid", None, "x", "x"), (None, "supported", "x", "x"), *[(c, "supported", "x", "x") for c in ("mute", "null", "no event", "two rules")]]
    given = spark.createDataFrame(chapters, CHAPTER), spark.createDataFrame(rows, CANDIDATE), events.unionByName(more)
    made, violations = P.project_choices(*given)
    got = {r.chapter: r for r in made.collect()}
    assert set(got) == {"mix"}
    assert sorted(map(tuple, violations.collect())) == [("empty", "selection_unknown"), ("mute", "entity_missing"), ("no event", "event_missing"), ("null", "entity_missing"), ("two rules", "entity_missing"), ("two rules", "event_missing")]
    vertical = {c.candidate_id: c for c in got["mix"].vertical_candidates}
    assert [c.candidate_id for c in got["mix"].vertical_candidates] == ["c5", "c1", "c2", "c3", "c4", "c6", "c7"]
    assert [vertical[c].target_description for c in ("c1", "c2", "c3", "c4", "c6")] == ["x3 | x1", said, f" | {said}", f"{said} | ", None]
    assert [c.target_description for c in got["mix"].horizontal_candidates] == [None, "x0", None, "", None, None, None]
    for c, framing in (("c2", "keep it"), ("c5", "other")):
        assert [(r.region_id, r.target_description, r.kind, r.role) for r in vertical[c].regions] == [(f"{c}.required.s", said, "other", "required"), *[(f"{c}.avoid_overlay.o", "", "ui_region", "avoid_overlay")] * 2]
        assert [r.observable_relations for r in vertical[c].regions] == [[f"event_relation={x}", f"editorial_framing_intent={framing}"] for x in ("event_member", "avoid_overlay", "avoid_overlay")]
    described, wrong = P.described_candidates(*given[1:])
    assert described.count() == len(rows) and sorted((r.chapter, r.candidate_id, r.rule) for r in wrong.collect()) == [("mute", "x", "entity_missing"), ("no event", "x", "event_missing"), ("null", "x", "entity_missing"), ("two rules", "x", "event_missing"), ("two rules", "y", "entity_missing")]
    assert described.where("candidate_id = 'c5'").first().regions == vertical["c5"].regions


RESOLVED = """array<struct<region_id: string, target_description: string, kind: string, constraint_role: string, atomic: boolean, observable_relation: string, refs: array<struct<entity_id: string, event_relation: string>>>>"""


def test_plan_with_resolved_regions(spark):
    regions = [("r-1", "the subject", "subject", "hard_core", False, "visible", [("subject-1", "required")]), ("r-2", "both", "text_region", "soft_extent", True, "side by side", [("sign-1", "primary"), ("sign-2", "optional")]), ("r-3", "sign", "text_region", "overlay_keepout", False, "below", [("sign-1", "avoid_overlay")])]
    keep = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 18]
    pick = lambda row, targets, own: (*[row[k] for k in keep], *targets, own)
    names = [CANDIDATE.split(",")[k].strip() for k in keep]
    schema = ", ".join([*names, "horizontal_target string", "vertical_target string", f"regions {RESOLVED}"])
    rows = [pick(candidate("f", 1, "candidate-a", vertical_strategy="tracked_crop"), (None, "the directly visible subject"), regions), pick(candidate("f", 2, "candidate-b"), (None, None), [])]
    chapters = spark.createDataFrame([("f", "supported", "candidate-a", "candidate-b", "RF1", "RF2"), ("bare", "not_found", None, None, None, None)], CHAPTER + ", horizontal_frame_id string, vertical_frame_id string")
    made, violations = P.project_resolved(chapters, spark.createDataFrame(rows, schema))
    assert violations.count() == 0
    got = {r.chapter: r for r in made.collect()}
    f = got["f"]
    assert (f.horizontal_frame_id, f.vertical_frame_id) == ("RF1", "RF2") and got["bare"].vertical_candidates == []
    assert [(c.candidate_id, c.rank) for c in f.vertical_candidates] == [("candidate-b", 1), ("candidate-a", 2)]
    r = f.vertical_candidates[1].regions
    assert [(x.region_id, x.entity_id, x.role, x.minimum_visible_fraction) for x in r] == [("r-1", "subject-1", "required", 1.0), ("r-2.member-1", "sign-1", "preferred", 1.0), ("r-2.member-2", "sign-2", "preferred", 1.0), ("r-3", "sign-1", "avoid_overlay", None)]
    assert r[0].target_description == "the subject" and r[2].target_description == "both; exact member entity_id=sign-2, event_relation=optional"
    assert r[1].observable_relations == ["event_relation=primary", "side by side"]
    legacy = P.project_resolved(chapters, spark.createDataFrame(rows, schema), with_candidates=False)[0].where("chapter = 'f'").first()
    assert legacy.vertical_frame_id == "RF2" and legacy.horizontal_candidates == [] and legacy.vertical_candidates == []


def test_open_edit(spark):
    keep = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 18]
    names = [CANDIDATE.split(",")[k].strip() for k in keep]
    schema = ", ".join([*names, "horizontal_target string", "vertical_target string", f"regions array<{P.REGION}>", "overflow_proposal string"])
    region = lambda i, role: (i, "e", f"text {i}", "subject", role, False, None, [])
    row = lambda c, *own: (*[c[k] for k in keep], *own)
    rows = [
        row(candidate("s1", 1, "a", quality_risks=["z", "b"]), None, None, [], None), row(candidate("s1", 2, "v", vertical_strategy="tracked_crop", quality_risks=["b"], confidence=0.5), None, None, [region("r2", "required"), region("r1", "required"), region("r0", "preferred")], "clip it"),
        row(candidate("s2", 1, "a", vertical_strategy="tracked_crop"), "left", "own words", [region("r", "required")], None), row(candidate("s3", 1, "a"), None, "", [], None),
    ]
    shots = [("s1", "Title", "hook", "effect", 3.5, "a", "v"), ("s2", "T2", "closing", "e2", 4.0, "a", "a"), ("s3", "T3", "action", "e3", 4.0, "a", "b")]
    shots = spark.createDataFrame(shots, "chapter string, title string, editorial_role string, intended_effect string, target_duration_seconds double, horizontal_candidate_id string, vertical_candidate_id string")
    made, violations = P.project_open_edit(shots, spark.createDataFrame(rows, schema))
    assert [tuple(v) for v in violations.collect()] == [("s3", "selection_unknown")]
    got = {r.chapter: r for r in made.collect()}
    one = got["s1"]
    union = "Preserve the union of all required framing regions: region_id=r1, kind=subject, target=text r1; region_id=r2, kind=subject, target=text r2"
    assert one.brief.vertical_primary_target_description == one.selected.vertical_target_description == union
    assert one.brief.detail_lines == ["editorial_role=hook", "effect"] and len(one.brief.vertical_regions) == 3
    assert one.selected.selection_reason == "16:9 reason a; 9:16 reason v" and one.selected.confidence == 0.5
    assert one.selected.quality_risks == ["b", "model_proposed_controlled_clip_requires_human_policy", "z"]
    assert (one.audit.horizontal_frame_id, one.audit.vertical_frame_id, one.audit.model_vertical_overflow_proposal) == ("RF1", "RF2", "clip it")
    assert [c.candidate_id for c in one.selected.vertical_candidates] == ["v", "a"]
    two = got["s2"]
    assert two.selected.vertical_target_description == "own words" and two.selected.horizontal_target_description == "left" and two.audit.model_vertical_overflow_proposal is None
    assert P.project_open_edit(shots, spark.createDataFrame(rows, schema), False)[0].select(F.max(F.size("selected.vertical_candidates"))).first()[0] == 0
