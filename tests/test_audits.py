"""The audit of rendered segments on literal rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from reelwork.operators import audits as A

REGION = "array<struct<region_id: string, role: string, atomic: boolean, payload: string>>"
RENDERED = f"""project_id string, feature_id string, track_fingerprint string, routing_version string, candidate_id string, regions {REGION}, keyframes array<int>, max_speed_x double, max_speed_y double, max_speed double, max_acceleration double,
    safety double, overflow_policy string, edge_priority string, source_clip_id string, source_in_ms long, source_out_ms long, duration_ms long, target_description string, crop_mode string, applied_strategy string, fallback_reason string,
    coverage_passed boolean, containment_failures int, full_containment_feasible boolean, risk_codes array<string>, requires_review boolean"""
TRACK = "project_id string, feature_id string, track_id string, candidate_id string, session_id string, place int, target_id string, sha_ok boolean, fingerprint string"
a, b, c = (x * 64 for x in "abc")


def payload(name, role):
    return {"region_id": name, "role": role, "target_description": f"text: {name}, ä \"q\"", "weight": 1.0, "kind": None}


def region(name, role="required"):
    return (name, role, False, json.dumps(payload(name, role), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def first_form(names, tracks):
    body = {"regions": [payload(n, "required") for n in names], "tracks": tracks}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def second_form(regions, tracks):
    body = {"contract_version": "feature-vertical-region-tracks-v2", "regions": [payload(*r) for r in regions], "tracks": tracks}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def render(feature, fingerprint, regions=(), **given):
    row = dict.fromkeys([x.split()[0] for x in RENDERED.replace(REGION, "r").replace("\n", " ").split(",")])
    row |= {"project_id": "p", "feature_id": feature, "track_fingerprint": fingerprint, "regions": list(regions), "source_in_ms": 100, "source_out_ms": 1100, "source_clip_id": "clip", "applied_strategy": "tracked_crop"}
    return tuple((row | given).values())


@pytest.fixture(scope="module")
def rendered(spark):
    v2 = {"routing_version": "full-auto-candidate-routing-v2", "candidate_id": "k1"}
    rows = [
        render("two", first_form(["r1", "r2"], [a, b]), [region("r1"), region("soft", "preferred"), region("r2")], keyframes=[1], max_speed=5.0, max_speed_x=3.0, max_speed_y=4.0, max_acceleration=1.0, duration_ms=2000, risk_codes=["fast"], containment_failures=0, coverage_passed=True),
        render("one", first_form(["r1"], [a]), [region("r1")], containment_failures=2, fallback_reason="too wide"), render("none", c, requires_review=True), render("bare", None), render("bad", "XYZ"), render("lost", c, [region("r1")]), render("twice", c),
        render("auto", second_form([("r1", "required"), ("soft", "preferred")], [a, b]), [region("r1"), region("soft", "preferred"), region("o", "avoid_overlay")], **v2), render("tampered", first_form(["r1", "r2"], [a, b]), [region("r1"), region("r2")]), render("unpicked", None),
    ]
    return spark.createDataFrame(rows, RENDERED)


@pytest.fixture(scope="module")
def tracks(spark):
    session = lambda f, s, members, ok=True, k=None: [("p", f, f"{f}-{s}-{i}", k, s, i, t, ok, fp) for i, (t, fp) in enumerate(members)]
    rows = [
        *session("two", "s1", [("r1", a), ("r2", b)]), *session("two", "s2", [("r2", b), ("r1", a)]), *session("two", "s3", [("r1", a), ("r2", c)]), ("p", "one", "one-1", None, None, None, "r1", True, a), ("p", "one", "one-2", None, None, None, "r2", True, a),
        ("p", "none", "none-1", None, None, None, None, True, c), ("p", "none", "none-2", None, "s", 0, None, True, c), ("p", "lost", "lost-1", None, None, None, "r1", True, a), ("p", "twice", "t1", None, None, None, None, True, c), ("p", "twice", "t2", None, None, None, None, True, c),
        *session("auto", "s1", [("r1", a), ("soft", b)], k="k1"), *session("auto", "s1", [("r1", a), ("soft", b)], k="k2"), *session("tampered", "s1", [("r1", a), ("r2", b)], ok=False),
    ]
    return spark.createDataFrame(rows, TRACK)


def test_lineage_is_what_hashes_say(rendered, tracks):
    got = {r.feature_id: (r.match_kind, r.session_id, r.track_ids, r.rule) for r in A.resolve_render_tracks(rendered, tracks).collect()}
    assert got == {
        "two": ("shared_session_composite_geometry_fingerprint", "s1", ["two-s1-0", "two-s1-1"], None), "one": ("single_required_region_composite_geometry_fingerprint", None, ["one-1"], None), "none": ("single_track_geometry_fingerprint", None, ["none-1"], None), "bare": (None, None, None, None),
        "bad": (None, None, None, "bad_fingerprint"), "lost": (None, None, None, "no_lineage"), "twice": (None, None, None, "ambiguous_lineage"), "auto": ("full_auto_v2_shared_session_fingerprint", "s1", ["auto-s1-0", "auto-s1-1"], None), "tampered": (None, None, None, "no_lineage"), "unpicked": (None, None, None, None),
    }


def test_audit(spark, rendered, tracks):
    order = ["two", "one", "bad", "none", "unpicked", "bare", "absent"]
    shots = spark.createDataFrame([("p", i, f, f.title(), "x" if f != "unpicked" else "gone") for i, f in enumerate(order)], "project_id string, pos int, feature_id string, title string, vertical_candidate_id string")
    rows = [("p", f, k, n, None, "clip", None, "RF1", "seen", "why", [], "strict") for f in order for k, n in ((2, "x"), (1, "y"), (3, "z"))]
    candidates = spark.createDataFrame(rows, "project_id string, feature_id string, position int, candidate_id string, source_asset_id string, source_clip_id string, event_id string, frame_id string, observed_visual_evidence string, selection_reason string, quality_risks array<string>, crop_mode string")
    samples = [("one-1", i, i * 500, "tracked", 400 + 10 * i, 300, 500 + 10 * i, 600, 1920, 1080) for i in range(4)] + [("none-1", 0, 0, "tracked", 0, 0, 10, 10, None, None)]
    samples = spark.createDataFrame(samples, "track_id string, sample_index int, t_ms long, state string, x_min int, y_min int, x_max int, y_max int, source_width int, source_height int")
    made, violations = A.audit_segments(shots, candidates, rendered, tracks, samples)
    got = {r.feature_id: r for r in made.collect()}
    assert sorted(tuple(v)[1:] for v in violations.collect()) == [("absent", "not_rendered"), ("bad", "bad_fingerprint"), ("unpicked", "selection_unknown")]
    assert {f: (r.timeline_start_ms, r.timeline_end_ms) for f, r in got.items()} == {"two": (0, 2000), "one": (2000, 3000), "none": (4000, 5000), "bare": (6000, 7000)}
    two, one, none, bare = (got[f] for f in ("two", "one", "none", "bare"))
    assert (two.source, two.authoritative, two.geometry.max_speed) == ("render_manifest_authoritative_geometry", True, 5.0)
    assert (one.source, one.authoritative) == ("current_algorithm_comparison_not_rendered_geometry", False) and one.geometry.max_speed_x > 0 and one.geometry.max_speed_y == 0
    assert (none.source, none.geometry) == ("current_algorithm_comparison_unavailable", None) and bare.source is None
    assert [x.candidate_id for x in two.alternative_candidates] == ["y", "z"] and two.selected_candidate.candidate_id == "x" and two.effective_crop_mode == "strict"
    assert two.automated_checks.required_region_containment_passed is True and one.automated_checks.required_region_containment_passed is False and bare.automated_checks.required_region_containment_passed is None
    assert (two.requires_review, one.requires_review, none.requires_review) == (True, False, True) and not one.automated_checks.fallback_free and two.automated_checks.fallback_free
    sequence = spark.createDataFrame([("p", "none", 0), ("p", "two", 1)], "project_id string, feature_id string, pos int")
    again = A.audit_segments(shots, candidates, rendered, tracks, samples, sequence)[0]
    assert {r.feature_id: r.timeline_start_ms for r in again.collect()} == {"none": 0, "two": 1000}


def test_a_plan_of_one_selection(spark, rendered):
    chapters = spark.createDataFrame([("p", 0, "one", "e1", "RF1", "seen", "why", [])], "project_id string, pos int, feature_id string, event_id string, frame_id string, observed_visual_evidence string, selection_reason string, quality_risks array<string>")
    brief = spark.createDataFrame([("p", "one", "Scene", "strict")], "project_id string, feature_id string, title string, crop_mode string")
    shots, candidates = A.legacy_shots(chapters, brief, rendered)
    only = candidates.first()
    assert shots.first().vertical_candidate_id == only.candidate_id == "legacy_selected"
    assert (only.source_asset_id, only.source_clip_id, only.event_id) == (None, "clip", "e1")


def test_blanks_in_json(spark):
    value = {"a": [1, 2.5, None], "b": 'x: y, "z" \\', "c": {"d": "e"}}
    text = json.dumps(value, separators=(",", ":"))
    assert spark.range(1).select(A.spaced_json(F.lit(text))).first()[0] == json.dumps(value)
