"""Contracts on literal rows: each rule is broken by one row and kept by another."""

from reelwork.operators import candidates as K
from reelwork.operators import frames as H
from reelwork.operators import reviews as R
from reelwork.operators import shots as S


def rules(df, key="event_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r["rule"])
    return {k: sorted(v) for k, v in out.items()}


def test_dense_selection(spark):
    rows = [
        (0, True, "DF1", "DF2", "DF3", "e", "text", None), (1, True, "DF1", None, "DF3", None, None, None), (2, True, "DF1", "DF2", "DF3", None, None, "not_visible"), (3, True, "DF2", "DF1", "DF3", None, None, "ambiguous"),
        (4, False, None, None, None, None, None, "target_mismatch"), (5, False, None, None, "DF3", None, None, None), (6, False, None, None, None, "e", "text", None), (7, False, None, None, None, None, None, "matched"), (8, True, "DF1", "DF1", "DF1", "e", "", None), (9, True, None, None, None, None, None, "target_mismatch"),
    ]
    df = spark.createDataFrame(rows, "event_id int, visible boolean, first string, recommended string, last string, target_id string, target_description string, status string")
    assert rules(H.selection_violations(df)) == {1: ["ids_missing"], 2: ["status_of_visible"], 3: ["order"], 5: ["fields_not_expected"], 6: ["fields_not_expected"], 7: ["status_of_invisible"], 8: ["half_target"], 9: ["ids_missing", "status_of_visible"]}


def test_trim_proposals(spark):
    a, b, c, d = ("recommended_in", "DF1"), ("recommended_out", "DF2"), ("hold_start", "DF1"), ("hold_end", "DF2")
    rows = [(0, True, True, [a, b, c, d]), (1, True, False, [a, b]), (2, True, True, [a, a, b]), (3, True, True, [a]), (4, True, True, [a, ("recommended_out", "DF1")]), (5, False, True, [a, b]), (6, False, True, []), (7, True, True, [a, b, d])]
    df = spark.createDataFrame(rows, "event_id int, usable boolean, requires_review boolean, selections array<struct<phase: string, frame_id: string>>")
    assert rules(H.phase_violations(df)) == {1: ["review_not_required"], 2: ["repeated_phase"], 3: ["in_out_missing"], 4: ["single_frame"], 5: ["frames_of_unusable"], 7: ["half_hold"]}


def test_video_trims_and_decisions(spark):
    rows = [(0, True, True, 1, 5, 2, 3, None), (1, True, True, 1, None, None, None, None), (2, True, True, 5, 5, None, None, None), (3, False, True, None, None, None, None, 4), (4, True, True, 1, 5, 3, None, None), (5, True, True, 1, 5, 3, 2, None), (6, False, False, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "event_id int, usable boolean, requires_review boolean, in_ms long, out_ms long, hold_start_ms long, hold_end_ms long, reset_ms long")
    assert rules(H.video_trim_violations(df)) == {1: ["in_out_missing"], 2: ["not_chronological"], 3: ["times_of_unusable"], 4: ["half_hold"], 5: ["hold_not_chronological"], 6: ["review_not_required"]}
    rows = [
        (0, True, "f", 5, 9, 1, 2, 4, 10, "proposed", True, None), (1, True, None, 5, 9, 1, 2, 4, 10, "proposed", True, None), (2, True, "f", 9, 9, 1, 2, 4, 10, "proposed", True, None), (3, True, "f", 5, 9, 1, 2, None, 10, "proposed", True, None), (4, True, "f", 5, 9, 1, 2, 6, 10, "proposed", True, None),
        (5, False, None, None, None, None, 2, None, None, "proposed", True, None), (6, True, "f", 5, 9, 1, 2, 4, 10, "proposed", True, "approved"), (7, True, "f", 5, 9, 1, 2, 4, 10, "approved", False, None), (8, True, "f", 5, 9, 1, 2, 4, 10, "approved", False, "rejected"), (9, True, "f", 5, 9, 1, 2, 4, 10, "rejected", False, "rejected"),
        (10, False, None, None, None, None, None, None, None, "approved", True, "approved"),
    ]
    df = spark.createDataFrame(rows, "event_id int, usable boolean, first_frame string, in_ms long, out_ms long, in_pts long, out_pts long, handle_in_ms long, handle_out_ms long, status string, requires_review boolean, verdict string")
    want = {1: ["bounds_missing"], 2: ["empty_interval"], 3: ["handles_missing"], 4: ["outside_handles"], 5: ["bounds_of_unusable"], 6: ["proposed_but_reviewed"], 7: ["reviewed_without_record"], 8: ["verdict_differs"], 10: ["reviewed_without_record"]}
    assert rules(H.trim_decision_violations(df)) == want


def test_maps_of_events(spark):
    rows = [(1, 1, 0, 10, 5, 100, 1), (1, 2, 10, 20, 20, 100, 2), (1, 3, 30, 30, 30, 100, 3), (1, 4, 25, 40, 26, 100, 4), (1, 5, 50, 101, 50, 100, 5), (1, 5, 101, 99, 101, 100, 6), (2, 9, 50, 60, 50, 100, 1), (2, 8, 0, 10, 0, 100, 2)]
    df = spark.createDataFrame(rows, "asset_id int, event_id int, start_ms long, end_ms long, keyframe_ms long, duration_ms long, position int")
    want = {2: ["keyframe_outside"], 3: ["empty_interval", "keyframe_outside"], 4: ["overlap"], 5: ["beyond_duration", "duplicate_id", "duplicate_id", "empty_interval", "keyframe_outside"], 8: ["overlap"]}
    assert rules(S.temporal_map_violations(df)) == want
    rows = [(1, 1, 999, 5000, 1), (1, 2, 0, 5000, 2), (1, 3, 4000, 5000, 3), (1, 3, 5000, 5000, 4), (1, 4, 5999, 6000, 5)]
    df = spark.createDataFrame(rows, "asset_id int, event_id int, start_ms long, duration_ms long, position int")
    assert rules(S.moment_violations(df)) == {2: ["not_increasing"], 3: ["beyond_duration", "duplicate_id", "duplicate_id"], 4: ["not_increasing"]}
    assert rules(S.moment_violations(df, ordered=False)) == {3: ["beyond_duration", "duplicate_id", "duplicate_id"]}
    assert [r.asset_id for r in S.empty_maps(spark.createDataFrame([(1,), (2,), (2,)], "asset_id int"), df).collect()] == [2]


def test_review_reasons(spark):
    regions = [(1, "hard_core", "subject", False), (1, "hard_core", "subject", False), (2, "hard_core", "text_region", False), (3, "soft_extent", "subject", True), (4, "overlay_keepout", "text_region", False), (5, "hard_core", "graphic", False), (6, "soft_extent", "ui_region", False)]
    geometries = [(1, None, None), (2, "", True), (3, None, True), (4, None, True), (5, "too wide", False), (6, None, True), (7, "no track", None)]
    got = K.review_reasons(spark.createDataFrame(regions, "chapter int, role string, kind string, atomic boolean"), spark.createDataFrame(geometries, "chapter int, fallback_reason string, soft_extents_passed boolean"))
    text = "atomic_text_or_ui_region"
    assert {r.chapter: r.reasons for r in got.collect()} == {1: ["multiple_hard_core_regions"], 2: [text], 3: [text], 4: ["overlay_keepout_requires_layout_gate"], 5: ["fallback_applied", "soft_extent_visibility_below_floor"], 6: [text], 7: ["fallback_applied"]}


def test_classes_of_entities(spark):
    events = spark.createDataFrame([("a", "e", ["m"], ["p"], ["r", "p"], ["o"], ["v"], ["t"])], "asset_id string, event_id string, entity_ids array<string>, primary_ids array<string>, required_ids array<string>, optional_ids array<string>, avoid_overlay_ids array<string>, target_ids array<string>")
    rows = [(1, "x", "a", "e", ["p"], ["r"], ["o"], "t"), (1, "y", "a", "e", ["q"], [], ["m"], "z"), (1, "z", "a", "gone", ["p"], [], [], None)]
    df = spark.createDataFrame(rows, "chapter int, candidate_id string, asset_id string, event_id string, required array<string>, preferred array<string>, sacrificable array<string>, focus_id string")
    assert {r.candidate_id: (r.unknown, r.unclassified) for r in K.classified(df, events).collect()} == {"x": ([], []), "y": (["q", "z"], ["p", "r"]), "z": (["p"], [])}


def test_reviews(spark):
    box = (0, 0, 10, 10)
    rows = [(1, 1, 1, "m", True, True, *box), (1, 2, 1, "m", False, True, *box), (1, 3, 1, "m", True, False, 0, 10, 10, 10), (1, 4, 1, "m", True, False, -1, 0, 10, 10), (1, 5, 1, "m", True, False, None, None, None, None), (1, 6, 1, "m", True, False, 0, 0, 10, 1001), (1, 7, 1, "m", True, False, *box), (1, 7, 1, "m", True, False, *box)]
    df = spark.createDataFrame(rows, "session_id int, moment_id int, target_id int, grounding_method string, reviewed boolean, revealed boolean, x_min int, y_min int, x_max int, y_max int")
    assert rules(R.review_violations(df), "moment_id") == {2: ["revealed_before_verdict"], 3: ["bad_box"], 4: ["bad_box"], 6: ["bad_box"], 7: ["several_verdicts", "several_verdicts"]}
    reviews = spark.createDataFrame([(1, "a", 2, "reviewed"), (1, "b", 1, "pending_human_review"), (1, "c", 0, "pending_human_review"), (2, "d", 0, "reviewed")], "session_id int, review_id string, position int, status string")
    said = spark.createDataFrame([("a", ("good",)), ("b", ("early",))], "review_id string, annotation struct<verdict: string>")
    shown = spark.createDataFrame([("a", ("p",)), ("b", ("hidden",))], "review_id string, proposal struct<box: string>")
    out = R.export_reviews(reviews, said, shown)
    assert sorted((r.review_id, r.annotation and r.annotation.verdict, r.proposal and r.proposal.box) for r in out.collect()) == [("a", "good", "p"), ("b", None, None), ("c", None, None), ("d", None, None)]
    assert sorted((r.session_id, r.reviewed, r.pending) for r in R.pending_reviews(out).collect()) == [(1, 1, ["c", "b"]), (2, 1, [])]
    assert rules(R.export_violations(reviews, said, shown), "review_id") == {"b": ["annotated_but_pending"], "d": ["annotation_missing", "proposal_missing"]}
