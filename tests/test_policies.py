"""Plans and policies: one row breaks one rule."""

import pytest
from pyspark.sql import functions as F

from reelwork.operators import policies as L
from reelwork.operators import projection as P

_EVIDENCE = "candidate_id: string, rank: int, asset_id: string, event_id: string, frame_id: string"
H = f"struct<{_EVIDENCE}, strategy: string, zoom_intent: string, target_description: string, confidence: double>"
V = f"struct<{_EVIDENCE}, strategy: string, target_description: string, regions: array<{P.REGION}>, confidence: double>"
CHAPTER = f"""chapter string, evidence_status string, horizontal_frame_id string, vertical_frame_id string, horizontal_strategy string, horizontal_zoom_intent string, horizontal_target_description string, vertical_strategy string, vertical_target_description string,
    horizontal_candidates array<{H}>, vertical_candidates array<{V}>"""


def h(name="c1", rank=1, frame="RF000001", strategy="original", zoom="none", target=None, confidence=0.5):
    return (name, rank, "a", "e", frame, strategy, zoom, target, confidence)


def v(*regions, name="c1", rank=1, frame="RF000001", strategy="tracked_crop", target=None):
    return (name, rank, "a", "e", frame, strategy, target, list(regions), 0.5)


H2, V2 = h("c2", 2, "RF000002"), v(name="c2", rank=2, frame="RF000002", strategy="fit_with_background")


def chapter(name, hc=None, vc=None, **given):
    """A chapter whose own fields are those of its first candidates, unless they are given."""
    hc, vc = [h(), H2] if hc is None else hc, [v(target="t"), V2] if vc is None else vc
    row = {"chapter": name, "evidence_status": "supported", "h": hc[0][4] if hc else "RF000001", "v": vc[0][4] if vc else "RF000001"}
    row |= dict(zip(("hs", "hz", "ht"), hc[0][5:8] if hc else ("original", "none", None), strict=True)) | dict(zip(("vs", "vt"), vc[0][5:7] if vc else ("fit_with_background", None), strict=True))
    return (*(row | given).values(), hc, vc)


def region(name="r", role="required", atomic=False, share=None, said=("x",), entity="e"):
    return (name, entity, "text", "subject", role, atomic, share, list(said))


def test_plan_rules(spark):
    bare = {"hc": [], "vc": []}
    rows = {
        "good": {}, "bare": bare, "lost": bare | {"evidence_status": "not_found"}, "kept": {"evidence_status": "not_found", "h": None, "v": None}, "none": bare | {"v": None}, "zoom": bare | {"hs": "tracked_reframe", "ht": "t"}, "still": bare | {"hz": "subtle"}, "aim": bare | {"vs": "tracked_crop"},
        "fine": {"vc": [v(region()), V2]}, "one": {"hc": [h()]}, "ranks": {"hc": [h(), h("c2", 3, "RF000002")]}, "again": {"hc": [h(), h("c1", 2, "RF000002")]}, "evidence": {"vc": [v(target="t"), v(name="c2", rank=2, strategy="fit_with_background")]}, "head": {"hc": [h("c2", 2, "RF000002"), h()], "h": "RF000002"}, "turned": {"hc": [H2, h()], "h": "RF000001"},
        "h-zoom": {"hc": [h(), h("c2", 2, "RF000002", "tracked_reframe", "subtle", "")]}, "frame": {"hc": [h(), h("c2", 2, "X", confidence=1.5)]}, "aimless": {"vc": [V2[:1] + (1,) + V2[2:], v(region(role="preferred"), rank=2)]}, "loose": {"vc": [v(region(), strategy="fit_with_background"), V2]},
        "same": {"vc": [v(region(), region()), V2]}, "share": {"vc": [v(region(share=0.9)), V2]}, "atom": {"vc": [v(region("a", "preferred", True, 0.9), region("b", entity=None)), V2]}, "keep": {"vc": [v(region("k", "avoid_overlay", share=0.0), region("b", entity=None)), V2]}, "said": {"vc": [v(region(said=("x", " ", "x"))), V2]},
    }
    df = spark.createDataFrame([chapter(k, **g) for k, g in rows.items()], CHAPTER)
    got = {}
    for r in P.plan_violations(df).collect():
        got.setdefault(r.chapter, []).append((r.aspect, r.rule))
    x, y = "horizontal", "vertical"
    assert {k: sorted(q, key=str) for k, q in got.items()} == {
        "lost": [(None, "frames_without_evidence")], "kept": [(None, "horizontal_head_differs"), (None, "horizontal_options_without_evidence"), (None, "vertical_head_differs"), (None, "vertical_options_without_evidence")], "none": [(None, "frames_missing")], "zoom": [(None, "reframe_needs_zoom_and_target")], "still": [(None, "zoom_without_reframe")],
        "aim": [(None, "crop_needs_target")], "one": [(None, "horizontal_two_to_four_options")], "ranks": [(None, "horizontal_ranks")], "again": [(None, "horizontal_repeated_candidate")], "evidence": [(None, "vertical_same_evidence")], "head": [(None, "horizontal_head_differs")],
        "h-zoom": [(x, "reframe_needs_zoom_and_target")], "frame": [(x, "confidence_range"), (x, "frame_id")], "aimless": [(y, "crop_needs_target")], "loose": [(y, "regions_without_crop")], "same": [(y, "repeated_entity"), (y, "repeated_region")], "share": [(y, "required_not_whole")],
        "atom": [(y, "atomic_not_whole")], "keep": [(y, "keepout_with_share")], "said": [(y, "empty_relation"), (y, "repeated_relation")],
    }


def test_brief_rules(spark):
    c = lambda i, regions=(), edge=None, clip=None: (i, list(regions), edge, clip)
    rows = [("good", 60.0, [c("a", [("r", "required")])]), ("long", 91.0, [c("a")]), ("empty", 70.0, []), ("twice", 70.0, [c("a"), c("a")]), ("same", 70.0, [c("a", [("r", "required"), ("r", "required")])]), ("soft", 70.0, [c("a", [("r", "preferred")])]), ("edge", 70.0, [c("a", edge="preserve_start")]), ("clip", 70.0, [c("a", edge="preserve_start", clip="controlled_clip")])]
    df = spark.createDataFrame(rows, "project_id string, target_duration_seconds double, chapters array<struct<feature_id: string, vertical_regions: array<struct<region_id: string, role: string>>, vertical_edge_priority: string, vertical_overflow_policy: string>>")
    got = {r.project_id: r.rule for r in P.brief_violations(df).collect()}
    assert got == {"long": "duration", "empty": "chapters", "twice": "repeated_chapter", "same": "repeated_region", "soft": "no_required_region", "edge": "edge_needs_clip"}


SAVED = "binding_version origin catalog_sha256 brief_sha256 plan_sha256 plan_prompt_sha256 system_instruction_sha256 model_id model_id_sha256 response_schema_sha256 request_sha256 reframe_policy_sidecar_sha256 source_plan_binding_sha256 selection_fingerprint".split()
SOURCE = "binding_version origin catalog_path catalog_sha256 brief_path brief_sha256 plan_path plan_sha256 request_path request_sha256 plan_prompt_sha256 system_instruction_sha256 model_id model_id_sha256 response_schema_sha256 pointer_path projection_pointer_sha256 pointer_record_sha256 record_path record_root projection_record_sha256".split()
SIDE = "project_id catalog_id catalog_path catalog_sha256 source_brief_path source_brief_sha256 source_plan_path source_plan_sha256 source_binding_path source_binding_sha256 selection_fingerprint".split()
POLICY = "sidecar_path sidecar_sha256 sidecar_root".split()
RECORD = "catalog_sha256 brief_sha256 feature_plan_sha256".split()
_struct = lambda names, more="": "struct<" + ", ".join(f"{n}: string" for n in names) + more + ">"
BUNDLE = f"bundle_id string, project_id string, catalog_id string, catalog_path string, brief_path string, plan_path string, selection_fingerprint string, saved {_struct(SAVED)}, source {_struct(SOURCE, f', record: {_struct(RECORD)}')}, sidecar {_struct(SIDE)}, policy {_struct(POLICY)}"
FILES = {"/catalog": "h1", "/brief": "h2", "/plan": "h3", "/side/s": "h4", "/old/brief": "h5", "/old/plan": "h6", "/old/binding": "h7", "/request": "h8", "/pointer": "h9", "/records/r": "h10"}


def bundle(name, **change):
    model = {"plan_prompt_sha256": "m1", "system_instruction_sha256": "m2", "model_id": "m3", "model_id_sha256": "m4", "response_schema_sha256": "m5", "request_sha256": "h8"}
    top = {"bundle_id": name, "project_id": "p", "catalog_id": "c", "catalog_path": "/catalog", "brief_path": "/brief", "plan_path": "/plan", "selection_fingerprint": "f"}
    saved = model | {"binding_version": "feature-plan-binding-v1", "origin": "human_reframe_policy", "catalog_sha256": "h1", "brief_sha256": "h2", "plan_sha256": "h3", "reframe_policy_sidecar_sha256": "h4", "source_plan_binding_sha256": "h7", "selection_fingerprint": "f"}
    source = model | {
        "binding_version": "feature-plan-binding-v1", "origin": "external_projection", "catalog_path": "/catalog", "catalog_sha256": "h1", "brief_path": "/old/brief", "brief_sha256": "h5", "plan_path": "/old/plan", "plan_sha256": "h6", "request_path": "/request", "pointer_path": "/pointer", "projection_pointer_sha256": "h9",
        "pointer_record_sha256": "h10", "record_path": "/records/r", "record_root": "/records", "projection_record_sha256": "h10",
    }
    side = {"project_id": "p", "catalog_id": "c", "catalog_path": "/catalog", "catalog_sha256": "h1", "source_brief_path": "/old/brief", "source_brief_sha256": "h5", "source_plan_path": "/old/plan", "source_plan_sha256": "h6", "source_binding_path": "/old/binding", "source_binding_sha256": "h7", "selection_fingerprint": "f"}
    policy, record = {"sidecar_path": "/side/s", "sidecar_sha256": "h4", "sidecar_root": "/side"}, {"catalog_sha256": "h1", "brief_sha256": "h5", "feature_plan_sha256": "h6"}
    parts = {"top": top, "saved": saved, "source": source, "sidecar": side, "policy": policy, "record": record}
    for key, value in change.items():
        part, field = key.split("__")
        parts[part] = None if field == "all" else parts[part] | {field: value}
    row = lambda names, part, *more: None if part is None else (*[part[n] for n in names], *more)
    return (*parts["top"].values(), row(SAVED, parts["saved"]), row(SOURCE, parts["source"], row(RECORD, parts["record"])), row(SIDE, parts["sidecar"]), row(POLICY, parts["policy"]))


CASES = {
    "good": ({}, set()), "brief": ({"saved__brief_sha256": "x"}, {("saved_brief", "differs")}), "file": ({"source__request_path": "/gone"}, {("source_request", "no_file")}), "escape": ({"policy__sidecar_root": "/other"}, {("policy_sidecar", "escapes_folder")}), "dots": ({"source__record_path": "/records/../records/r"}, {("projection_record", "escapes_folder"), ("projection_pointer_record", "escapes_folder")}),
    "pointer": ({"source__pointer_record_sha256": "x"}, {("projection_pointer_record", "differs")}), "record": ({"record__brief_sha256": "x"}, {("record_brief_sha256", "differs")}), "origin": ({"saved__origin": "fresh"}, {("saved_origin", "differs")}), "selection": ({"top__selection_fingerprint": "g"}, {("selection", "differs"), ("saved_selection", "differs")}),
    "model": ({"saved__model_id": "x"}, {("saved_model_id", "differs")}), "bare": ({"source__model_id": None, "saved__model_id": None}, {("source_model_id", "not_complete")}), "project": ({"sidecar__project_id": "q"}, {("project", "differs")}), "path": ({"source__plan_path": "/plan", "source__plan_sha256": "h3", "record__feature_plan_sha256": "h3"}, {("source_plan_path", "differs")}),
    "plain": ({"source__origin": "fresh", "source__pointer_path": None, "source__record_path": None, "record__brief_sha256": "x"}, set()), "sidecar": ({"saved__reframe_policy_sidecar_sha256": "x"}, {("saved_sidecar", "differs")}), "catalog": ({"sidecar__catalog_sha256": "x"}, {("sidecar_catalog", "differs")}),
}


def test_policy_lineage(spark):
    df = spark.createDataFrame([bundle(k, **c) for k, (c, _) in CASES.items()] + [bundle("unbound", policy__all=None)], BUNDLE)
    got = {}
    for r in L.binding_mismatches(df, spark.createDataFrame(list(FILES.items()), "path string, sha256 string")).collect():
        got.setdefault(r.bundle_id, set()).add((r.kind, r.rule))
    assert ("policy_binding", "absent") in got.pop("unbound")
    assert got == {k: want for k, (_, want) in CASES.items() if want}


def test_policy_changes_what_it_names(spark):
    kind = "project_id string, feature_id string, vertical_overflow_policy string, vertical_edge_priority string, vertical_crop_mode string, vertical_regions array<struct<region_id: string, role: string>>"
    chapters = spark.createDataFrame([("p", f, "preserve_all", "balanced", "strict", [("r", "required")]) for f in "abcd"] + [("q", "a", "preserve_all", "balanced", "strict", [])], kind)
    overrides = spark.createDataFrame([("p", "a", "controlled_clip", "preserve_start", None, None), ("p", "b", None, "preserve_end", None, None), ("p", "c", None, None, "primary_center", [("x", "preferred"), ("x", "preferred")]), ("p", "z", None, None, None, None), ("q", "a", "controlled_clip", None, None, None), ("q", "a", "controlled_clip", None, None, None)], kind)
    got = {(r.project_id, r.feature_id): r for r in L.apply_policy(chapters, overrides.where("project_id = 'p'")).collect()}
    assert (got["p", "a"].vertical_overflow_policy, got["p", "a"].vertical_crop_mode, got["p", "a"].overridden) == ("controlled_clip", "strict", True) and not got["p", "d"].overridden
    bindings = spark.createDataFrame([("p",)], "project_id string")
    rules = sorted(map(tuple, L.revised_brief_violations(chapters, overrides, bindings).collect()))
    assert rules == [("p", "b", "edge_needs_clip"), ("p", "c", "duplicate_region"), ("p", "c", "no_required_region"), ("p", "z", "unknown_chapter"), ("q", "a", "clip_needs_binding"), ("q", "a", "duplicate_chapter")]
    assert L.apply_policy(chapters, overrides.limit(0)).where(F.col("overridden")).count() == 0


@pytest.mark.parametrize("name", ["binding_mismatches", "apply_policy"])
def test_public_names(name):
    assert getattr(L, name).__doc__
