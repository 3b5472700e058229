"""Functions and operators on literal rows."""

import dataclasses
import hashlib
import json
import math
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from reelwork.functions import geometry as G
from reelwork.functions.text import contract_id, label_similarity, normalized, safe_token
from reelwork.functions.times import mmss_to_ms, ms_to_mmss, pts_to_ms
from reelwork.operators import candidates as K
from reelwork.operators import compare as C
from reelwork.operators import crops as P
from reelwork.operators import locks as L
from reelwork.operators import segments as Q
from reelwork.operators import shots as S
from reelwork.operators import tracks as T
from reelwork.operators import usage as U
from reelwork.session import find_package
from reelwork.sources import registry as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_boxes(spark):
    box = [F.lit(v) for v in (0, 0, 100, 100)]
    other = [F.lit(v) for v in (50, 0, 150, 100)]
    row = one(spark, G.iou(box, other).alias("iou"), G.center_distance(box, other).alias("distance"), G.iou([F.lit(0)] * 4, [F.lit(0)] * 4).alias("none"), *[c.alias(n) for c, n in zip(G.padded(box, 0.1), "abcd", strict=True)])
    assert math.isclose(row.iou, 1 / 3) and row.distance == 50 and row.none == 0
    assert (row.a, row.c) == (0, 110)
    # the padding is rounded, half to even, and not the corner
    small = one(spark, *[c.alias(n) for c, n in zip(G.padded([F.lit(v) for v in (1, 100, 6, 115)], 0.1), "abcd", strict=True)])
    assert (small.a, small.b, small.c, small.d) == (1, 98, 6, 117)
    assert one(spark, G.yxyx_to_xyxy(F.array(*map(F.lit, (10, 20, 30, 40)))).alias("b")).b == [20, 10, 40, 30]
    assert one(spark, G.yxyx_to_xyxy(F.array(*map(F.lit, (30, 20, 10, 40)))).alias("b")).b is None


def test_times(spark):
    row = one(spark, mmss_to_ms(F.lit("02:05")).alias("a"), mmss_to_ms(F.lit("2:65")).alias("b"), ms_to_mmss(F.lit(6_125_999)).alias("c"))
    assert (row.a, row.b, row.c) == (125_000, None, "102:05")
    cases = [(p, s, n, d) for p in (-7, 0, 1, 3, 5, 1001, 7007) for s in (0, 2) for n, d in ((1, 30000), (1, 2000), (1001, 30000))]
    df = spark.createDataFrame(cases, "p long, s long, n long, d long").select("*", pts_to_ms(F.col("p"), F.col("s"), F.col("n"), F.col("d")).alias("ms"))
    from fractions import Fraction

    for r in df.collect():
        assert r.ms == round(Fraction((r.p - r.s) * r.n * 1000, r.d))


def test_text(spark):
    find_package(spark)
    row = one(spark, normalized(F.lit(" a-b 9ß")).alias("a"), safe_token(F.lit(" Clip #7! ")).alias("b"), contract_id(F.lit("ok-1"), "x").alias("c"), contract_id(F.lit("not ok"), "x").alias("d"))
    assert row.a.startswith("AB9") and row.b == "Clip-7" and row.c == "ok-1" and row.d.startswith("x-") and len(row.d) == 18
    cases = [(" a:b ", "a:b"), ("x" * 300, "x" * 300), ("-a", None), ("", None), ("a b", None), ("a\n", "a"), (".a", None), ("9_.:-", "9_.:-")]
    for r in spark.createDataFrame(cases, "v string, want string").select("*", contract_id(F.col("v"), "asset").alias("got")).collect():
        assert r.got == (r.want or "asset-" + hashlib.sha256(r.v.strip().encode()).hexdigest()[:16])
    tokens = [("A b:c", "A-b:c"), ("--..", "region"), ("", "region"), (".x-", "x"), ("é1", "1")]
    assert [r.t for r in spark.createDataFrame(tokens, "v string, w string").select(safe_token(F.col("v")).alias("t")).collect()] == [w for _v, w in tokens]
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string").select(label_similarity("a", "b").alias("s"))
    assert [r.s for r in df.collect()] == [0.25, 0.5, None]


def test_region_kinds(spark):
    want = {"text_region": "text_region", "phone_screen": "ui_region", "screen": "ui_region", "ui_element": "ui_region", "logo": "graphic", "other": "other", "person": "subject", "product": "subject", None: "subject"}
    got = {r.k: r.v for r in spark.createDataFrame([(k,) for k in want], "k string").select("k", K.region_kind(F.col("k")).alias("v")).collect()}
    assert got == want


def test_dense_rates_and_grids(spark):
    cases = [("required", "Fast cut", 8), ("required", "UI panel", 8), ("required", "快速移動", 8), ("required", "短暫", 8), ("required", "lasts 0.4 s", 8), ("required", "transient", 8), ("required", "sudden flash", 4), ("recommended", "fast", 4), ("none", "fast", 2)]
    got = spark.createDataFrame(cases, "i string, t string, w int").select("w", S.dense_fps(F.col("i"), F.col("t")).alias("fps")).collect()
    assert all(r.w == r.fps for r in got)
    windows = spark.createDataFrame([(1, 1, 0, 1000, 333, 5000), (1, 2, 0, 1000, None, 5000), (1, 3, 0, 1000, 1000, 5000), (1, 4, 4500, 5200, 5100, 5000), (1, 5, 0, 8000, None, 9000)], "asset_id long, event_id long, window_start long, window_end long, keyframe_ms long, duration_ms long")
    times = lambda df: {e: sorted(r.frame_ms for r in rows) for e, rows in grouped(df.collect()).items()}

    def grouped(rows):
        out = {}
        for r in rows:
            out.setdefault(r.event_id, []).append(r)
        return out

    assert times(S.dense_grid(windows, 500)) == {1: [0, 333, 500], 2: [0, 500], 3: [0, 500], 4: [4500, 4999], 5: list(range(0, 8000, 500))}
    # a grid over the limit is no frames and a violation, and is not cut
    assert 5 not in times(S.dense_grid(windows, 2)) and [(r.event_id, r.frames) for r in S.dense_grid_violations(windows, 2).collect()] == [(5, 4000)]


def test_review_reasons_and_consensus(spark):
    rows = [
        (1, True, False, False, True, "seed", [" zoom", "", "zoom", "pan"], ["manifest_requires_gemini_review", "required_region_tracking_coverage_failed", "required_region_full_containment_infeasible", "controlled_required_region_clip", "fallback:seed", "risk:zoom", "risk:pan"]),
        (2, False, True, True, False, "", None, []), (3, None, None, None, None, None, [], []),
    ]
    df = spark.createDataFrame(rows, "id int, requires_review boolean, coverage_passed boolean, containment_feasible boolean, controlled_clip boolean, fallback_reason string, risk_codes array<string>, want array<string>")
    assert all(r.want == r.reasons for r in Q.review_reasons(df).collect())

    readings = {1: ["A", "a.", "B"], 2: ["", " ", "C"], 3: ["X", "x"], 4: ["X", "X"], 5: ["", ""], 6: ["B", "A"], 7: ["X", "X"]}
    said = spark.createDataFrame([(k, i, t) for k, v in readings.items() for i, t in enumerate(v)], "claim_id int, pos int, relevant_text string")
    claims = spark.createDataFrame([(1, "A", None), (2, "c", None), (3, "X", None), (4, "Y", None), (5, "", None), (6, "B", None), (7, "X", "Z")], "claim_id int, claim_text string, selected_text string")
    got = {r.claim_id: (r.text, r.votes, r.total, r.matches, r.status) for r in Q.text_consensus(said, claims).collect()}
    assert got == {
        1: ("A", 2, 3, True, "uncertain"), 2: ("C", 1, 3, True, "uncertain"), 3: ("X", 2, 2, True, "machine_verified"), 4: ("X", 2, 2, False, "needs_human_review"),
        5: ("", 0, 2, True, "uncertain"), 6: ("B", 1, 2, True, "uncertain"), 7: ("X", 2, 2, True, "needs_human_review"),
    }


def test_usage(spark):
    rows = [("r/attempts/1.json", "p", 100, 10), ("r/attempts/2.json", "p", 100, 10), ("r/copy.json", "p", 100, 10), ("r/a.json", "q", 50, 0), ("r/b.json", "q", 50, 0)]
    log = spark.createDataFrame(rows, "path string, payload string, input_tokens long, cached_tokens long").withColumns({"model": F.lit("m-a"), "output_tokens": F.lit(4), "thought_tokens": F.lit(6), "has_usage": F.lit(True)})
    assert sorted(r.path for r in U.usage_dedup(log).collect()) == ["r/a.json", "r/attempts/1.json", "r/attempts/2.json"]
    cost = U.usage_cost(log, U.price_table(spark, U.EXAMPLE_PRICES)).first()
    assert (cost.requests, cost.input_tokens, cost.billed_output_tokens) == (3, 250, 30)
    assert math.isclose(cost.input_cost, (230 * 1.5 + 20 * 0.15) / 1e6, abs_tol=1e-8)


def test_shots(spark):
    boundaries = spark.createDataFrame([(1, 2000, 0.5), (1, 4000, 0.7), (1, 4000, 0.9), (1, 0, 0.9), (1, 6000, 0.9)], "asset_id long, t_ms long, score double").withColumn("duration_ms", F.lit(6000).cast("long"))
    assets = spark.createDataFrame([(1, 6000), (2, 500)], "asset_id long, duration_ms long")
    shots = S.shots_from_scores(boundaries, assets)
    assert sorted((r.asset_id, r.start_ms, r.end_ms) for r in shots.collect()) == [(1, 0, 2000), (1, 2000, 4000), (1, 4000, 6000), (2, 0, 500)]
    events = spark.createDataFrame([(1, 1, 1500, 2500), (1, 2, 2000, 4000)], "asset_id long, event_id long, start_ms long, end_ms long")
    assert {r.event_id: (r.shot_ids, r.exact_frame_required) for r in S.event_shot_overlap(events, shots).collect()} == {1: ([1, 2], True), 2: ([2], False)}


def test_greedy_matching_forms_agree(spark):
    random.seed(3)
    rows = [(g, a, b, random.choice([0.2, 0.5, 0.5, 0.9])) for g in range(6) for a in range(random.randint(1, 5)) for b in range(random.randint(1, 5))]
    pairs = spark.createDataFrame(rows, "g long, l long, r long, similarity double")

    def brute(group):
        out, left, right = set(), set(), set()
        for s, a, b in sorted(((s, a, b) for g, a, b, s in rows if g == group), key=lambda x: (-x[0], x[1], x[2])):
            if a not in left and b not in right:
                left.add(a), right.add(b), out.add((group, a, b))
        return out

    want = set().union(*(brute(g) for g in range(6)))
    for form in (C.greedy_match, C.greedy_match_rounds):
        assert {(r.g, r.l, r.r) for r in form(pairs, ["g"], "l", "r").collect()} == want


def test_track_states_and_smoothing(spark):
    random.seed(5)
    rows = [(t, i, i * 100, random.choice([0.0, 0.1, 0.2, 0.9]), random.randint(0, 6), random.random(), x := random.randint(0, 500), 10, x + 100, 110, 6) for t in range(3) for i in range(20)]
    names = "track_id long, sample_index long, t_ms long, area_ratio double, components long, probability double, x_min long, y_min long, x_max long, y_max long, seed_index long"
    samples = spark.createDataFrame(rows, names)
    want = {}
    for t in range(3):
        for part in (range(6), range(6, 20)):
            areas, center = [], None
            for i in part:
                r = rows[t * 20 + i]
                area, c = r[3], ((r[6] + r[8]) / 2, 60)
                if area <= 0:
                    want[t, i] = "lost"
                    continue
                last = sorted(areas[-5:])
                ratio = area / last[len(last) // 2] if last else 1
                drift = ratio < 0.4 or ratio > 2.5 or (center is not None and math.dist(c, center) > 220)
                want[t, i] = "drift_suspected" if drift else "low_confidence" if r[4] > 4 or r[5] < 0.6 else "tracked"
                areas.append(area)
                center = c
    assert {(r.track_id, r.sample_index): r.state for r in T.track_states(samples).collect()} == want

    values = {(r[0], r[1]): r[6] + 50.0 for r in rows}
    got = {(r.track_id, r.sample_index): r.smoothed for r in P.ema_smooth(samples.withColumn("x", T.center("x")), {"x": "smoothed"}).collect()}
    for t in range(3):
        forward = [values[t, 0]]
        for i in range(1, 20):
            forward.append(0.34 * values[t, i] + 0.66 * forward[-1])
        back = [forward[-1]]
        for v in reversed(forward[:-1]):
            back.append(0.34 * v + 0.66 * back[-1])
        assert all(math.isclose(got[t, i], v) for i, v in enumerate(reversed(back)))


def test_nearest_takes_the_earlier_on_a_tie(spark):
    samples = spark.createDataFrame([(1, 0, 100), (1, 1, 151), (1, 2, 10)], "k long, i long, t_ms long")
    references = spark.createDataFrame([(1, 50, 7), (1, 150, 8), (1, 152, 9)], "k long, reference_ms long, reference_id long")
    assert {r.i: r.reference_ms for r in T.nearest(samples, references, "k").collect()} == {0: 50, 1: 150, 2: 50}


def test_ancestors_and_cycles(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(9)] + [(2, 0, 1), (2, 1, 0), (3, 0, 5)]
    targets = spark.createDataFrame(rows, "query_id long, target_id long, parent_target_id long")
    got = {(r.query_id, r.target_id, r.ancestor_id, r.distance) for r in L.ancestors(targets.where("query_id = 1")).collect()}
    assert got == {(1, i, j, i - j) for i in range(9) for j in range(i)}
    assert {(r.query_id, r.target_id, r.rule) for r in L.ancestor_violations(targets).collect()} == {(2, 0, "cycle"), (2, 1, "cycle"), (3, 0, "unknown_parent")}


PREFLIGHT = "chapter int, candidate_id string, rank int, strategy string, lineage_ok boolean, single_shot boolean, confidence double, semantic_status string, confidence_ok boolean, coverage_ok boolean, checkpoints_ok boolean, regions array<struct<region_id:string,role:string,atomic:boolean,assessed:boolean,min_visible:double,required_visible:double,overlap:double>>, max_speed double, max_acceleration double, max_jerk double, geometry_fingerprint string, expected_fingerprint string, source_fingerprint string, track_fingerprints array<string>"


def preflight(name, *, rank=1, core=1.0, soft=0.8, more=(), **changes):
    regions = [("core", "hard_core", False, True, core, 1.0, 0.0), ("context", "soft_extent", False, True, soft, 0.72, 0.0), *more]
    row = {
        "chapter": 1, "candidate_id": name, "rank": rank, "strategy": "tracked_crop", "lineage_ok": True, "single_shot": True, "confidence": 0.8, "semantic_status": "matched", "confidence_ok": True, "coverage_ok": True, "checkpoints_ok": True, "regions": regions,
        "max_speed": 0.0, "max_acceleration": 0.0, "max_jerk": 0.0, "geometry_fingerprint": "a" * 64, "expected_fingerprint": "a" * 64, "source_fingerprint": "b" * 64, "track_fingerprints": ["c" * 64],
    }
    return tuple((row | changes).values())


def test_gates_one_by_one(spark):
    keepout = ("logo", "overlay_keepout", False, True, 1.0, 0.0, 0.1)
    cases = {
        "none": ({}, []), "lineage": ({"lineage_ok": False}, ["source_lineage_invalid"]), "shot": ({"single_shot": False}, ["shot_boundary_crossing"]), "confidence": ({"confidence": -0.1}, ["evidence_confidence_below_minimum"]),
        "ambiguous": ({"semantic_status": "ambiguous"}, ["target_ambiguity_above_maximum"]), "unseen": ({"semantic_status": "not_visible"}, ["semantic_match_below_minimum"]), "later": ({"semantic_status": "not_revalidated"}, []),
        "track": ({"confidence_ok": False}, ["track_confidence_below_minimum"]), "coverage": ({"coverage_ok": False}, ["track_coverage_below_minimum"]), "switch": ({"checkpoints_ok": False}, ["identity_switch_detected"]), "unchecked": ({"checkpoints_ok": None}, []),
        "core": ({"core": 0.99}, ["hard_core_not_fully_retained"]), "atomic": ({"more": [("x", "soft_extent", True, True, 0.9, 1.0, 0.0)]}, ["atomic_region_clipped", "soft_extent_below_minimum"]), "soft": ({"soft": 0.4}, ["soft_extent_below_minimum"]),
        "keepout": ({"more": [keepout]}, ["overlay_keepout_violated"]), "unassessed": ({"more": [("x", "hard_core", False, False, 0.0, 1.0, 0.0)]}, ["hard_core_not_fully_retained"]), "unassessed_soft": ({"more": [("x", "soft_extent", False, False, 0.0, 1.0, 0.0)]}, []),
        "speed": ({"max_speed": 720.1}, ["crop_speed_above_maximum"]), "acceleration": ({"max_acceleration": 1800.1}, ["crop_acceleration_above_maximum"]), "jerk": ({"max_jerk": 7200.1}, ["crop_jerk_above_maximum"]), "limits": ({"max_speed": 720.0, "max_acceleration": 1800.0, "max_jerk": 7200.0}, []),
        "fingerprint": ({"expected_fingerprint": "d" * 64}, ["geometry_fingerprint_mismatch"]), "not_compared": ({"expected_fingerprint": None}, []), "center": ({"strategy": "center_crop"}, ["no_feasible_presentation"]),
        "twice": ({"core": 0.5, "more": [("x", "hard_core", False, True, 0.5, 1.0, 0.0)]}, ["hard_core_not_fully_retained"]),
    }
    df = spark.createDataFrame([preflight(k, **changes) for k, (changes, _want) in cases.items()], PREFLIGHT)
    assert {r.candidate_id: r.codes for r in K.with_codes(df).collect()} == {k: want for k, (_c, want) in cases.items()}
    strict = {r.candidate_id: r.codes for r in K.with_codes(df, K.Policy(require_semantic_checkpoints=True, allow_safe_center_crop=True)).collect()}
    assert strict["unchecked"] == ["identity_switch_detected"] and strict["center"] == []
    audit = {r.candidate_id: (r.approved, r.applied, len(r.audit_sha256)) for r in K.audit_bounded_clip(df).collect()}
    assert audit["none"] == (True, True, 64) and audit["fingerprint"] == (False, False, 64)


def test_audit_hash_is_that_of_canonical_json(spark):
    policy = K.Policy()
    body = {
        "policy_id": "auto_bounded_clip_v1", "policy_sha256": hashlib.sha256(json.dumps(dataclasses.asdict(policy), sort_keys=True, separators=(",", ":")).encode()).hexdigest(), "candidate_id": "candidate-1", "candidate_rank": 1, "approved": False,
        "auto_bounded_clip_applied": False, "failure_codes": ["geometry_fingerprint_mismatch"], "geometry_fingerprint": "a" * 64, "source_fingerprint": "b" * 64, "track_fingerprints": ["c" * 64],
    }
    got = K.audit_bounded_clip(spark.createDataFrame([preflight("candidate-1", expected_fingerprint="d" * 64)], PREFLIGHT)).first()
    assert got.audit_sha256 == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_passing_candidates_come_first(spark):
    df = spark.createDataFrame([preflight("candidate-1", rank=1, soft=0.4), preflight("candidate-2", rank=2, soft=0.9)], PREFLIGHT)
    assert [r.candidate_id for r in K.rank_preflights(df).orderBy("place").collect()] == ["candidate-2", "candidate-1"]


def test_overrides(spark):
    chapters = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, "a", "b"), (4, "a", "a")], "chapter int, horizontal_candidate_id string, vertical_candidate_id string")
    candidates = spark.createDataFrame([(k, c) for k in (1, 2, 3, 4) for c in "abc"], "chapter int, candidate_id string")
    patch = spark.createDataFrame([(1, "vertical", "c"), (2, "both", "b"), (3, "horizontal", "x"), (4, "both", "b"), (4, "vertical", "c"), (9, "both", "a")], "chapter int, aspect string, candidate_id string")
    wrong = {tuple(r) for r in K.override_violations(chapters, candidates, patch).collect()}
    assert wrong == {(3, "horizontal", "unknown_candidate"), (4, "vertical", "duplicate_override"), (9, "horizontal", "unknown_chapter"), (9, "vertical", "unknown_chapter")}
    assert {tuple(r) for r in K.apply_overrides(chapters, candidates, patch).collect()} == {(1, "a", "c"), (2, "b", "b"), (3, "a", "b"), (4, "b", "a")}


def test_migrated_lock_has_the_hashes_of_canonical_json(spark):
    text = "a target described in far more than forty characters, é and all"
    row = {
        "query_id": "q1", "revision": 3, "editorial_goal": "goal", "claim_source": "brief", "provenance": {"created_at": "d", "created_by": "me"}, "targets": [{"target_id": "a", "target_description": text, "positive_attributes": [], "negative_attributes": ["blue"], "reference_frame_ids": ["f"], "reference_crop_hashes": ["0" * 64]}],
        "observable_predicate": None, "predicate_phases": {"precondition": "p", "apex": "x", "postcondition": "s"}, "required_evidence": ["seen"], "negative_constraints": [], "editing_uses": [], "aspect_constraints": [{"aspect_ratio": "9:16", "required_target_ids": ["a"], "constraint": "keep"}, {"aspect_ratio": "16:9", "required_target_ids": [], "constraint": "wide"}],
    }
    lists = {c: "array<string>" for c in ("required_evidence", "negative_constraints", "editing_uses")}
    schema = ", ".join(f"{c} {k}" for c, k in {
        "query_id": "string", "revision": "int", "editorial_goal": "string", "claim_source": "string", "provenance": "struct<created_at:string,created_by:string>", "targets": "array<struct<target_id:string,target_description:string,positive_attributes:array<string>,negative_attributes:array<string>,reference_frame_ids:array<string>,reference_crop_hashes:array<string>>>",
        "observable_predicate": "string", "predicate_phases": "struct<precondition:string,apex:string,postcondition:string>", **lists, "aspect_constraints": "array<struct<aspect_ratio:string,required_target_ids:array<string>,constraint:string>>",
    }.items())
    bare = row | {"query_id": "q2", "predicate_phases": None}
    uneven = row | {"query_id": "q3", "targets": [row["targets"][0] | {"reference_frame_ids": []}]}
    approval = {"approval_source": "human_review", "approved_at": "d", "approved_by": "me", "policy_reference": None, "source_reference": None}
    approvals = spark.createDataFrame([{"query_id": q, "approval": approval} for q in ("q1", "q2", "q3")], "query_id string, approval struct<approval_source:string,approved_at:string,approved_by:string,policy_reference:string,source_reference:string>")
    got = {r.query_id: r for r in L.approve(L.migrate_locks(spark.createDataFrame([row, bare, uneven], schema)), approvals).collect()}
    assert got["q2"].rule == "evidence_without_predicate" and got["q3"].rule == "anchor_lengths" and got["q3"].definition_sha256 is None

    def sha(value):
        return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()

    identity = {"targets": [{"target_id": "a", "target_description": text, "scope": "whole_instance", "identity_cues": [text], "context_cues": [], "positive_anchors": [{"frame_id": "f", "crop_sha256": "0" * 64}], "stable_exclusions": ["blue"], "negative_anchors": []}]}
    predicate = {"predicate_id": "q1:predicate", "statement": "Observable transition: p; x; s", "participant_target_ids": ["a"], "required_at": "transition", "phases": row["predicate_phases"], "required_evidence": ["seen"], "disqualifying_conditions": []}
    aspects = [{**a, "target_visibility_constraints": [], "required_target_clipping_policy": "forbid"} for a in row["aspect_constraints"]]
    framing = {"required_target_ids": ["a"], "preferred_target_ids": [], "sacrificable_target_ids": [], "overlay_keepout_target_ids": [], "framing_intent": "keep; wide", "editing_uses": [], "aspect_constraints": aspects}
    parts = {"identity_sha256": sha(identity), "predicate_sha256": sha(predicate), "framing_sha256": sha(framing)}
    assert {c: got["q1"][c] for c in parts} == parts
    assert got["q1"].composite_sha256 == sha({"contract_version": "evidence-query-v2", "editorial_goal": "goal", **parts})
    whole = {"contract_version": "evidence-query-lock-v2", "query_id": "q1", "revision": 3, "editorial_goal": "goal", "identity": identity, "predicate": predicate, "framing": framing, "claim_source": "brief", "provenance": row["provenance"], "approval": {k: v for k, v in approval.items() if v}}
    assert got["q1"].definition_sha256 == sha(whole)


def crop_rows(boxes, **more):
    return [{"track_id": 1, "sample_index": i, "seconds": i / 5, "x_min": b[0], "y_min": b[1], "x_max": b[2], "y_max": b[3], "source_width": 1920, "source_height": 1080, **more} for i, b in enumerate(boxes)]


def test_crop_path_holds_what_fits_and_clips_only_if_told(spark):
    fits = P.crop_path(spark.createDataFrame(crop_rows([(100 + 9 * i, 100, 300 + 9 * i, 900) for i in range(40)], safety=1.08)), 1080, 1920)
    audit = P.crop_audit(fits).first()
    assert audit.all_feasible and audit.not_contained == 0 and audit.min_visible_area == 1.0 and audit.max_speed_y == 0.0 and 0 < audit.max_speed_x < 720
    left = [r.left for r in fits.orderBy("sample_index").collect()]
    assert left == sorted(left)
    wide = [(100, 100, 700, 900)] * 3
    for priority, at in (("preserve_start", 100.0), ("preserve_end", 700 - 1080000 / 3414), ("balanced", 400 - 540000 / 3414)):
        path = P.crop_path(spark.createDataFrame(crop_rows(wide, overflow_policy="controlled_clip", edge_priority=priority)), 1080, 1920)
        assert all(math.isclose(r.left, at) for r in path.collect())
        audit = P.crop_audit(path).first()
        assert audit.controlled_clip and not audit.all_feasible and audit.not_contained == 3 and audit.min_visible_width == round(1080000 / 3414 / 600, 6)
    kept = P.crop_audit(P.crop_path(spark.createDataFrame(crop_rows(wide)), 1080, 1920)).first()
    assert not kept.controlled_clip and not kept.all_feasible


def test_smoothing_of_a_long_track_is_that_of_all_its_samples(spark):
    values = [random.Random(7).random() * 1000 for _ in range(1)] + [random.Random(i).random() * 1000 for i in range(700)]
    series = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "track_id long, sample_index long, x double")
    got = [r.s for r in P.ema_smooth(series, {"x": "s"}).orderBy("sample_index").collect()]
    forward = values[:1]
    for v in values[1:]:
        forward.append(0.34 * v + 0.66 * forward[-1])
    back = forward[-1:]
    for v in forward[-2::-1]:
        back.append(0.34 * v + 0.66 * back[-1])
    assert all(math.isclose(a, b, rel_tol=1e-13) for a, b in zip(got, back[::-1], strict=True))


def test_recovery_order(spark):
    codes = lambda *c: F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")
    yes, no = F.lit(True), F.lit(False)
    row = one(spark, K.recovery(codes("shot_boundary_crossing", "crop_speed_above_maximum"), yes).alias("a"), K.recovery(codes("overlay_keepout_violated"), yes).alias("b"), K.recovery(codes("crop_speed_above_maximum"), yes).alias("c"), K.recovery(codes("track_coverage_below_minimum"), yes, yes).alias("d"), K.recovery(codes("x"), yes).alias("e"), K.recovery(codes("source_lineage_invalid"), no).alias("f"), K.recovery(codes(), no).alias("g"))
    assert tuple(row) == ("split_at_shot_boundary", "reposition_overlay", "try_simpler_motion", "try_alternate_seed", "try_next_candidate", "review_required", "fit_with_background")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.run.json").write_text('{"id": 1,\n "name": "n"}')
    (tmp_path / "b.MP4").write_bytes(b"same")
    (tmp_path / "a" / "B.mp4").write_bytes(b"same")
    (tmp_path / "c.doc").write_bytes(b"no")
    assert [(r.id, r.name) for r in R.read_artifacts(spark, str(tmp_path), "*.run.json", "id int, name string").collect()] == [(1, "n")]
    files = R.media_registry(R.read_files(spark, str(tmp_path))).withColumn("duration_ms", F.lit(5))
    found = R.dedupe_assets(R.content_identity(files))
    assert sorted(r.status for r in found.collect()) == ["accepted", "duplicate_skipped"]
    totals = R.library_totals(found).first()
    assert (totals.inputs, totals.unique_assets, totals.duration_ms) == (2, 1, 5)
    folder = str(tmp_path / "attempts")
    for attempt in (1, 2):
        R.append_attempts(spark.createDataFrame([("s", f"p{attempt}", attempt)], "subject string, path string, attempt long"), folder)
    assert U.latest_attempt(spark.read.parquet(folder)).first().path == "p2"


def test_similarity_is_scored_once_a_pair():
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25
