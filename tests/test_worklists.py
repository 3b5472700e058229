"""Each gate of the geometry worklist turns one request away, and each kind of seed is taken once."""

from reelwork.operators import tracks as T
from reelwork.operators import worklists as G

REQUEST = "request_id string, asset_id string, event_id string, query_id string, query_target_id string, target_id string, target_description string, accept_proposal boolean, checkpoint_budget int, has_decision boolean"


def request(name, event="e", query=None, wanted=None, target=None, text=None, accept=False, budget=2, decision=False):
    return (name, "a", event, query, wanted, target, text, accept, budget, decision)


CASES = {
    "explicit": (request("explicit", target="t", text="x"), None), "accept": (request("accept", accept=True), None), "middle": (request("middle", "plain", target="t", text="x"), None), "dense": (request("dense", "d", target="t", text="x"), None), "locked": (request("locked", query="one"), None),
    "picked": (request("picked", query="two", wanted="k"), None), "seeded": (request("seeded", "s", query="pred", decision=True), None), "bracket": (request("bracket", "i", query="int", decision=True), None), "again": (request("again", "g", target="t", text="x"), None),
    "half": (request("half", target="t"), "half_target"), "both": (request("both", target="t", text="x", accept=True), "target_and_proposal"), "nolock": (request("nolock", target="t", text="x", wanted="k"), "lock_missing"), "alone": (request("alone", target="t", text="x", decision=True), "lock_missing"),
    "budget": (request("budget", target="t", text="x", budget=9), "budget_range"), "mixed": (request("mixed", query="one", accept=True), "lock_and_target"), "event": (request("event", "gone", target="t", text="x"), "unknown_event"), "query": (request("query", query="gone"), "unknown_lock"),
    "wrong": (request("wrong", query="two", wanted="z"), "unknown_target"), "many": (request("many", query="two"), "target_not_unique"), "none": (request("none"), "target_required"), "several": (request("several", "two", accept=True), "proposal_not_unique"), "extra": (request("extra", query="one", decision=True), "decision_not_expected"),
    "undecided": (request("undecided", query="pred"), "decision_missing"), "lost": (request("lost", "plain", query="pred", decision=True), "decision_missing"), "image": (request("image", query="ref"), "reference_missing"), "differs": (request("differs", "x1", query="pred", decision=True), "decision_differs"),
    "outsider": (request("outsider", "x2", query="pred", decision=True), "not_participant"), "denied": (request("denied", "x3", query="pred", decision=True), "predicate_not_satisfied"), "short": (request("short", "x4", query="int", decision=True), "no_bracket"), "outside": (request("outside", "late", target="t", text="x"), "seed_outside"),
    "pts": (request("pts", "p", target="t", text="x"), "seed_pts_differ"), "ambiguous": (request("ambiguous", "m", target="t", text="x"), "not_single_match"),
}


def tables(spark):
    one = [("t", "proposed")]
    event = lambda name, key=2000, targets=one: ("a", name, 1000, 5000, key, targets)
    events = spark.createDataFrame([event("e"), event("plain", None), event("two", targets=[*one, ("u", "other")]), event("late", 5000), *[event(n) for n in ("d", "s", "i", "g", "p", "m", "x1", "x2", "x3", "x4")]], "asset_id string, event_id string, start_ms long, end_ms long, keyframe_ms long, targets array<struct<entity_id: string, target_description: string>>")
    lock = lambda q, targets=("k",), version=2, predicate=None: (q, version, f"id-{q}", predicate, [(t, f"text {t}") for t in targets])
    locks = spark.createDataFrame([lock("one"), lock("two", ("k", "l")), lock("ref"), lock("pred", predicate=("seed", ["k"], "ph")), lock("int", predicate=("interval", ["k"], "ph"))], "query_id string, version int, identity_sha256 string, predicate struct<required_at: string, participants: array<string>, sha256: string>, targets array<struct<target_id: string, description: string>>")
    references = spark.createDataFrame([("one", "k", 2, "h2", False), ("one", "k", 1, "h1", False), ("ref", "k", 1, "h", True)], "query_id string, target_id string, place int, sha256 string, missing boolean")
    decision = lambda q, e, at="seed", sha="ph", target="k", fine=True, seed=("DF3", 3000, 77), frames=None: (q, "a", e, target, f"id-{q}", sha, at, fine, seed, frames)
    frames = [(1500, 1600), (2000, 2100), (2600, 2700)]
    decisions = spark.createDataFrame(
        [decision("pred", "s"), decision("int", "i", INTERVAL, seed=None, frames=frames), decision("pred", "x1", sha="old"), decision("pred", "x2", target="l"), decision("pred", "x3", fine=False), decision("int", "x4", INTERVAL, seed=None, frames=frames[:1])],
        "query_id string, asset_id string, event_id string, target_id string, identity_sha256 string, predicate_sha256 string, required_at string, satisfied boolean, seed struct<frame_id: string, requested_ms: long, pts: long>, frames array<struct<requested_ms: long, frame_ms: long>>",
    )
    dense = spark.createDataFrame([("a", e, "t", "x", "DF9", 2500, 88) for e in ("d", "p")], "asset_id string, event_id string, target_id string, target_description string, frame_id string, requested_ms long, pts long")
    groundings = spark.createDataFrame([("a", "g", "t", 2000, 5, True), ("a", "p", "t", 2500, 89, True), ("a", "m", "t", 2000, 5, False)], "asset_id string, event_id string, target_id string, requested_ms long, pts long, single boolean")
    return spark.createDataFrame([r for r, _ in CASES.values()], REQUEST), events, locks, references, decisions, dense, groundings


INTERVAL = G.INTERVAL


def test_every_gate_and_seed(spark):
    made = G.geometry_worklist(*tables(spark))
    got = {r.request_id: r for r in made.collect()}
    assert {k: r.rule for k, r in got.items()} == {k: rule for k, (_, rule) in CASES.items()}
    seeds = {k: (r.target_id, r.seed_ms, r.seed_pts, r.seed_source, r.from_ms, r.to_ms, r.reused) for k, r in got.items() if r.rule is None}
    key, whole = "clip_card_recommended_mmss", (1000, 5000)
    assert seeds == {
        "explicit": ("t", 2000, None, key, *whole, False), "accept": ("t", 2000, None, key, *whole, False), "middle": ("t", 3000, None, "local_event_midpoint_no_model_keyframe", *whole, False), "dense": ("t", 2500, 88, "dense_frame_id:DF9:target_matched", *whole, False), "locked": ("k", 2000, None, key, *whole, False),
        "picked": ("k", 2000, None, key, *whole, False), "seeded": ("k", 3000, 77, "query_predicate_seed:DF3", *whole, False), "bracket": ("k", 2000, None, key, 1600, 3300, False), "again": ("t", 2000, None, key, *whole, True),
    }
    assert got["locked"].references == ["h1", "h2"] and got["accept"].target_description == "proposed" and got["picked"].target_description == "text k"
    assert got["bracket"].eligibility == "query_predicate_contiguous_sampled_evidence_bracket" and got["half"].seed_ms is None
    assert [tuple(r) for r in G.dropped(made).orderBy("place").limit(2).collect()] == [("decision_missing", 2, 1), ("lock_missing", 2, 2)]


def test_checkpoints_up_to_the_budget(spark):
    work = spark.createDataFrame([("r1", 2, None), ("r2", 0, None), ("r3", 8, "half_target")], "request_id string, checkpoint_budget int, rule string")
    samples = [(t, i, i * 500, 0.0 if i == 4 else 0.2, 1, 0.9, 100, 100, 200, 200, 0, i == 2) for t in ("r1", "r2", "r3") for i in range(8)]
    df = spark.createDataFrame(samples, "track_id string, sample_index long, t_ms long, area_ratio double, components int, probability double, x_min int, y_min int, x_max int, y_max int, seed_index int, shot_boundary boolean")
    stated = T.track_states(df)
    got = {r.request_id: r.checkpoints for r in G.with_checkpoints(work, stated).collect()}
    best = [r.sample_index for r in T.checkpoint_plan(stated, 2).where("track_id = 'r1' AND selected").orderBy("place").collect()]
    assert got == {"r1": best, "r2": [], "r3": []} and len(best) == 2
