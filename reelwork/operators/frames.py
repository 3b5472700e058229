"""Frame catalogs: joins by exact time stamps, catalog runs, trims and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.times import pts_to_ms


def _order():
    return W.partitionBy("event_id").orderBy("pos")


def with_ms(frames: DataFrame) -> DataFrame:
    return frames.withColumn("ms", pts_to_ms(F.col("frame_pts"), 0, F.col("tb_num").cast("long"), F.col("tb_den").cast("long")))


def intervals(frames: DataFrame, duration_ms: int) -> DataFrame:
    """Each frame's half-open interval: to the next frame of its event, or to the end."""
    return with_ms(frames).select("event_id", "pos", F.col("ms").alias("start_ms"), F.lead("ms", 1, duration_ms).over(_order()).alias("end_ms"))


def last_included(frames: DataFrame) -> DataFrame:
    """(event_id, pos, last_pts): the frame before each exclusive out frame."""
    return frames.select("event_id", "pos", F.lag("frame_pts").over(_order()).alias("last_pts"))


def frame_to_clip(frames: DataFrame, clips: DataFrame) -> DataFrame:
    return frames.join(clips, "event_id")


def by_exact_pts(seeds: DataFrame, frames: DataFrame) -> DataFrame:
    """(event_id, seed_pts, rule) for seeds (event_id, seed_pts, seed_time_ms): the frame (event_id, frame_pts, ms) of the exact time stamp; none, several, or another time is a violation."""
    n = frames.groupBy("event_id", F.col("frame_pts").alias("seed_pts")).agg(F.count("*").alias("n"), F.min("ms").alias("ms"))
    rule = F.when(F.col("n").isNull(), "no_such_frame").when(F.col("n") > 1, "duplicate_pts").when(F.col("ms") != F.col("seed_time_ms"), "time_differs")
    return seeds.join(n, ["event_id", "seed_pts"], "left").select("event_id", "seed_pts", rule.alias("rule"))


def contiguous_runs(selected: DataFrame) -> DataFrame:
    """(event_id, n, contiguous): whether the selected positions (event_id, place, pos) are one unbroken run of the catalog in order."""
    w = W.partitionBy("event_id").orderBy("place")
    s = selected.withColumn("_ordered", F.coalesce(F.col("pos") > F.lag("pos").over(w), F.lit(True)))
    return s.groupBy("event_id").agg(F.count("*").alias("n"), ((F.max("pos") - F.min("pos") + 1 == F.count("*")) & F.min("_ordered")).alias("contiguous"))


def predicate_seed(kind: Column, positions: Column) -> Column:
    """The position of the seed frame: none for a candidate, the first for a seed, the second for a transition's apex, the middle of an interval."""
    return F.when(kind == "seed", F.get(positions, F.lit(0))).when(kind == "transition", F.get(positions, F.lit(1))).when(kind == "interval", F.get(positions, (F.size(positions) / 2).cast("int")))


def evidence_bracket(events: DataFrame, samples: DataFrame) -> DataFrame:
    """(event_id, from_ms, to_ms): the event cut to its first sample and the last one and a step."""
    g = samples.groupBy("event_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"), F.count("*").alias("n"))
    step = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1)).otherwise(0)
    return events.join(g, "event_id").select("event_id", F.greatest("start_ms", "a").alias("from_ms"), F.least("end_ms", F.col("b") + F.floor(step)).alias("to_ms"))


def normalize_hold(trims: DataFrame) -> DataFrame:
    """Half a hold interval is dropped and noted; of more than 8 notes the last takes it up."""
    half = F.col("hold_start").isNull() != F.col("hold_end").isNull()
    note = F.lit("hold_incomplete")
    notes = F.when(half & (F.size("notes") < 8), F.array_append("notes", note)).when(half, F.concat(F.slice("notes", 1, 7), F.array(F.concat_ws("; ", F.get("notes", F.lit(7)), note)))).otherwise(F.col("notes"))
    return trims.withColumns({"notes": notes, "hold_start": F.when(~half, F.col("hold_start")), "hold_end": F.when(~half, F.col("hold_end"))})


def accepted_trims(trims: DataFrame, allow_proposed: bool) -> DataFrame:
    """(event_id, accepted): approved and reviewed trims, and proposed ones where they are allowed."""
    ok = (F.col("status") == "approved") & F.col("reviewed")
    return trims.select("event_id", (ok | (F.col("status") == "proposed") if allow_proposed else ok).alias("accepted"))


def apply_reviews(trims: DataFrame, reviews: DataFrame) -> DataFrame:
    """(event_id, status, rule): a proposal that can't be used can't be approved."""
    j = trims.join(reviews, "event_id", "left")
    bad = (F.col("verdict") == "approve") & ~F.col("usable")
    status = F.when(F.col("verdict").isNull() | bad, F.col("status")).when(F.col("verdict") == "approve", "approved").otherwise("rejected")
    return j.select("event_id", status.alias("status"), F.when(bad, "unusable_approved").alias("rule"))


def trim_for_segment(segments: DataFrame, trims: DataFrame) -> DataFrame:
    """(segment_id, outcome, in_ms, out_ms): the approved trim of a segment's asset and shot, and of its event if it names one.

    segments: segment_id, asset_id, shot_id, shot_start, shot_end, event_id (null: any); trims:
    asset_id, shot_id, event_id, in_ms, out_ms; one without both ends is none. No trim is a
    fallback, several are ambiguous, and one that leaves the shot crosses it; only one inside applies.
    """
    t = trims.where("in_ms IS NOT NULL AND out_ms IS NOT NULL").withColumnRenamed("event_id", "_event")
    found = segments.join(t, ["asset_id", "shot_id"]).where(F.col("event_id").isNull() | (F.col("event_id") == F.col("_event")))
    g = found.groupBy("segment_id").agg(F.count("*").alias("n"), F.min(F.struct("in_ms", "out_ms")).alias("x"))
    inside = (F.col("shot_start") <= F.col("x.in_ms")) & (F.col("x.in_ms") < F.col("x.out_ms")) & (F.col("x.out_ms") <= F.col("shot_end"))
    outcome = F.when(F.col("n").isNull(), "fallback").when(F.col("n") > 1, "ambiguous").when(inside, "apply").otherwise("crosses_shot")
    out = segments.join(g, "segment_id", "left").withColumn("outcome", outcome)
    return out.select("segment_id", "outcome", *[F.when(F.col("outcome") == "apply", F.col(f"x.{c}")).alias(c) for c in ("in_ms", "out_ms")])


def trim_decision(frames: DataFrame, shot_end: Column, before_ms: int = 750, after_ms: int = 1000) -> DataFrame:
    """(event_id, in_ms, out_ms, handle_start, handle_end) from each event's second and last frames, with handles inside the shot."""
    f = with_ms(frames)
    g = f.groupBy("event_id").agg(F.min(F.when(F.col("pos") == 2, F.col("ms"))).alias("in_ms"), F.max("ms").alias("out_ms"), F.max(shot_end).alias("_end")).where("in_ms IS NOT NULL AND in_ms < out_ms")
    return g.select("event_id", "in_ms", "out_ms", F.greatest(F.lit(0), F.col("in_ms") - before_ms).alias("handle_start"), F.least("_end", F.col("out_ms") + after_ms).alias("handle_end"))


def trim_bounds(trims: DataFrame) -> DataFrame:
    """(event_id, rule): coarse in and out are in order inside the allowed interval, and the ends of a hold and a reset (null: none) within them."""
    within = lambda c: (F.col(c) < F.col("in_ms")) | (F.col(c) > F.col("out_ms"))
    say = lambda when, rule: F.when(when, F.lit(rule))
    rules = F.array_compact(F.array(
        say(F.col("in_ms") < F.col("allowed_start"), "in_outside"), say(F.col("out_ms") > F.col("allowed_end"), "out_outside"), say(F.col("in_ms") >= F.col("out_ms"), "in_not_before_out"),
        say(within("hold_start_ms"), "hold_start_outside"), say(within("hold_end_ms"), "hold_end_outside"), say(within("reset_ms"), "reset_outside"),
    ))
    return trims.select("event_id", F.explode(rules).alias("rule"))


def trim_boundaries(trims: DataFrame, frames: DataFrame) -> DataFrame:
    """(event_id, in_ms, in_pts, out_ms, out_pts, out_kind, rule): the first frames at or after the requested in and out.

    trims: event_id, in_ms, out_ms, and of the source duration_ms, start_pts, tb_num, tb_den. frames: event_id, ms, frame_pts. With no
    frame left for an out within 100 ms of the source's end, out is the request and the next whole time stamp at or after it.
    """
    f = frames.select("event_id", F.struct("ms", F.col("frame_pts").alias("pts")).alias("_f"))
    at = lambda c: F.min(F.when(F.col("_f.ms") >= F.col(c), F.col("_f")))
    g = f.join(trims.select("event_id", "in_ms", "out_ms"), "event_id").groupBy("event_id").agg(at("in_ms").alias("_in"), at("out_ms").alias("_out"))
    t = trims.join(g, "event_id", "left")
    unit = 1000 * F.col("tb_num").cast("long")
    ticks = F.col("out_ms").cast("long") * F.col("tb_den")
    end_pts = F.coalesce("start_pts", F.lit(0)) + ((ticks - F.pmod(ticks, unit)) / unit).cast("long") + (F.pmod(ticks, unit) > 0).cast("long")
    found, near = F.col("_out").isNotNull(), F.col("duration_ms") - F.col("out_ms") <= 100
    rule = F.when(F.col("_in").isNull(), "in_missing").when(~found & ~near, "out_missing").when(found & (F.col("_out.ms") <= F.col("_in.ms")), "not_chronological")
    kind = F.when(found, "first_decoded_frame_at_or_after_request").otherwise("end_of_stream_time_boundary")
    fine = lambda c, name: F.when(F.col("rule").isNull(), c).alias(name)
    return t.withColumn("rule", rule).select(
        "event_id", fine(F.col("_in.ms"), "in_ms"), fine(F.col("_in.pts"), "in_pts"), fine(F.when(found, F.col("_out.ms")).otherwise(F.col("out_ms")), "out_ms"), fine(F.when(found, F.col("_out.pts")).otherwise(end_pts), "out_pts"), fine(kind, "out_kind"), "rule"
    )


def dense_catalog_violations(frames: DataFrame, window_start: int, window_end: int, most: int = 3600) -> DataFrame:
    """(event_id, pos, rule): ids unique and in order, times rising and inside the window, at most so many frames, hashes of 64 hex digits."""
    every = W.partitionBy("event_id")
    again = F.count("*").over(W.partitionBy("event_id", "frame_id")) > 1
    rules = F.array_compact(F.array(
        F.when(again, F.lit("duplicate_id")), F.when(F.col("frame_id") < F.lag("frame_id").over(_order()), F.lit("ids_not_ordered")), F.when((F.count("*").over(every) > most) & (F.row_number().over(_order()) == 1), F.lit("over_limit")),
        F.when(F.col("ms") < window_start, F.lit("outside_window")), F.when(F.col("frame_pts") <= F.lag("frame_pts").over(_order()), F.lit("not_ordered")), F.when(F.col("ms") >= window_end, F.lit("outside_window")), F.when(~F.col("frame_hash").rlike("^[0-9a-f]{64}$"), F.lit("hash"))))
    return with_ms(frames).select("event_id", "pos", rules.alias("rules")).select("event_id", "pos", F.explode("rules").alias("rule"))


def _say(when: Column, rule: str) -> Column:
    return F.when(when, F.lit(rule))


def _broken(rows: DataFrame, *rules: Column) -> DataFrame:
    """(event_id, rule) for each rule that a row breaks."""
    return rows.select("event_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def selection_violations(selections: DataFrame) -> DataFrame:
    """(event_id, rule) of selections of dense frames (first, recommended, last, target_id, target_description, status).

    A visible one has all three ids in order and is matched or ambiguous, by default matched; an invisible one has neither ids
    nor a target and says why. A target's id and description come together.
    """
    ids, target = [F.col(c) for c in ("first", "recommended", "last")], [F.col(c) for c in ("target_id", "target_description")]
    visible = F.col("visible")
    status = F.coalesce("status", F.when(visible, "matched").otherwise("not_visible"))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return _broken(
        selections, _say(visible & _any(*[c.isNull() for c in ids]), "ids_missing"), _say(visible & ~status.isin("matched", "ambiguous"), "status_of_visible"), _say(visible & ~_any(*[c.isNull() for c in ids]) & ((ids[0] > ids[1]) | (ids[1] > ids[2])), "order"),
        _say(~visible & _any(*[c.isNotNull() for c in ids + target]), "fields_not_expected"), _say(~visible & ~status.isin("not_visible", "target_mismatch", "insufficient_evidence"), "status_of_invisible"), _say(given(target[0]) != given(target[1]), "half_target"),
    )


def phase_violations(proposals: DataFrame) -> DataFrame:
    """(event_id, rule) of trims proposed by frames (usable, requires_review, selections as an array of phase and frame_id).

    A proposal waits for a review. Phases occur once; a usable one has two different frames as in and out, another has no
    frames; a hold has both ends or none.
    """
    phases = F.transform("selections", lambda x: x["phase"])
    frame = lambda name: F.get(F.filter("selections", lambda x: x["phase"] == name), F.lit(0))["frame_id"]
    has = lambda name: F.array_contains(phases, name)
    usable, first, last = F.col("usable"), frame("recommended_in"), frame("recommended_out")
    return _broken(
        proposals, _say(~F.col("requires_review"), "review_not_required"), _say(F.size(F.array_distinct(phases)) < F.size(phases), "repeated_phase"), _say(usable & (first.isNull() | last.isNull()), "in_out_missing"),
        _say(usable & (first == last), "single_frame"), _say(~usable & (F.size("selections") > 0), "frames_of_unusable"), _say(has("hold_start") != has("hold_end"), "half_hold"),
    )


def video_trim_violations(proposals: DataFrame) -> DataFrame:
    """(event_id, rule) of trims proposed by times (usable, requires_review, in_ms, out_ms, hold_start_ms, hold_end_ms, reset_ms); half a hold is for normalize_hold()."""
    usable, at = F.col("usable"), [F.col(c) for c in ("in_ms", "out_ms", "hold_start_ms", "hold_end_ms", "reset_ms")]
    return _broken(
        proposals, _say(~F.col("requires_review"), "review_not_required"), _say(usable & (at[0].isNull() | at[1].isNull()), "in_out_missing"), _say(usable & (at[1] <= at[0]), "not_chronological"), _say(~usable & _any(*[c.isNotNull() for c in at]), "times_of_unusable"),
        _say(at[2].isNull() != at[3].isNull(), "half_hold"), _say(at[3] < at[2], "hold_not_chronological"),
    )


def trim_decision_violations(decisions: DataFrame) -> DataFrame:
    """(event_id, rule) of derived trims: usable, first_frame, in_ms, out_ms, in_pts, out_pts, handle_in_ms, handle_out_ms, status, requires_review and the review's verdict (null: none)."""
    derived = [F.col(c) for c in ("first_frame", "in_ms", "out_ms", "in_pts", "out_pts")]
    usable, some, whole = F.col("usable"), _any(*[c.isNotNull() for c in derived]), ~_any(*[c.isNull() for c in derived])
    handles = F.col("handle_in_ms").isNotNull() & F.col("handle_out_ms").isNotNull()
    bounds = usable & whole
    proposed, verdict = F.col("status") == "proposed", F.col("verdict")
    return _broken(
        decisions, _say(usable & ~whole, "bounds_missing"), _say(bounds & (F.col("out_ms") <= F.col("in_ms")), "empty_interval"), _say(bounds & ~handles, "handles_missing"),
        _say(bounds & handles & ((F.col("handle_in_ms") > F.col("in_ms")) | (F.col("out_ms") > F.col("handle_out_ms"))), "outside_handles"), _say(~usable & some, "bounds_of_unusable"),
        _say(proposed & (~F.col("requires_review") | verdict.isNotNull()), "proposed_but_reviewed"), _say(~proposed & (F.col("requires_review") | verdict.isNull()), "reviewed_without_record"), _say(~proposed & (verdict != F.col("status")), "verdict_differs"),
    )


# the claim that a positive selection of each stage may make
COVERAGE_CLAIMS = {"candidate": "single_frame_only", "seed": "single_frame_only", "transition": "transition_samples_only", "interval": "sampled_frames_only"}


def predicate_violations(selections: DataFrame) -> DataFrame:
    """(event_id, rule) of temporal selections: the shape of their stage, and evidence for what they select.

    selections: event_id, required_at, match_status, predicate_status, coverage_claim, candidate_id, seed_id, pre_id, apex_id, post_id,
    interval_ids, evidence (frame_id, statuses as (target_id, status), observed, phase), the lock's participants, and catalog_ids in order.
    """
    one = {"candidate": "candidate_id", "seed": "seed_id"}
    ids = ["candidate_id", "seed_id", "pre_id", "apex_id", "post_id"]
    empty = F.array().cast("array<string>")
    at, interval = F.col("required_at"), F.coalesce("interval_ids", empty)
    chosen = F.array_compact(F.array(*[F.col(c) for c in ids]))
    transition = F.array_compact(F.array("pre_id", "apex_id", "post_id"))
    positive = (F.col("match_status") == "matched") & (F.col("predicate_status") == "satisfied")
    shape = F.when(at == "interval", (F.size(chosen) == 0) & (F.size(interval) >= 2)).when(at == "transition", (F.size(chosen) == 3) & (F.size(F.array_distinct(transition)) == 3) & (F.size(interval) == 0))
    for stage, c in one.items():
        shape = shape.when(at == stage, F.col(c).isNotNull() & (F.size(chosen) == 1) & (F.size(interval) == 0))
    claim = F.element_at(F.create_map(*[F.lit(x) for pair in COVERAGE_CLAIMS.items() for x in pair]), at)
    selected = F.when(at == "interval", interval).otherwise(chosen)
    seen = F.transform("evidence", lambda e: e["frame_id"])
    of_selected = F.filter("evidence", lambda e: F.array_contains(selected, e["frame_id"]))
    phase = lambda c, name: F.exists("evidence", lambda e: (e["frame_id"] == F.col(c)) & ~e["phase"].eqNullSafe(F.lit(name)))
    places = F.transform(transition, lambda x: F.array_position("catalog_ids", x))
    run = F.slice("catalog_ids", F.greatest(F.array_position("catalog_ids", F.get(interval, F.lit(0))), F.lit(1).cast("long")).cast("int"), F.size(interval))
    named = F.array_distinct(F.concat(chosen, interval, seen))
    well = positive & shape
    say = lambda when, rule: F.when(when, F.lit(rule))
    rules = F.array_compact(F.array(
        say(F.col("predicate_status") == "not_applicable", "not_applicable"), say(~positive & ((F.size(chosen) > 0) | (F.size(interval) > 0)), "frames_without_claim"), say(~positive & (F.col("coverage_claim") != "no_positive_claim"), "claim_without_frames"),
        say(positive & ~shape, "stage_shape"), say(positive & (F.col("coverage_claim") != claim), "coverage_claim"), say(positive & (F.size(F.array_distinct(interval)) < F.size(interval)), "repeated_interval_frame"),
        say(F.size(F.array_distinct(seen)) < F.size(seen), "repeated_evidence"), say(F.exists("evidence", lambda e: F.size(e["statuses"]) == 0), "no_participant_status"), say(well & (F.size(F.array_except(selected, seen)) > 0), "frame_without_evidence"),
        say(well & F.exists(of_selected, lambda e: F.exists(e["statuses"], lambda x: x["status"] != "observed")), "participant_not_observed"), say(well & F.exists(of_selected, lambda e: ~F.coalesce(e["observed"], F.lit(False))), "predicate_not_observed"),
        say(well & (at == "transition") & (phase("pre_id", "precondition") | phase("apex_id", "apex") | phase("post_id", "postcondition")), "wrong_phase"), say(well & (at == "transition") & ~((F.get(places, F.lit(0)) < F.get(places, F.lit(1))) & (F.get(places, F.lit(1)) < F.get(places, F.lit(2)))), "transition_order"),
        say(F.size(F.array_except(named, F.col("catalog_ids"))) > 0, "unknown_frame"), say(F.exists("evidence", lambda e: F.array_sort(F.transform(e["statuses"], lambda x: x["target_id"])) != F.array_sort("participants")), "participants_differ"),
        say(well & (at == "interval") & (interval != run), "interval_not_contiguous"),
    ))
    return selections.select("event_id", F.explode(rules).alias("rule"))


def matching_dense_seed(selections: DataFrame, frames: DataFrame) -> DataFrame:
    """(event_id, pos, frame_pts) of the recommended frame, if it is visible and matched."""
    return selections.where("visible AND status = 'matched'").join(frames.select("event_id", "pos", "frame_pts"), ["event_id", "pos"]).select("event_id", "pos", "frame_pts")
