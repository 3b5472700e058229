"""Ordered samples of tracks: states, checkpoints, alignment, coverage and crop paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.geometry import center_distance, iou
from reelwork.functions.times import pts_to_ms
from reelwork.operators.compare import box


def _order():
    return W.partitionBy("track_id").orderBy("sample_index")


def center(axis: str, prefix: str = "") -> Column:
    return (F.col(f"{prefix}{axis}_min") + F.col(f"{prefix}{axis}_max")) / 2


def track_states(samples: DataFrame) -> DataFrame:
    """samples with state and reasons: lost, drift_suspected, low_confidence or tracked.

    A sample is held against the median (the upper middle) of up to five positive areas
    before it, and the center before it; this history starts anew at the seed. A column
    shot_boundary, where there is one, marks samples that need a new seed.
    """
    cut = F.col("shot_boundary") if "shot_boundary" in samples.columns else F.lit(False)
    s = samples.withColumn("_part", F.col("sample_index") >= F.col("seed_index")).withColumn("_positive", F.col("area_ratio") > 0)
    history = W.partitionBy("track_id", "_part").orderBy("sample_index")
    positive = s.where("_positive")
    recent = F.array_sort(F.collect_list("area_ratio").over(history.rowsBetween(-5, -1)))
    usual = F.get(recent, (F.size(recent) / 2).cast("int"))
    moved = F.hypot(center("x") - F.lag(center("x")).over(history), center("y") - F.lag(center("y")).over(history))
    positive = positive.withColumns({"_ratio": F.col("area_ratio") / usual, "_moved": moved})
    drift = F.array_compact(F.array(F.when(cut, F.lit("shot_boundary_requires_new_seed")), F.when((F.col("_ratio") < 0.4) | (F.col("_ratio") > 2.5), F.lit("mask_area_jump")), F.when(F.col("_moved") > 220, F.lit("center_jump"))))
    weak = F.array_compact(F.array(F.when(F.col("components") > 4, F.lit("mask_fragmented")), F.when(F.col("probability") < 0.6, F.lit("weak_positive"))))
    judged = positive.withColumns({"_drift": drift, "_weak": weak})
    state = F.when(F.size("_drift") > 0, "drift_suspected").when(F.size("_weak") > 0, "low_confidence").otherwise("tracked")
    reasons = F.when(F.size("_drift") + F.size("_weak") > 0, F.concat("_drift", "_weak")).otherwise(F.array(F.lit("geometry_gates_passed")))
    judged = judged.withColumns({"state": state, "reasons": reasons})
    lost = s.where("NOT _positive").withColumns({"state": F.lit("lost"), "reasons": F.array(F.lit("mask_empty"))})
    columns = [*samples.columns, "state", "reasons"]
    return judged.select(*columns).unionByName(lost.select(*columns))


def identity_status() -> Column:
    return F.when(F.col("sample_index") == F.col("seed_index"), "seed").when(F.col("state").isin("drift_suspected", "lost"), "revalidation_required").otherwise("not_revalidated")


def usable_samples(stated: DataFrame) -> DataFrame:
    """Tracked samples with seconds from the track's first sample."""
    first = F.min("t_ms").over(W.partitionBy("track_id"))
    return stated.withColumn("seconds", (F.col("t_ms") - first) / 1000).where("state = 'tracked'")


def track_confidence(stated: DataFrame) -> DataFrame:
    low = F.count_if(F.col("state") == "low_confidence")
    return stated.groupBy("track_id").agg(F.count("*").alias("samples"), low.alias("low_confidence"), F.round(low / F.count("*"), 6).alias("ratio"), (low == 0).alias("passed"))


def state_counts(stated: DataFrame) -> DataFrame:
    return stated.groupBy("track_id", "state").agg(F.count("*").alias("n"))


def state_count_mismatches(stated: DataFrame, declared: DataFrame) -> DataFrame:
    """(track_id, state, expected, actual) where a declared count is not the counted one."""
    d = declared.select("track_id", "state", F.col("n").alias("expected"))
    both = state_counts(stated).withColumnRenamed("n", "actual").join(d, ["track_id", "state"], "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("track_id", "state", "expected", "actual")


def checkpoint_reasons(stated: DataFrame) -> DataFrame:
    """(track_id, sample_index, priority, reason) for each reason to check a sample's identity; stated has shot_boundary.

    A column checked_status, where there is one, holds what a check has said, instead of identity_status().
    """
    status = F.coalesce("checked_status", identity_status()) if "checked_status" in stated.columns else identity_status()
    all_rows = W.partitionBy("track_id")
    n = F.count("*").over(all_rows)
    place = F.row_number().over(_order()) - 1
    s = stated.withColumns({
        "_n": n, "_place": place, "_status": status, "_before": F.lag("state").over(_order()), "_area": F.lag("area_ratio").over(_order()),
        "_moved": F.hypot(center("x") - F.lag(center("x")).over(_order()), center("y") - F.lag(center("y")).over(_order())) / 1000,
    })
    later = F.col("_place") > 0
    there = (F.col("area_ratio") > 0) & (F.col("_area") > 0)
    item = lambda when, priority, reason: F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(reason).alias("reason")))
    reasons = F.array_compact(F.array(
        item(F.col("_place") == 0, 25, "track_start"), item(F.col("_place") == F.floor(F.col("_n") / 2), 20, "track_midpoint"), item(F.col("_place") == F.col("_n") - 1, 30, "track_end"),
        item(later & F.col("shot_boundary"), 100, "shot_boundary"), item(later & (F.col("_status") == "revalidation_failed"), 98, "semantic_revalidation_failed"), item(later & (F.col("_status") == "revalidation_required"), 95, "semantic_revalidation_required"),
        item(later & (F.col("state") == "drift_suspected"), 92, "drift_suspected"), item(later & (F.col("_before") == "lost") & (F.col("state") != "lost"), 90, "post_occlusion_reappearance"),
        item(later & (F.col("state") == "low_confidence"), 80, "low_confidence"), item(later & there & (F.abs(F.col("area_ratio") - F.col("_area")) / F.greatest("_area", F.lit(1e-9)) >= 0.6), 75, "geometry_area_jump"),
        item(later & there & (F.col("_moved") >= 0.18), 75, "geometry_center_jump"),
    ))
    return s.select("track_id", "sample_index", "seed_index", reasons.alias("x")).select("track_id", "sample_index", "seed_index", F.explode("x").alias("x")).select("track_id", "sample_index", "seed_index", "x.priority", "x.reason")


def merged_reasons(reasons: DataFrame) -> DataFrame:
    """Per sample the highest priority and the sorted reasons."""
    return reasons.groupBy("track_id", "sample_index", "seed_index").agg(F.max("priority").alias("priority"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def checkpoint_plan(stated: DataFrame, budget: int) -> DataFrame:
    """Samples to check, by priority, then index, without the seed; the first of them up to the budget are selected."""
    merged = merged_reasons(checkpoint_reasons(stated)).where("sample_index <> seed_index").drop("seed_index")
    place = F.row_number().over(W.partitionBy("track_id").orderBy(F.col("priority").desc(), "sample_index"))
    return merged.withColumn("place", place).withColumn("selected", F.col("place") <= budget)


def checkpoint_plan_violations(plan: DataFrame, budget: int) -> DataFrame:
    """(track_id, rule) for plans with repeated samples or more selected than the budget."""
    g = plan.groupBy("track_id").agg(F.count("*").alias("n"), F.count_distinct("sample_index").alias("d"), F.count_if("selected").alias("s"))
    rules = F.array_compact(F.array(F.when(F.col("n") > F.col("d"), F.lit("duplicate_sample")), F.when(F.col("s") > budget, F.lit("over_budget")), F.when(F.col("s") < F.least(F.lit(budget), F.col("n")), F.lit("under_budget"))))
    return g.select("track_id", F.explode(rules).alias("rule"))


def monotone_violations(samples: DataFrame) -> DataFrame:
    """(track_id, sample_index, rule): times strictly increase, and indexes run from 0 without gaps."""
    s = samples.withColumns({"_before": F.lag("t_ms").over(_order()), "_place": F.row_number().over(_order()) - 1})
    rules = F.array_compact(F.array(F.when(F.col("t_ms") <= F.col("_before"), F.lit("time_not_increasing")), F.when(F.col("sample_index") != F.col("_place"), F.lit("index_gap"))))
    return s.select("track_id", "sample_index", F.explode(rules).alias("rule"))


def accepted_prefix(samples: DataFrame, rejected: Column) -> DataFrame:
    """(track_id, accepted, total, coverage): samples reached outward from the seed before the first rejected one, each way."""
    s = samples.withColumn("_bad", rejected.cast("int"))
    ahead = F.max("_bad").over(W.partitionBy("track_id", "_side").orderBy("sample_index").rowsBetween(W.unboundedPreceding, 0))
    behind = F.max("_bad").over(W.partitionBy("track_id", "_side").orderBy(F.col("sample_index").desc()).rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("_side", F.col("sample_index") >= F.col("seed_index"))
    marked = s.withColumn("_hit", F.when(F.col("_side"), ahead).otherwise(behind))
    ok = F.count_if(F.col("_hit") == 0)
    return marked.groupBy("track_id").agg(ok.alias("accepted"), F.count("*").alias("total"), F.round(ok / F.count("*"), 6).alias("coverage"))


def direction_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(track_id, sample_index, rule): each sample must be seen by exactly the expected directions, once each."""
    seen = observed.groupBy("track_id", "sample_index").agg(F.array_sort(F.collect_set("direction")).alias("got"), F.count("*").alias("n"))
    both = expected.join(seen, ["track_id", "sample_index"], "full")
    rule = F.when(F.col("directions").isNull(), "out_of_range").when(F.col("got").isNull(), "missing").when(F.col("n") > F.size("got"), "duplicate").when(F.col("got") != F.col("directions"), "wrong_direction")
    return both.select("track_id", "sample_index", rule.alias("rule")).where("rule IS NOT NULL")


def expected_directions(samples: DataFrame) -> DataFrame:
    """Reverse before the seed, forward after it, and the prompt with forward at it (and reverse where the track goes on before)."""
    at = F.when(F.col("sample_index") < F.col("seed_index"), F.array(F.lit("reverse"))).when(F.col("sample_index") > F.col("seed_index"), F.array(F.lit("forward")))
    seed = F.when(F.col("seed_index") > 0, F.array(F.lit("forward"), F.lit("prompt"), F.lit("reverse"))).otherwise(F.array(F.lit("forward"), F.lit("prompt")))
    return samples.select("track_id", "sample_index", at.otherwise(seed).alias("directions"))


def aligned(samples: DataFrame, other: DataFrame) -> DataFrame:
    """Samples of two series side by side (left_*, right_*) by (track_id, sample_index); unmatched ones keep nulls."""
    side = lambda df, p: df.select("track_id", "sample_index", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("track_id", "sample_index")])
    return side(samples, "left").join(side(other, "right"), ["track_id", "sample_index"], "full")


def alignment_violations(pairs: DataFrame) -> DataFrame:
    """(track_id, sample_index, rule): both sides have the sample, at one time and one source time stamp."""
    rule = F.when(F.col("left_t_ms").isNull() | F.col("right_t_ms").isNull(), "unmatched").when(F.col("left_t_ms") != F.col("right_t_ms"), "time_differs").when(~F.col("left_source_pts").eqNullSafe(F.col("right_source_pts")), "pts_differs")
    return pairs.select("track_id", "sample_index", rule.alias("rule")).where("rule IS NOT NULL")


def series_violations(samples: DataFrame) -> DataFrame:
    """(track_id, sample_index, rule) of series (track_id, sample_index, t_ms, source_pts) that cannot be aligned: indices run from 0, times and time stamps rise, none is missing."""
    before = lambda c: F.lag(c).over(_order())
    place = F.row_number().over(_order()) - 1
    rules = F.array_compact(F.array(
        F.when(F.col("source_pts").isNull(), F.lit("no_pts")), F.when(F.col("sample_index") != place, F.lit("index_not_contiguous")),
        F.when(before("t_ms") >= F.col("t_ms"), F.lit("times_not_rising")), F.when(before("source_pts") >= F.col("source_pts"), F.lit("pts_not_rising")),
    ))
    return samples.withColumn("rules", rules).select("track_id", "sample_index", F.explode("rules").alias("rule"))


def with_agreement(pairs: DataFrame) -> DataFrame:
    """pairs with IoU and center distance, null unless both sides have a mask."""
    both = (F.col("left_area_ratio") > 0) & (F.col("right_area_ratio") > 0)
    return pairs.withColumns({"iou": F.when(both, iou(box("left_"), box("right_"))), "distance": F.when(both, center_distance(box("left_"), box("right_")))})


def agreement_report(pairs: DataFrame, by: str = "track_id") -> DataFrame:
    """Means and extremes over comparable samples, and the share of equal states."""
    same = (F.col("left_state") == F.col("right_state")).cast("int")
    return pairs.groupBy(by).agg(F.count("*").alias("samples"), F.count("iou").alias("comparable"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.min("iou"), 6).alias("min_iou"), F.round(F.max("iou"), 6).alias("max_iou"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.avg(same), 6).alias("state_agreement"))


def nearest(samples: DataFrame, references: DataFrame, key: str, block_ms: int = 600_000) -> DataFrame:
    """Each sample (key, t_ms) with the nearest reference (key, reference_ms, reference_id), the earlier one on a tie, then that of the least id.

    Both sides are one series, cut into blocks of block_ms, so a long series is dealt over many tasks. Within a block the
    last reference before a sample and the first one after it come from running windows, one in each direction;
    beyond its borders they are the nearest blocks' outermost references, carried over one row a block. No pairs are made.
    """
    place = "struct<at:bigint,id:bigint>"
    s = samples.withColumn("_ref", F.lit(None).cast(place))
    r = references.select(F.col(key), F.col("reference_ms").alias("t_ms"), F.struct(F.col("reference_ms").cast("long").alias("at"), F.col("reference_id").cast("long").alias("id")).alias("_ref"))
    union = s.unionByName(r, allowMissingColumns=True).withColumn("_block", F.floor(F.col("t_ms") / block_ms))
    # at one time references come first, that of the least id last
    there, least = F.col("_ref").isNull(), F.col("_ref.id").desc()
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    within = W.partitionBy(key, "_block")
    union = union.withColumns({"_prev": F.last("_ref", True).over(upto(within.orderBy("t_ms", there, least))), "_next": F.last("_ref", True).over(upto(within.orderBy(F.col("t_ms").desc(), there, least)))})
    by_time = lambda c: F.struct(c.alias("t"), -F.col("_ref.id"))
    ends = union.groupBy(key, "_block").agg(F.max_by("_ref", F.when(F.col("_ref").isNotNull(), by_time(F.col("_ref.at")))).alias("_latest"), F.max_by("_ref", F.when(F.col("_ref").isNotNull(), by_time(-F.col("_ref.at")))).alias("_first"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(key, "_block", F.last("_latest", True).over(before).alias("_before"), F.last("_first", True).over(after).alias("_after"))
    found = union.where("_ref IS NULL").join(ends, [key, "_block"]).withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    gap = lambda c: F.abs(F.col("t_ms") - F.col(f"{c}.at"))
    chosen = F.coalesce(F.when(F.col("_next").isNull() | (gap("_prev") <= gap("_next")), F.col("_prev")), F.col("_next"), F.col("_prev"))
    out = found.withColumn("_chosen", chosen).withColumns({"reference_ms": F.col("_chosen.at"), "reference_id": F.col("_chosen.id"), "gap_ms": gap("_chosen")})
    return out.drop("_ref", "_prev", "_next", "_chosen", "_block", "_before", "_after")


def common_union(regions: DataFrame, required: int) -> DataFrame:
    """(series, t_ms) at which every required region has a box, with the box around all of them."""
    return regions.groupBy("series", "t_ms").agg(F.count_distinct("region").alias("_n"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")).where(F.col("_n") == required).drop("_n")


def coverage_gate(times: DataFrame, interval_ms: float) -> DataFrame:
    """(track_id, ... passed) from rows track_id, t_ms, usable: share of unusable samples, gaps at the ends and inside.

    Unusable at most 0.20; two common samples; gaps within 1.35 and 2.25 intervals, and 35 ms.
    The ends are those of columns start_ms and end_ms, where there are such, or else the first and last sample.
    """
    used = F.when(F.col("usable"), F.col("t_ms"))
    start, end = ("start_ms", "end_ms") if "start_ms" in times.columns else ("t_ms", "t_ms")
    rows = times.where("usable").withColumn("_gap", F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("track_id").orderBy("t_ms"))).groupBy("track_id").agg(F.coalesce(F.max("_gap"), F.lit(0)).alias("internal_gap_ms"))
    g = times.groupBy("track_id").agg(F.count("*").alias("expected"), F.count(used).alias("common"), F.min(start).alias("_a"), F.max(end).alias("_b"), F.min(used).alias("_u"), F.max(used).alias("_v"))
    g = g.join(rows, "track_id", "left").select("track_id", "expected", "common", F.round(1 - F.col("common") / F.col("expected"), 6).alias("unavailable_ratio"), F.coalesce(F.col("_u") - F.col("_a"), F.col("_b") - F.col("_a")).alias("head_gap_ms"), F.coalesce(F.col("_b") - F.col("_v"), F.col("_b") - F.col("_a")).alias("tail_gap_ms"), F.coalesce("internal_gap_ms", F.lit(0)).alias("internal_gap_ms"))
    edge, inner = interval_ms * 1.35 + 35, interval_ms * 2.25 + 35
    ok = (F.col("common") >= 2) & (F.col("unavailable_ratio") <= 0.20) & (F.col("head_gap_ms") <= edge) & (F.col("tail_gap_ms") <= edge) & (F.col("internal_gap_ms") <= inner)
    return g.withColumn("passed", ok)


def dimension_check(tracks: DataFrame) -> DataFrame:
    """(series, sizes, aspect_error, passed): one source size, and an aspect error within max(0.01, 2 / the lesser side)."""
    error = F.abs(F.col("width") / F.col("height") / (F.col("source_width") / F.col("source_height")) - 1)
    g = tracks.groupBy("series").agg(F.count_distinct("source_width", "source_height").alias("sizes"), F.round(F.max(error), 9).alias("aspect_error"), F.min(F.least("width", "height")).alias("_side"))
    return g.select("series", "sizes", "aspect_error", ((F.col("sizes") == 1) & (F.col("aspect_error") <= F.greatest(F.lit(0.01), 2 / F.col("_side")))).alias("passed"))


def target_summary(samples: DataFrame) -> DataFrame:
    """Empty masks, least and greatest area, and both over the area at the seed."""
    area = F.col("area_ratio")
    seed = F.max(F.when(F.col("sample_index") == F.col("seed_index"), area))
    g = samples.groupBy("track_id").agg(F.count_if(area <= 0).alias("empty"), F.min(area).alias("min_area"), F.max(area).alias("max_area"), seed.alias("seed_area"))
    over = lambda c: F.round(F.when(F.col("seed_area") > 0, F.col(c) / F.col("seed_area")), 6)
    return g.select("track_id", "empty", F.round("min_area", 6).alias("min_area"), F.round("max_area", 6).alias("max_area"), F.round("seed_area", 6).alias("seed_area"), over("min_area").alias("min_over_seed"), over("max_area").alias("max_over_seed"))


def mask_boxes(runs: DataFrame, width: int, height: int) -> DataFrame:
    """(mask, area, ratio, x0, y0, x1, y1) in the normalized space from runs of set pixels (mask, y, x, length)."""
    g = runs.groupBy("mask").agg(F.sum("length").alias("area"), F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("length")).alias("r"), (F.max("y") + 1).alias("b"))
    scale = lambda c, n: F.bround(F.col(c) * 1000 / n, 0).cast("long")
    out = g.select("mask", "area", F.round(F.col("area") / (width * height), 9).alias("ratio"), scale("l", width).alias("x0"), scale("t", height).alias("y0"), scale("r", width).alias("x1"), scale("b", height).alias("y1"))
    return out.withColumn("x1", F.greatest("x1", F.col("x0") + 1)).withColumn("y1", F.greatest("y1", F.col("y0") + 1))


def region_fingerprint(regions: DataFrame) -> DataFrame:
    """(series, fingerprint): a hash over the regions in order and their tracks' hashes."""
    ordered = F.array_sort(F.collect_list(F.struct("region", "track_hash")))
    return regions.groupBy("series").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: F.concat_ws(":", r["region"].cast("string"), r["track_hash"])), "|"), 256).alias("fingerprint"))


def mask_iou(a: Column, b: Column) -> Column:
    """IoU of two masks in words of bits: null if both are empty, 0 if one is."""
    count = lambda words: F.aggregate(words, F.lit(0).cast("int"), lambda n, w: n + F.bit_count(w))
    both = count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    union = count(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(union > 0, both / union)


def resolve_by_fingerprint(renders: DataFrame, tracks: DataFrame) -> DataFrame:
    """(render_id, track_id, rule): the one track of a render's hash; none or several is a violation."""
    t = tracks.groupBy("track_hash").agg(F.count("*").alias("n"), F.min("track_id").alias("track_id"))
    rule = F.when(F.col("n").isNull(), "no_track").when(F.col("n") > 1, "several_tracks")
    return renders.join(t, "track_hash", "left").select("render_id", F.when(rule.isNull(), F.col("track_id")).alias("track_id"), rule.alias("rule"))


def sample_violations(samples: DataFrame) -> DataFrame:
    """(track_id, sample_index, rule) for samples outside the geometry's range; an empty mask has no box, no mask file and is lost, any other has a mask file."""
    empty = F.col("area_ratio") == 0
    say = lambda when, rule: F.when(when, F.lit(rule))
    rules = F.array_compact(F.array(
        say(empty & F.col("x_min").isNotNull(), "geometry_of_empty_mask"), say(empty & F.col("mask_sha256").isNotNull(), "file_of_empty_mask"), say(empty & (F.col("state") != "lost"), "empty_not_lost"), say(~empty & F.col("mask_sha256").isNull(), "mask_file_missing"),
        F.when(F.col("area_ratio") < 0, F.lit("negative_area")), F.when(F.col("area_ratio") > 1, F.lit("area_over_one")), F.when((F.col("probability") < 0) | (F.col("probability") > 1), F.lit("probability_range")), F.when((F.col("x_min") >= F.col("x_max")) | (F.col("y_min") >= F.col("y_max")), F.lit("empty_box"))))
    return samples.select("track_id", "sample_index", F.explode(rules).alias("rule"))


def track_violations(tracks: DataFrame, samples: DataFrame) -> DataFrame:
    """(track_id, rule) where a track's head doesn't agree with its samples or with itself.

    tracks: total_samples, lost, drift_suspected, low_confidence, tracked (declared counts), seed_index, seed_ms, seed_pts,
    seed_sha256, seed_width, seed_height, target_id, session_id, manifest_sha256, start_ms, end_ms (null: open), start_pts, tb_num,
    tb_den, and the prompt: prompt_type, prompt_box (whether there is one), polygon_points. samples: sample_index, t_ms, state,
    timing_basis, source_pts. Order within a series is series_violations().
    """
    states = ("lost", "drift_suspected", "low_confidence", "tracked")
    at_seed = F.col("sample_index") == F.col("seed_index")
    s = samples.drop("seed_index").join(tracks.select("track_id", "seed_index", "start_ms", "end_ms", "start_pts", "tb_num", "tb_den"), "track_id")
    due = pts_to_ms(F.col("source_pts"), F.col("start_pts"), F.col("tb_num"), F.col("tb_den"))
    timed = (F.col("t_ms") == due) | F.coalesce((due == F.col("end_ms")) & (F.col("t_ms") == F.col("end_ms") - 1), F.lit(False))
    decoded = F.col("timing_basis") == "decoded_source_pts"
    outside = (F.col("t_ms") < F.col("start_ms")) | (F.col("t_ms") >= F.col("end_ms"))
    g = s.groupBy("track_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in states], F.count_distinct("timing_basis").alias("bases"), F.max(F.when(at_seed, F.col("source_pts"))).alias("pts_there"),
        F.count_if(decoded & F.col("start_pts").isNotNull() & F.col("tb_num").isNotNull() & ~timed).alias("untimed"), F.count_if(F.col("end_ms").isNotNull() & outside).alias("outside"),
    )
    half = lambda *c: F.greatest(*[F.col(x).isNull().cast("int") for x in c]) != F.least(*[F.col(x).isNull().cast("int") for x in c])
    say = lambda when, rule: F.when(when, F.lit(rule))
    n = F.coalesce("n", F.lit(0))
    counted = F.lit(False)
    for x in states:
        counted = counted | (F.coalesce(x, F.lit(0)) != F.coalesce(f"n_{x}", F.lit(0)))
    declared = sum((F.coalesce(x, F.lit(0)) for x in states[1:]), F.coalesce(states[0], F.lit(0)))
    boxed = F.col("prompt_type") == "box"
    rules = F.array_compact(F.array(
        say(F.col("total_samples") != n, "total_samples"), say(declared != F.col("total_samples"), "counts_not_covering"), say(counted, "state_counts"), say(F.col("seed_index") >= F.col("total_samples"), "seed_outside"), say(F.col("bases") > 1, "several_timing_bases"),
        say(half("seed_pts", "seed_sha256", "seed_width", "seed_height"), "half_seed_lineage"), say(half("target_id", "session_id", "manifest_sha256"), "half_shared_identity"), say(F.col("start_pts").isNull() != F.col("tb_num").isNull(), "half_timing_lineage"),
        say(F.col("seed_pts").isNotNull() & ~F.col("seed_pts").eqNullSafe(F.col("pts_there")), "seed_pts"), say(F.col("untimed") > 0, "times_not_of_pts"), say(F.col("end_ms") <= F.col("start_ms"), "empty_interval"),
        say((F.col("seed_ms") < F.col("start_ms")) | (F.col("seed_ms") >= F.col("end_ms")), "seed_time_outside"), say(F.col("outside") > 0, "samples_outside"),
        say(boxed & ~F.col("prompt_box"), "box_missing"), say(boxed & F.col("polygon_points").isNotNull(), "polygon_not_expected"), say(~boxed & F.col("prompt_box"), "box_not_expected"), say(~boxed & (F.coalesce("polygon_points", F.lit(0)) < 3), "polygon_points"),
    ))
    return tracks.join(g, "track_id", "left").select("track_id", F.explode(rules).alias("rule"))


def shared_session_violations(sessions: DataFrame, frames: DataFrame, targets: DataFrame) -> DataFrame:
    """(session_id, rule) of sessions that track several targets over one series of frames.

    sessions: session_id, start_ms, end_ms, target_count, start_pts, tb_num, tb_den. frames: session_id, sample_index, t_ms, source_pts.
    targets: session_id, target_id, seed_index, seed_ms, seed_pts, counts (an array of declared counts by state).
    """
    order = W.partitionBy("session_id").orderBy("sample_index")
    f = frames.join(sessions.select("session_id", "start_ms", "end_ms", "start_pts", "tb_num", "tb_den"), "session_id")
    due = pts_to_ms(F.col("source_pts"), F.col("start_pts"), F.col("tb_num"), F.col("tb_den"))
    timed = (F.col("t_ms") == due) | ((due == F.col("end_ms")) & (F.col("t_ms") == F.col("end_ms") - 1))
    rising = lambda c: F.col(c) <= F.lag(c).over(order)
    f = f.withColumns({"_gap": F.col("sample_index") != F.row_number().over(order) - 1, "_late": rising("t_ms"), "_back": rising("source_pts"), "_untimed": ~timed, "_out": (F.col("t_ms") < F.col("start_ms")) | (F.col("t_ms") >= F.col("end_ms"))})
    g = f.groupBy("session_id").agg(F.count("*").alias("frames"), *[F.bool_or(c).alias(c) for c in ("_gap", "_late", "_back", "_untimed", "_out")])
    at = frames.select("session_id", F.col("sample_index").alias("seed_index"), F.col("t_ms").alias("_ms"), F.col("source_pts").alias("_pts"))
    t = targets.join(at, ["session_id", "seed_index"], "left").join(g.select("session_id", "frames"), "session_id", "left")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    of_targets = t.groupBy("session_id").agg(
        F.count("*").alias("targets"), F.count_distinct("target_id").alias("ids"), F.bool_or(F.col("_ms").isNull()).alias("seed_outside"), F.bool_or(F.col("_pts") != F.col("seed_pts")).alias("seed_pts"), F.bool_or(F.col("_ms") != F.col("seed_ms")).alias("seed_time"),
        F.bool_or(F.exists("counts", lambda x: x < 0)).alias("negative"), F.bool_or(total != F.col("frames")).alias("uncovered"),
    )
    say = lambda when, rule: F.when(when, F.lit(rule))
    rules = F.array_compact(F.array(
        say(F.col("start_ms") >= F.col("end_ms"), "empty_interval"), say(F.col("target_count") != F.coalesce("targets", F.lit(0)), "target_count"), say(F.coalesce("targets", F.lit(0)) < 2, "fewer_than_two_targets"), say(F.col("ids") < F.col("targets"), "duplicate_target"), say(F.col("frames").isNull(), "no_frames"),
        say(F.col("_gap"), "index_not_contiguous"), say(F.col("_late"), "times_not_rising"), say(F.col("_back"), "pts_not_rising"), say(F.col("_untimed"), "times_not_of_pts"), say(F.col("_out"), "frames_outside"),
        say(F.col("seed_outside"), "seed_outside"), say(F.col("seed_pts"), "seed_pts"), say(F.col("seed_time"), "seed_time"), say(F.col("negative"), "negative_count"), say(F.col("uncovered"), "counts_not_covering"),
    ))
    return sessions.join(g, "session_id", "left").join(of_targets, "session_id", "left").select("session_id", F.explode(rules).alias("rule"))


def session_violations(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """(track_id, rule) where a manifest (track_id, samples, seed_index) doesn't agree with the samples."""
    got = samples.groupBy("track_id").agg(F.count("*").alias("n"), F.min("seed_index").alias("a"), F.max("seed_index").alias("b"))
    both = manifest.join(got, "track_id", "left")
    rules = F.array_compact(F.array(F.when(~F.col("samples").eqNullSafe(F.col("n")), F.lit("sample_count")), F.when(F.col("a") != F.col("b"), F.lit("several_seeds")), F.when(F.col("declared_seed") != F.col("a"), F.lit("seed_frame"))))
    return both.select("track_id", F.explode(rules).alias("rule"))
