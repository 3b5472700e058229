"""Crop paths along both axes: legal origins, smoothing, visibility and motion, and whether a tracked crop may be used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.operators.compare import box
from reelwork.operators.rounds import cut_lineage
from reelwork.operators.tracks import center, coverage_gate


def _order():
    return W.partitionBy("track_id").orderBy("sample_index")


def _column(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _given(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def cover_transform(source_width: Column, source_height: Column, width: int, height: int, zoom: Column | float = 1.0) -> dict[str, Column]:
    """The scaled size that covers the output at the source's aspect, even numbers, and the axes that can pan."""
    even = lambda v: F.greatest(F.lit(2), F.ceil(v / 2) * 2).cast("long")
    zoom = _column(zoom)
    aspect = source_width / source_height
    wide = aspect >= width / height
    tall_h, flat_w = even(height * zoom), even(width * zoom)
    w = F.when(wide, even(tall_h * aspect)).otherwise(flat_w)
    h = F.when(wide, tall_h).otherwise(even(flat_w / aspect))
    return {"scaled_width": w, "scaled_height": h, "pan_x": w > width, "pan_y": h > height}


def axis_constraints(low: Column, high: Column, view: Column, priority: Column | str = "balanced", overflow: Column | str = "preserve_all") -> dict[str, Column]:
    """Legal crop origins of an axis (low and high end of the padded box, width of the view); one aligned origin if the box doesn't fit.

    controlled: the box doesn't fit and the policy allows to clip it.
    """
    priority, overflow = _column(priority), _column(overflow)
    most = F.greatest(F.lit(0.0), 1000.0 - view)
    lower, upper = F.greatest(F.lit(0.0), high - view), F.least(most, low)
    fits = lower <= upper + 1e-6
    at = lambda v: _clamp(v, F.lit(0.0), most)
    aligned = F.when(priority == "preserve_start", at(low)).when(priority == "preserve_end", at(high - view)).otherwise(at((low + high) / 2 - view / 2))
    return {
        "lower": F.when(fits, lower).otherwise(aligned),
        "upper": F.when(fits, upper).otherwise(aligned),
        "feasible": fits,
        "controlled": ~fits & (overflow == "controlled_clip"),
    }


def crop_visibility(b: list[Column], left: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    """Whether the crop holds the box, and the visible fractions of its width, height and area."""
    w = F.greatest(F.lit(0.0), F.least(b[2], left + width) - F.greatest(b[0], left)) / (b[2] - b[0])
    h = F.greatest(F.lit(0.0), F.least(b[3], top + height) - F.greatest(b[1], top)) / (b[3] - b[1])
    held = (b[0] >= left - 1e-6) & (b[2] <= left + width + 1e-6) & (b[1] >= top - 1e-6) & (b[3] <= top + height + 1e-6)
    return {"contained": held, "visible_width": w, "visible_height": h, "visible_area": w * h}


def boundary_contact(b: list[Column], margin: int = 5) -> Column:
    return (b[0] <= margin) | (b[1] <= margin) | (b[2] >= 1000 - margin) | (b[3] >= 1000 - margin)


def target_fits(box_width: Column, view: Column, primary: Column) -> Column:
    """Whether a target of the width fits the view: a primary one as it is, another with a margin of 8 percent."""
    return F.when(primary, box_width <= view).otherwise(box_width * 1.08 <= view)


def safe_zoom(boxes: DataFrame, scaled_width: int, scaled_height: int, requested: float) -> DataFrame:
    """(track_id, zoom): the requested zoom limited by the largest box with a margin of 1.45, and by 2; under 1.035 it is none (1)."""
    g = boxes.groupBy("track_id").agg(F.max(F.col("x_max") - F.col("x_min")).alias("w"), F.max(F.col("y_max") - F.col("y_min")).alias("h"))
    applied = _clamp(_most_zoom("w", "h", F.lit(scaled_width), F.lit(scaled_height)), F.lit(1.0), F.lit(requested))
    return g.select("track_id", F.round(F.when(applied < 1.035, 1.0).otherwise(applied), 6).alias("zoom"))


def _most_zoom(w: str, h: str, scaled_width: Column, scaled_height: Column) -> Column:
    return F.least(F.lit(2.0), 1920 / (F.col(w) / 1000 * scaled_width * 1.45), 1080 / (F.col(h) / 1000 * scaled_height * 1.45))


#: Samples of a block in smoothing; few enough that the powers of a weight stay within a double's range.
SMOOTH_BLOCK = 64


def _ema_pass(series: DataFrame, names: dict[str, str], alpha: float, backward: bool) -> DataFrame:
    """series with y = alpha * x + (1 - alpha) * y of the sample before, or with backward the one after, for each of names (x to y).

    From a block's state s at its border, its i-th value is q**i * (s + the sum of alpha * x_j / q**j), q being 1 - alpha. A
    block so maps the state before it to that behind it, and the states at the borders follow from one row a block.
    """
    q = 1 - alpha
    reach = math.ceil(60 * math.log(2) / -math.log(q))  # beyond so many values a weight is under 2**-60
    order = F.col("sample_index").desc() if backward else F.col("sample_index")
    block = F.col("_block").desc() if backward else F.col("_block")
    running = W.partitionBy("track_id", "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = series.withColumn("_block", F.floor(F.col("sample_index") / SMOOTH_BLOCK))
    rows = rows.withColumns({f"_n_{y}": F.count(x).over(running) for x, y in names.items()})
    rows = rows.withColumns({f"_t_{y}": alpha * F.col(x).cast("double") / F.pow(F.lit(q), f"_n_{y}") for x, y in names.items()})
    rows = rows.withColumns({f"_s_{y}": F.coalesce(F.sum(f"_t_{y}").over(running), F.lit(0.0)) for y in names.values()})
    rows = cut_lineage(rows)  # read for the blocks and for the values
    maps = []
    for x, y in names.items():
        n, first = F.max(f"_n_{y}"), F.min_by(F.col(x).cast("double"), F.when(F.col(x).isNotNull(), F.col(f"_n_{y}")))
        maps.append(F.struct(F.pow(F.lit(q), n).alias("slope"), (F.pow(F.lit(q), n) * F.coalesce(F.sum(f"_t_{y}"), F.lit(0.0))).alias("offset"), first.alias("first")).alias(y))
    blocks = rows.groupBy("track_id", "_block").agg(*maps)
    behind = W.partitionBy("track_id").orderBy(block).rowsBetween(-reach, -1)
    # the first value of a series is its own state
    state = lambda y: F.aggregate(F.filter(F.collect_list(y).over(behind), lambda b: b["first"].isNotNull()), F.lit(None).cast("double"), lambda s, b: b["offset"] + b["slope"] * F.coalesce(s, b["first"]))
    states = blocks.select("track_id", "_block", *[F.coalesce(state(y), f"{y}.first").alias(f"_in_{y}") for y in names.values()], *[state(y).isNotNull().alias(f"_has_{y}") for y in names.values()])
    held = rows.join(states, ["track_id", "_block"])
    made = {y: F.when(F.col(f"_has_{y}") | (F.col(f"_n_{y}") > 0), F.pow(F.lit(q), f"_n_{y}") * (F.col(f"_s_{y}") + F.col(f"_in_{y}"))) for y in names.values()}
    return held.withColumns(made).drop("_block", *[f"_{k}_{y}" for y in names.values() for k in ("n", "t", "s", "in", "has")])


def ema_smooth(series: DataFrame, names: dict[str, str], alpha: float = 0.34) -> DataFrame:
    """series with smoothed columns (names: value to smoothed): exponential smoothing forward, then backward.

    A track is worked on in blocks of samples that any task may hold, so it need not fit in one. A null takes the
    mean of the rows before it. Equal to the sequential recurrence within rounding.
    """
    forward = _ema_pass(series, {x: f"_f_{y}" for x, y in names.items()}, alpha, False)
    return _ema_pass(forward, {f"_f_{y}": y for y in names.values()}, alpha, True).drop(*[f"_f_{y}" for y in names.values()])


def projected_smooth(series: DataFrame, *axes: tuple[str, str, str, str], rounds: int = 12) -> DataFrame:
    """series with a smoothed column for each of axes (desired, lower, upper, smoothed).

    Each round moves a value to 0.58 of its target and 0.42 of its neighbours' mean, inside its limits. A round
    reads only the one before it, so all rounds of all axes share one window: one shuffle and one sort.
    """
    out = series.withColumns({s: _clamp(F.col(d), F.col(low), F.col(high)) for d, low, high, s in axes})
    for _ in range(rounds):
        near = {}
        for _, _, _, s in axes:
            near |= {f"_{s}_a": F.lag(s).over(_order()), f"_{s}_b": F.lead(s).over(_order())}
        out = out.withColumns(near)
        moved = {}
        for d, low, high, s in axes:
            a, b = F.col(f"_{s}_a"), F.col(f"_{s}_b")
            mean = F.coalesce((a + b) / 2, a, b, F.col(d))
            moved[s] = _clamp(0.58 * F.col(d) + 0.42 * mean, F.col(low), F.col(high))
        out = out.withColumns(moved).drop(*near)
    return out


def with_motion(path: DataFrame, x: str, y: str, seconds: str) -> DataFrame:
    """path with the speeds along x and y, speed, acceleration and jerk since the sample before, in steps of 1 ms at least."""
    lag = lambda c: F.lag(c).over(_order())
    p = path.withColumn("_dt", F.greatest(F.lit(0.001), F.col(seconds) - lag(seconds)))
    p = p.withColumns({"speed_x": F.abs(F.col(x) - lag(x)) / F.col("_dt"), "speed_y": F.abs(F.col(y) - lag(y)) / F.col("_dt")})
    p = p.withColumn("speed", F.hypot("speed_x", "speed_y"))
    p = p.withColumn("acceleration", F.abs(F.col("speed") - lag("speed")) / F.col("_dt"))
    return p.withColumn("jerk", F.abs(F.col("acceleration") - lag("acceleration")) / F.col("_dt")).drop("_dt")


def _most(column: str, digits: int) -> Column:
    return F.round(F.coalesce(F.max(column), F.lit(0.0)), digits).alias(f"max_{column}")


def crop_kinematics(path: DataFrame, x: str, y: str, seconds: str) -> DataFrame:
    """(track_id, max_speed, max_acceleration, max_jerk) of a path, with steps of 1 ms at least."""
    return with_motion(path, x, y, seconds).groupBy("track_id").agg(*[_most(c, 6) for c in ("speed", "acceleration", "jerk")])


def crop_path(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """boxes with the origin of an output of width by height at each sample, in thousandths of the source and in pixels.

    boxes: track_id, sample_index, seconds, the box of what must be seen, source_width and source_height of the track.
    Columns zoom, safety (margin as a factor of the box), overflow_policy, edge_priority, want_x and want_y (center
    to aim at) count where there are such. The aim is smoothed, kept inside the source, then smoothed again inside
    the legal origins; if one sample of a track doesn't fit and may not be clipped, each takes the legal origin next to its aim.
    """
    size = cover_transform(F.col("source_width"), F.col("source_height"), width, height, _given(boxes, "zoom", 1.0))
    p = boxes.withColumns({
        "scaled_width": size["scaled_width"], "scaled_height": size["scaled_height"], "overflow_policy": _given(boxes, "overflow_policy", "preserve_all"), "edge_priority": _given(boxes, "edge_priority", "balanced"),
        "safety": _given(boxes, "safety", 1.0), **{f"want_{a}": F.coalesce(_given(boxes, f"want_{a}", None).cast("double"), center(a)) for a in "xy"},
    })
    p = p.withColumns({"view_x": width * 1000 / F.col("scaled_width"), "view_y": height * 1000 / F.col("scaled_height")})
    p = ema_smooth(p, {"want_x": "smooth_x", "want_y": "smooth_y"})
    p = p.withColumns({f"margin_{a}": (F.col(f"{a}_max") - F.col(f"{a}_min")) * (F.col("safety") - 1) / 2 for a in "xy"})
    p = p.withColumns({f"low_{a}": F.greatest(F.lit(0.0), F.col(f"{a}_min") - F.col(f"margin_{a}")) for a in "xy"} | {f"high_{a}": F.least(F.lit(1000.0), F.col(f"{a}_max") + F.col(f"margin_{a}")) for a in "xy"})
    for a in "xy":
        view = F.col(f"view_{a}")
        limits = axis_constraints(F.col(f"low_{a}"), F.col(f"high_{a}"), view, F.col("edge_priority"), F.col("overflow_policy"))
        p = p.withColumns({f"{k}_{a}": c for k, c in limits.items()} | {f"desired_{a}": _clamp(F.col(f"smooth_{a}") - view / 2, F.lit(0.0), 1000 - view)})
    p = p.withColumns({"feasible": F.col("feasible_x") & F.col("feasible_y"), "controlled": F.col("controlled_x") | F.col("controlled_y")})
    p = p.withColumn("_smooth", (F.col("overflow_policy") == "controlled_clip") | F.bool_and("feasible").over(W.partitionBy("track_id")))
    p = projected_smooth(p, *[(f"desired_{a}", f"lower_{a}", f"upper_{a}", f"_at_{a}") for a in "xy"])
    at = lambda a: F.when(F.col("_smooth"), F.col(f"_at_{a}")).otherwise(_clamp(F.col(f"desired_{a}"), F.col(f"lower_{a}"), F.col(f"upper_{a}")))
    p = p.withColumns({"left": at("x"), "top": at("y")})
    crop = [F.col("left"), F.col("top"), F.col("view_x"), F.col("view_y")]
    seen, padded = crop_visibility(box(), *crop), crop_visibility([F.col(c) for c in ("low_x", "low_y", "high_x", "high_y")], *crop)
    p = p.withColumns(seen | {"contained": padded["contained"], "x_pixels": F.col("left") * F.col("scaled_width") / 1000, "y_pixels": F.col("top") * F.col("scaled_height") / 1000})
    return p.drop("_smooth", "_at_x", "_at_y")


def crop_audit(path: DataFrame) -> DataFrame:
    """One row a track of crop_path: whether all fits, what stays visible at least, how fast the crop moves, and contacts with the source's edge."""
    x_edge, y_edge = (F.col("x_min") <= 5) | (F.col("x_max") >= 995), (F.col("y_min") <= 5) | (F.col("y_max") >= 995)
    least = lambda c: F.round(F.least(F.lit(1.0), F.min(c)), 6).alias(f"min_{c}")
    return with_motion(path, "x_pixels", "y_pixels", "seconds").groupBy("track_id").agg(
        F.count("*").alias("samples"), F.round(F.first("view_x"), 4).alias("view_x"), F.round(F.first("view_y"), 4).alias("view_y"),
        F.max(F.col("x_max") - F.col("x_min")).alias("max_width"), F.max(F.col("y_max") - F.col("y_min")).alias("max_height"),
        F.bool_and("feasible").alias("all_feasible"), F.bool_or("controlled").alias("controlled_clip"), F.count_if(~F.col("contained")).alias("not_contained"),
        least("visible_width"), least("visible_height"), least("visible_area"), *[_most(c, 4) for c in ("speed_x", "speed_y", "speed", "acceleration", "jerk")],
        F.count_if(x_edge).alias("x_contacts"), F.count_if(y_edge).alias("y_contacts"), F.count_if(boundary_contact(box())).alias("contacts"), F.round(F.avg(boundary_contact(box()).cast("int")), 6).alias("contact_ratio"),
    )


# --- regions of a series


def region_times(samples: DataFrame) -> DataFrame:
    """(series, t_ms, usable, box): each time of any region's sample; usable if every region of the series is tracked then, with the box around them."""
    regions = F.size(F.collect_set("region").over(W.partitionBy("series")))
    tracked = lambda c: F.when(F.col("state") == "tracked", F.col(c))
    return samples.withColumn("_regions", regions).groupBy("series", "t_ms").agg(
        (F.count_distinct(tracked("region")) == F.max("_regions")).alias("usable"),
        *[F.min(tracked(c)).alias(c) for c in ("x_min", "y_min")], *[F.max(tracked(c)).alias(c) for c in ("x_max", "y_max")],
    )


def region_coverage(samples: DataFrame, interval_ms: float) -> DataFrame:
    """(series, low_confidence, confidence_passed, ... passed): the gate of coverage_gate over the times of all regions, and no sample of low confidence."""
    gate = coverage_gate(region_times(samples).withColumnRenamed("series", "track_id"), interval_ms).withColumnRenamed("track_id", "series")
    low = F.count_if(F.col("state") == "low_confidence")
    confidence = samples.groupBy("series").agg(low.alias("low_confidence"), (low == 0).alias("confidence_passed"))
    both = gate.join(confidence, "series")
    return both.withColumn("passed", F.col("passed") & F.col("confidence_passed"))


def source_lineage(tracks: DataFrame) -> DataFrame:
    """(series, source_width, source_height, mismatch) of tracks (series, source_width, source_height, width, height): the one size of the source, or what is wrong with it."""
    side = F.least("width", "height")
    off = F.abs(F.col("width") / F.col("height") / (F.col("source_width") / F.col("source_height")) - 1) > F.greatest(F.lit(0.01), 2 / side)
    g = tracks.groupBy("series").agg(
        F.bool_or(F.col("source_width").isNull() | F.col("source_height").isNull()).alias("_none"), F.min("source_width").alias("source_width"), F.min("source_height").alias("source_height"),
        F.count_distinct("source_width", "source_height").alias("_sizes"), F.bool_or(side.isNull() | F.col("width").isNull() | F.col("height").isNull()).alias("_blind"), F.bool_or(off).alias("_off"),
    )
    why = F.when(F.col("_none"), "missing_seed_dimensions").when(F.col("_sizes") > 1, "required_tracks_disagree").when(F.col("_blind"), "missing_analysis_dimensions").when(F.col("_off"), "analysis_aspect_disagrees")
    return g.select("series", "source_width", "source_height", F.concat(F.lit("track_source_geometry_mismatch:"), why).alias("mismatch"))


def soft_extents(path: DataFrame, preferred: DataFrame) -> DataFrame:
    """(track_id, region, visible, missing, clipped, passed): how much of preferred regions (track_id, region, t_ms, state, box, floor) a crop path (with t_ms) shows at least.

    A time without a tracked box shows nothing and fails the region; clipped names the edges that are cut off.
    """
    p = preferred.where("state = 'tracked'").select("track_id", "region", "t_ms", *[F.col(c).alias(f"soft_{c}") for c in ("x_min", "y_min", "x_max", "y_max")])
    regions = preferred.groupBy("track_id", "region").agg(F.max("floor").alias("floor"))
    keys = path.select("track_id", "t_ms", "left", "top", "view_x", "view_y").join(regions, "track_id")
    rows = keys.join(p, ["track_id", "region", "t_ms"], "left")
    x0, y0, x1, y1 = (F.col(f"soft_{c}") for c in ("x_min", "y_min", "x_max", "y_max"))
    right, bottom = F.col("left") + F.col("view_x"), F.col("top") + F.col("view_y")
    share = crop_visibility([x0, y0, x1, y1], F.col("left"), F.col("top"), F.col("view_x"), F.col("view_y"))["visible_area"]
    edges = F.array_compact(F.array(F.when(y1 > bottom + 1e-6, F.lit("bottom")), F.when(x0 < F.col("left") - 1e-6, F.lit("left")), F.when(x1 > right + 1e-6, F.lit("right")), F.when(y0 < F.col("top") - 1e-6, F.lit("top"))))
    g = rows.groupBy("track_id", "region", "floor").agg(F.min(F.coalesce(share, F.lit(0.0))).alias("_v"), F.count_if(x0.isNull()).alias("missing"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(edges)))).alias("clipped"))
    return g.select("track_id", "region", F.round("_v", 6).alias("visible"), "missing", "clipped", ((F.col("missing") == 0) & (F.col("_v") + 1e-6 >= F.col("floor"))).alias("passed"))


def soft_extent_visibility(crops: DataFrame, preferred: DataFrame, view: float) -> DataFrame:
    """Crop keyframes (track_id, t_ms, left) with the visible share of the preferred box at just that time; without one it is 0."""
    p = preferred.select("track_id", "t_ms", "x_min", "x_max")
    share = F.greatest(F.lit(0.0), F.least(F.col("x_max"), F.col("left") + view) - F.greatest(F.col("x_min"), F.col("left"))) / (F.col("x_max") - F.col("x_min"))
    return crops.join(p, ["track_id", "t_ms"], "left").select("track_id", "t_ms", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("visible"))


# --- routing


def _say(when: Column, code: str) -> Column:
    return F.when(when, F.lit(code))


def _list(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes))


def vertical_paths(samples: DataFrame, contracts: DataFrame, preferred: DataFrame | None, interval_ms: float) -> DataFrame:
    """The crop path of 1080 by 1920 of each series (as track_id) over the times at which all required regions are tracked.

    It aims at the required regions together with the preferred ones if those cover the same times.
    """
    times = region_times(samples).where("usable").drop("usable")
    if preferred is not None:
        joint = samples.unionByName(preferred.select(*samples.columns))
        fine = region_coverage(joint, interval_ms).where("passed").select("series", F.col("common").alias("_joint"))
        wanted = region_times(joint).where("usable").select("series", "t_ms", center("x").alias("_x"), center("y").alias("_y")).join(fine, "series")
        times = times.withColumn("_n", F.count("*").over(W.partitionBy("series"))).join(wanted, ["series", "t_ms"], "left")
        same = F.col("_joint") == F.col("_n")
        times = times.withColumns({"want_x": F.when(same, F.col("_x")), "want_y": F.when(same, F.col("_y"))}).drop("_n", "_joint", "_x", "_y")
    start = samples.groupBy("series").agg(F.min("t_ms").alias("_start"))
    rows = times.join(start, "series").join(contracts, "series").withColumnRenamed("series", "track_id")
    place = F.row_number().over(W.partitionBy("track_id").orderBy("t_ms")) - 1
    return crop_path(rows.withColumns({"sample_index": place, "seconds": (F.col("t_ms") - F.col("_start")) / 1000, "safety": _safety()}), 1080, 1920)


def _safety() -> Column:
    return F.when(F.col("allow_clipping"), 1.0).otherwise(1.08)


def seed_anchors(seeds: DataFrame, contracts: DataFrame) -> DataFrame:
    """(series, one_seed, ...): the audit of a crop held still on the box around the seeds of all regions (series, region, seed_ms, box)."""
    g = seeds.groupBy("series").agg(F.count_distinct("seed_ms").alias("_times"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))
    rows = g.join(contracts, "series").withColumnRenamed("series", "track_id").withColumns({"sample_index": F.lit(0), "seconds": F.lit(0.0), "safety": _safety()})
    path = crop_path(rows, 1080, 1920)
    held = (F.col("_times") == 1) & ((F.col("overflow_policy") == "controlled_clip") | (F.col("feasible") & F.col("contained")))
    return path.select(F.col("track_id").alias("series"), held.alias("anchor_held"), F.col("controlled").alias("anchor_clip"), boundary_contact(box()).alias("anchor_touches"))


def vertical_routing(samples: DataFrame, contracts: DataFrame, seeds: DataFrame, interval_ms: float, preferred: DataFrame | None = None) -> DataFrame:
    """(series, strategy, reason, risks, needs_review): a tracked crop, a crop held on the seed, or the fallback and why.

    samples: series, region, t_ms, state, box of the required regions. contracts, one a series: allow_clipping,
    overflow_policy, edge_priority, fallback_strategy, sample_aspect, source_width, source_height, mismatch
    (source_lineage). A series without samples has no coverage.
    """
    path = cut_lineage(vertical_paths(samples, contracts, preferred, interval_ms))  # read for the audit and the extents
    audit = crop_audit(path).withColumnRenamed("track_id", "series").drop("samples")
    all_of = contracts.join(region_coverage(samples, interval_ms), "series", "left").join(audit, "series", "left").join(seed_anchors(seeds, contracts), "series", "left")
    if preferred is None:
        all_of = all_of.withColumn("soft_passed", F.lit(True))
    else:
        soft = soft_extents(path, preferred.withColumnRenamed("series", "track_id")).groupBy(F.col("track_id").alias("series")).agg(F.bool_and("passed").alias("soft_passed"))
        all_of = all_of.join(soft, "series", "left").withColumn("soft_passed", F.coalesce("soft_passed", F.lit(True)))
    fallback, preserve = F.col("fallback_strategy"), F.col("overflow_policy") == "preserve_all"
    weak = ~F.coalesce("confidence_passed", F.lit(True))
    few = F.coalesce("common", F.lit(0)) < 2
    uncovered = few | ~F.coalesce("passed", F.lit(False))
    why_uncovered = F.when(weak, "required_region_tracking_confidence_failed").when(few, "fewer_than_two_usable_tracking_samples").otherwise("required_region_tracking_coverage_failed")
    anchored = uncovered & (fallback == "center_crop") & F.coalesce("anchor_held", F.lit(False))
    square = F.abs(F.col("sample_aspect") - 1) <= 1e-6
    edge = interval_ms * 0.55 + 35
    wide, tall = F.col("max_width") * _safety() > F.col("view_x"), F.col("max_height") * _safety() > F.col("view_y")
    case = F.when(~square, "aspect").when(F.col("mismatch").isNotNull(), "lineage").when(anchored, "anchor").when(uncovered, "uncovered").when(preserve & ~F.col("all_feasible"), "too_large").when(preserve & (F.col("not_contained") > 0), "not_contained").otherwise("tracked")
    all_of = all_of.withColumn("_case", case)
    is_ = lambda name: F.col("_case") == name
    reason = (
        F.when(is_("aspect"), "non_square_pixel_aspect_ratio_requires_static_reframe").when(is_("lineage"), F.col("mismatch")).when(is_("anchor"), F.concat(why_uncovered, F.lit("_used_static_seed_anchor")))
        .when(is_("uncovered"), why_uncovered).when(is_("too_large"), "required_region_union_too_large_for_safe_9x16_crop").when(is_("not_contained"), "required_region_containment_gate_failed")
    )
    touches = lambda c: (_say(c, "source_boundary_contact"), _say(c, "not_recoverable_by_pan"))
    risks = (
        F.when(is_("aspect"), F.array(F.lit("non_square_pixel_aspect_ratio_requires_static_reframe")))
        .when(is_("lineage"), F.array(F.lit("track_source_geometry_mismatch")))
        .when(is_("anchor"), _list(F.lit("required_region_tracking_coverage_failed"), F.lit("seed_anchor_static_hold"), F.lit("motion_outside_seed_unverified"), _say(weak, "required_region_low_confidence"), _say(F.col("anchor_clip"), "controlled_required_region_clip"), *touches(F.col("anchor_touches"))))
        .when(is_("uncovered"), _list(_say(weak, "required_region_low_confidence"), F.lit("required_region_unavailable")))
        .when(is_("too_large"), _list(_say(wide, "required_region_too_wide"), _say(tall, "required_region_too_tall"), _say(~wide & ~tall, "required_region_not_containable")))
        .when(is_("not_contained"), F.array(F.lit("required_region_not_contained")))
        .otherwise(_list(
            _say(F.col("controlled_clip"), "controlled_required_region_clip"), _say(~F.col("soft_passed"), "soft_extent_visibility_below_floor"), _say((F.col("head_gap_ms") > edge) | (F.col("tail_gap_ms") > edge), "analysis_edge_hold_long"),
            *touches(F.col("contacts") > 0), _say(F.col("max_speed") > 720, "crop_motion_fast"), _say(F.col("max_acceleration") > 1800, "crop_motion_acceleration_high"),
        ))
    )
    strategy = F.when(is_("anchor"), "seed_anchor_crop").when(is_("tracked"), "tracked_crop").otherwise(fallback)
    out = all_of.select("series", strategy.alias("strategy"), reason.alias("reason"), risks.alias("risks"))
    return out.withColumn("needs_review", F.size("risks") > 0)


def horizontal_routing(samples: DataFrame, contracts: DataFrame) -> DataFrame:
    """(track_id, route, reason, risks, requested_zoom, safe_zoom, applied_zoom): a tracked zoom, or the original and the first gate that failed.

    samples: track_id, sample_index, t_ms, state, box. contracts, one a track: zoom_intent (subtle or detail),
    sample_aspect, source_width, source_height, mismatch (source_lineage).
    """
    requested = F.when(F.col("zoom_intent") == "subtle", 1.12).otherwise(1.35)
    base = cover_transform(F.col("source_width"), F.col("source_height"), 1920, 1080)
    low = F.count_if(F.col("state") == "low_confidence")
    counts = samples.groupBy("track_id").agg(low.alias("low"), F.count_if(F.col("state") == "tracked").alias("usable"), F.min("t_ms").alias("_start"), *[F.max(F.when(F.col("state") == "tracked", F.col(f"{a}_max") - F.col(f"{a}_min"))).alias(f"_{a}") for a in "xy"])
    c = contracts.join(counts, "track_id", "left").withColumns({"requested": requested, "_w": base["scaled_width"], "_h": base["scaled_height"]})
    c = c.withColumn("safe", _most_zoom("_x", "_y", F.col("_w"), F.col("_h"))).withColumn("zoom", _clamp(F.col("safe"), F.lit(1.0), F.col("requested")))
    early = (
        F.when(F.abs(F.col("sample_aspect") - 1) > 1e-6, "aspect").when(F.col("mismatch").isNotNull(), "lineage").when(F.coalesce("low", F.lit(0)) > 0, "confidence")
        .when(F.coalesce("usable", F.lit(0)) < 2, "few").when(F.col("zoom") < 1.035, "margin")
    )
    c = c.withColumn("_case", early)
    able = c.where("_case IS NULL").select("track_id", "zoom", "source_width", "source_height", "_start")
    rows = samples.where("state = 'tracked'").select("track_id", "sample_index", "t_ms", "x_min", "y_min", "x_max", "y_max").join(able, "track_id")
    audit = crop_audit(crop_path(rows.withColumns({"seconds": (F.col("t_ms") - F.col("_start")) / 1000, "safety": F.lit(1.45)}), 1920, 1080)).select("track_id", (F.col("all_feasible") & (F.col("not_contained") == 0)).alias("_held"))
    c = c.join(audit, "track_id", "left").withColumn("_case", F.coalesce("_case", F.when(F.col("_held"), "tracked").otherwise("containment")))
    is_ = lambda name: F.col("_case") == name
    aspect = "non_square_pixel_aspect_ratio_requires_static_reframe"
    reason = (
        F.when(is_("aspect"), aspect).when(is_("lineage"), F.col("mismatch")).when(is_("confidence"), "tracking_confidence_gate_failed").when(is_("few"), "fewer_than_two_usable_tracking_samples")
        .when(is_("margin"), "mask_geometry_left_no_safe_zoom_margin").when(is_("containment"), "tracked_reframe_containment_gate_failed")
    )
    risk = (
        F.when(is_("aspect"), aspect).when(is_("lineage"), "track_source_geometry_mismatch").when(is_("confidence"), "tracking_low_confidence").when(is_("few"), "insufficient_high_confidence_tracking_samples")
        .when(is_("margin"), "tracked_reframe_no_safe_zoom_margin").when(is_("containment"), "tracked_reframe_required_region_not_contained")
    )
    late = F.col("_case").isin("margin", "containment", "tracked")
    return c.select(
        "track_id", F.when(is_("tracked"), "tracked_zoom").otherwise("original").alias("route"), reason.alias("reason"), F.when(is_("tracked"), F.array().cast("array<string>")).otherwise(F.array(risk, F.lit("requested_tracked_reframe_not_applied"))).alias("risks"),
        F.col("requested").alias("requested_zoom"), F.when(late, F.round("safe", 4)).alias("safe_zoom"), F.when(is_("tracked"), F.round("zoom", 4)).otherwise(1.0).alias("applied_zoom"),
    )
