"""Shots, interval joins and sampling plans on a millisecond timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.times import ms_to_mmss, overlaps

#: Width of the time buckets that interval joins hash on.
BUCKET_MS = 86_400_000
# The words that ask for the highest rate.
FAST_MARKERS = ("快速", "短暫", "0.2", "0.3", "0.4", "0.5", "fast", "transient", "ui")
#: Frames of a window at most; more are a violation.
MOST_FRAMES = 3600


def shots_from_scores(boundaries: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, shot_index, start_ms, end_ms) from scored boundaries and assets (asset_id, duration_ms).

    Boundaries at or before 0, or at the end or after it, are dropped; of several in one
    millisecond one stays. An asset without any is one shot.
    """
    inner = boundaries.where((F.col("t_ms") > 0) & (F.col("t_ms") < F.col("duration_ms"))).select("asset_id", "t_ms").distinct()
    starts = inner.unionByName(assets.select("asset_id", F.lit(0).cast("long").alias("t_ms"))).join(assets, "asset_id")
    order = W.partitionBy("asset_id").orderBy("t_ms")
    return starts.select("asset_id", F.row_number().over(order).alias("shot_index"), F.col("t_ms").alias("start_ms"), F.lead("t_ms").over(order).alias("next"), "duration_ms").select("asset_id", "shot_index", "start_ms", F.coalesce("next", "duration_ms").alias("end_ms"))


def best_boundaries(boundaries: DataFrame) -> DataFrame:
    """(asset_id, boundary_index, t_ms, score): the highest score of each millisecond, the first on a tie."""
    inner = boundaries.where((F.col("t_ms") > 0) & (F.col("t_ms") < F.col("duration_ms")))
    best = inner.groupBy("asset_id", "t_ms").agg(F.max("score").alias("score"))
    return best.select("asset_id", F.row_number().over(W.partitionBy("asset_id").orderBy("t_ms")).alias("boundary_index"), "t_ms", "score")


def _buckets(start: Column, end: Column) -> Column:
    first = F.floor(start / BUCKET_MS)
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / BUCKET_MS)))


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, how: str = "inner") -> DataFrame:
    """points joined to the interval (key, start_ms, end_ms) that holds the time at, start included.

    Both sides meet in time buckets, so the join hashes on (key, bucket) however many intervals a key has.
    """
    held = intervals.withColumn("_bucket", F.explode(_buckets(F.col("start_ms"), F.col("end_ms")))).withColumnRenamed(key, "_key")
    p = points.withColumn("_at", F.floor(F.col(at) / BUCKET_MS))
    match = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bucket")) & (F.col("start_ms") <= F.col(at)) & (F.col(at) < F.col("end_ms"))
    return p.join(held, match, how).drop("_key", "_bucket", "_at")


def overlapping(events: DataFrame, shots: DataFrame) -> DataFrame:
    """events (asset_id, event_start, event_end) with each shot that they overlap, once a pair."""
    e = events.withColumn("_b", F.explode(_buckets(F.col("event_start"), F.col("event_end"))))
    s = shots.withColumn("_b", F.explode(_buckets(F.col("start_ms"), F.col("end_ms"))))
    pairs = e.join(s, ["asset_id", "_b"]).where(overlaps(F.col("event_start"), F.col("event_end"), F.col("start_ms"), F.col("end_ms")))
    first = F.greatest(F.floor(F.col("event_start") / BUCKET_MS), F.floor(F.col("start_ms") / BUCKET_MS))
    return pairs.where(F.col("_b") == first).drop("_b")


def event_shot_overlap(events: DataFrame, shots: DataFrame) -> DataFrame:
    """(asset_id, event_id, shot_ids, exact_frame_required): the shots of each event in order; null where it has none."""
    e = events.withColumnsRenamed({"start_ms": "event_start", "end_ms": "event_end"})
    found = overlapping(e.select("asset_id", "event_id", "event_start", "event_end"), shots).groupBy("asset_id", "event_id").agg(F.array_sort(F.collect_list("shot_index")).alias("shot_ids"))
    return events.select("asset_id", "event_id").join(found, ["asset_id", "event_id"], "left").withColumn("exact_frame_required", F.coalesce(F.size("shot_ids") > 1, F.lit(False)))


def clip_timeline(events: DataFrame, shots: DataFrame) -> DataFrame:
    """Events with MM:SS times and their shots."""
    return event_shot_overlap(events, shots).join(events.select("asset_id", "event_id", ms_to_mmss(F.col("start_ms")).alias("start_text"), ms_to_mmss(F.col("end_ms")).alias("end_text")), ["asset_id", "event_id"])


def interval_intersection(points: DataFrame, shots: DataFrame) -> DataFrame:
    """points (asset_id, event_id, allowed_start, allowed_end, seed_ms) cut to the seed's shot; the seed must lie inside."""
    held = point_in_interval(points, shots, "asset_id", "seed_ms")
    start, end = F.greatest("allowed_start", "start_ms"), F.least("allowed_end", "end_ms")
    return held.select("asset_id", "event_id", start.alias("from_ms"), end.alias("to_ms"), "seed_ms").where("from_ms <= seed_ms AND seed_ms < to_ms")


def dense_window(events: DataFrame, shots: DataFrame, window_ms: int = 4000, least_ms: int = 250, keep: tuple[str, ...] = ()) -> DataFrame:
    """A window about the keyframe, or the middle, of each event, inside the event and its shot."""
    middle = F.floor((F.col("event_start") + F.col("event_end")) / 2)
    e = events.withColumnsRenamed({"start_ms": "event_start", "end_ms": "event_end"}).withColumn("center_ms", F.coalesce("keyframe_ms", middle))
    held = point_in_interval(e, shots, "asset_id", "center_ms")
    start = F.greatest(F.col("center_ms") - window_ms // 2, "event_start", "start_ms")
    end = F.least(F.col("center_ms") + window_ms // 2, "event_end", "end_ms")
    return held.select("asset_id", "event_id", "shot_index", "center_ms", start.alias("window_start"), end.alias("window_end"), *keep).where(F.col("window_end") - F.col("window_start") >= least_ms)


def segment_bounds(centers: DataFrame, shots: DataFrame, duration_ms: int, least_ms: int = 1000) -> DataFrame:
    """A segment of the duration about each center, shifted into its shot and then cut to it."""
    held = point_in_interval(centers, shots, "asset_id", "center_ms")
    start = F.col("center_ms") - duration_ms // 2
    start = F.when(start < F.col("start_ms"), F.col("start_ms")).when(start + duration_ms > F.col("end_ms"), F.col("end_ms") - duration_ms).otherwise(start)
    out = held.withColumn("_start", start).select("asset_id", "event_id", F.greatest("_start", "start_ms").alias("segment_start"), F.least(F.col("_start") + duration_ms, "end_ms").alias("segment_end"))
    return out.where(F.col("segment_end") - F.col("segment_start") >= least_ms)


def events_needing_dense(events: DataFrame, mode: str, ids: list[int] | None = None) -> DataFrame:
    """events (with inspection: none, required or recommended) that the mode asks for; explicit ids win."""
    if ids is not None:
        return events.where(F.col("event_id").isin(ids))
    allowed = {"none": [], "required": ["required"], "flagged": ["required", "recommended"], "all": ["none", "required", "recommended"]}[mode]
    return events.where(F.col("inspection").isin(allowed)) if allowed else events.limit(0)


def seed_time(frame_ms: Column, start: Column, end: Column) -> Column:
    """The anchor if it lies in the interval, else the middle."""
    return F.when((frame_ms >= start) & (frame_ms < end), frame_ms).otherwise(F.floor((start + end) / 2))


def dense_fps(inspection: Column, text: Column) -> Column:
    """Frames a second: 8 where a look is required and the text speaks of something fast, 4 where one is asked for, else 2."""
    fast = F.greatest(*[F.contains(F.lower(text), F.lit(m)) for m in FAST_MARKERS])
    return F.when((inspection == "required") & fast, 8).when(inspection.isin("required", "recommended"), 4).otherwise(2)


def grid(start: Column, end: Column, step: Column | int) -> Column:
    """start, start + step ... before end; empty where the interval is."""
    step = step if isinstance(step, Column) else F.lit(step)
    return F.when(end > start, F.sequence(start, end - 1, step.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _dense_times(step: Column | int) -> Column:
    """The grid of a window and the event's keyframe, if it lies in the window, each once and inside the asset."""
    held = (F.col("window_start") <= F.col("keyframe_ms")) & (F.col("keyframe_ms") < F.col("window_end"))
    key = F.when(held, F.array("keyframe_ms")).otherwise(F.array().cast("array<bigint>"))
    inside = F.transform(F.concat(grid(F.col("window_start"), F.col("window_end"), step), key), lambda t: F.least(F.greatest(t, F.lit(0)), F.col("duration_ms") - 1))
    return F.array_sort(F.array_distinct(inside))


def dense_grid(windows: DataFrame, step: Column | int, most: int = MOST_FRAMES) -> DataFrame:
    """(asset_id, event_id, frame_ms) for windows with keyframe_ms and duration_ms; one of more frames than most has none, see dense_grid_violations()."""
    times = windows.select("asset_id", "event_id", _dense_times(step).alias("times"))
    return times.where(F.size("times") <= most).select("asset_id", "event_id", F.explode("times").alias("frame_ms"))


def dense_grid_violations(windows: DataFrame, step: Column | int, most: int = MOST_FRAMES) -> DataFrame:
    """(asset_id, event_id, rule, frames) of the windows that ask for more frames than most."""
    asked = windows.select("asset_id", "event_id", F.lit("over_limit").alias("rule"), F.size(_dense_times(step)).cast("long").alias("frames"))
    return asked.where(F.col("frames") > most)


def bucket_sample(frames: DataFrame, key: str, at: str, step_ms: int, forced: str) -> DataFrame:
    """The first frame of each step from a key's start, and the forced ones."""
    first = F.min(at).over(W.partitionBy(key))
    held = frames.withColumn("_bucket", F.floor((F.col(at) - first) / step_ms))
    rn = F.row_number().over(W.partitionBy(key, "_bucket").orderBy(at, "event_id"))
    return held.withColumn("_rn", rn).where((F.col("_rn") == 1) | F.expr(forced)).drop("_bucket", "_rn")


def frame_numbers(frames: DataFrame, clip: str, order: list[str], prefix: str) -> DataFrame:
    """Global ids like RF000001 in the order of clips and, in them, of the frames.

    Clips are counted and sorted into ranges first; sums run within a range, and over the totals
    of the ranges, so no window spans all frames or all clips.
    """
    from reelwork.operators.rounds import cut_lineage

    counts = cut_lineage(frames.groupBy(clip).count().repartitionByRange(clip).withColumn("_range", F.spark_partition_id()))
    all_before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("_range").agg(F.sum("count").alias("count")).select("_range", all_before(W.orderBy("_range")).alias("_base"))
    within = counts.select(F.col(clip).alias("_clip"), "_range", all_before(W.partitionBy("_range").orderBy(clip)).alias("_within"))
    offsets = within.join(ranges, "_range").select("_clip", (F.col("_base") + F.col("_within")).alias("_before"))
    local = frames.withColumn("_n", F.row_number().over(W.partitionBy(clip).orderBy(*order)))
    n = F.coalesce("_before", F.lit(0)) + F.col("_n")
    return local.join(offsets, F.col(clip) == F.col("_clip")).withColumn("frame_id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0"))).drop("_clip", "_before", "_n")


def entity_violations(references: DataFrame, entities: DataFrame) -> DataFrame:
    """(asset_id, event_id, entity_id, rule): references (asset_id, event_id, entity_id) to entities (asset_id, entity_id) that are unknown or stand there twice (event_id null)."""
    known = entities.select("asset_id", "entity_id").distinct()
    unknown = references.distinct().join(known, ["asset_id", "entity_id"], "left_anti").select("asset_id", "event_id", "entity_id", F.lit("unknown_entity").alias("rule"))
    twice = entities.groupBy("asset_id", "entity_id").count().where("count > 1").select("asset_id", F.lit(None).cast("long").alias("event_id"), "entity_id", F.lit("duplicate_entity").alias("rule"))
    return unknown.unionByName(twice)


def content_map_violations(events: DataFrame) -> DataFrame:
    """(asset_id, event_id, rule) for ids that repeat, empty intervals, keyframes outside and ends after the asset."""
    n = F.count("*").over(W.partitionBy("asset_id", "event_id"))
    rules = F.array_compact(F.array(
        F.when(n > 1, F.lit("duplicate_id")), F.when(F.col("start_ms") >= F.col("end_ms"), F.lit("empty_interval")),
        F.when((F.col("keyframe_ms") < F.col("start_ms")) | (F.col("keyframe_ms") >= F.col("end_ms")), F.lit("keyframe_outside")),
        F.when(F.col("end_ms") > F.col("duration_ms"), F.lit("beyond_duration")),
    ))
    return events.select("asset_id", "event_id", rules.alias("rules")).select("asset_id", "event_id", F.explode("rules").alias("rule"))


def _event_rules(events: DataFrame, *rules: Column) -> DataFrame:
    return events.select("asset_id", "event_id", F.array_compact(F.array(*rules)).alias("rules")).select("asset_id", "event_id", F.explode("rules").alias("rule"))


def _repeated() -> Column:
    return F.when(F.count("*").over(W.partitionBy("asset_id", "event_id")) > 1, F.lit("duplicate_id"))


def temporal_map_violations(events: DataFrame, position: str = "position") -> DataFrame:
    """(asset_id, event_id, rule): ids occur once, intervals are not empty and have their keyframe inside, none goes beyond the asset, and in the order of position each begins after the one before it."""
    before = F.lag("end_ms").over(W.partitionBy("asset_id").orderBy(position))
    return _event_rules(
        events, _repeated(), F.when(F.col("end_ms") <= F.col("start_ms"), F.lit("empty_interval")), F.when((F.col("keyframe_ms") < F.col("start_ms")) | (F.col("keyframe_ms") >= F.col("end_ms")), F.lit("keyframe_outside")),
        F.when(F.col("end_ms") > F.col("duration_ms"), F.lit("beyond_duration")), F.when(before > F.col("start_ms"), F.lit("overlap")),
    )


def moment_violations(moments: DataFrame, position: str = "position", ordered: bool = True) -> DataFrame:
    """(asset_id, event_id, rule) for moments of whole seconds: ids occur once, each is before the end, and in the order of position they rise; target candidates (ordered is false) need not."""
    seconds = F.floor(F.col("start_ms") / 1000)
    rising = F.when(F.lit(ordered) & (seconds <= F.lag(seconds).over(W.partitionBy("asset_id").orderBy(position))), F.lit("not_increasing"))
    return _event_rules(moments, _repeated(), rising, F.when(seconds * 1000 >= F.col("duration_ms"), F.lit("beyond_duration")))


def empty_maps(assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(asset_id, rule): assets without any target candidate."""
    return assets.select("asset_id").distinct().join(candidates, "asset_id", "left_anti").select("asset_id", F.lit("no_candidate").alias("rule"))


def echo_mismatches(answers: DataFrame, requests: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, expected, actual) where an answer doesn't repeat what its request said."""
    r = requests.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    each = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("string").alias("expected"), F.col(f).cast("string").alias("actual"))) for f in fields])
    return answers.join(r, keys).select(*keys, F.explode(F.array_compact(each)).alias("x")).select(*keys, "x.field", "x.expected", "x.actual")
