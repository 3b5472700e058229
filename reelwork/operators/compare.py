"""Comparison of runs: labels, boxes, verdicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from reelwork.functions.geometry import center_distance, iou
from reelwork.functions.text import label_similarity
from reelwork.session import arrow_map, find_package

# Spark may not know that it is determined: it would move a filter on the score, and with it the scoring, below distinct()
_scored = F.pandas_udf(label_similarity.func, DoubleType()).asNondeterministic()
HARD_REJECTIONS = ("not_visible", "target_mismatch", "insufficient_evidence")


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x_min", "y_min", "x_max", "y_max")]


def match_status(visible: Column, n: Column, given: Column | None = None) -> Column:
    derived = F.when(~visible, "not_visible").when(n == 1, "matched").otherwise("ambiguous")
    return derived if given is None else F.coalesce(given, derived)


def match_status_violations(proposals: DataFrame, key: list[str]) -> DataFrame:
    """(key, rule) where status, visible and n_candidates don't go together."""
    visible, n, status = F.col("visible"), F.col("n_candidates"), F.col("status")
    rule = F.when((status == "matched") & (~visible | (n != 1)), "matched_needs_one_visible").when((status == "ambiguous") & (~visible | (n == 0)), "ambiguous_needs_candidates").when(~status.isin("matched", "ambiguous") & (visible | (n > 0)), "other_needs_none")
    return proposals.select(*key, rule.alias("rule")).where("rule IS NOT NULL")


def single_matched(proposals: DataFrame) -> DataFrame:
    """Proposals whose only candidate is matched."""
    return proposals.where((match_status(F.col("visible"), F.col("n_candidates")) == "matched") & (F.col("n_candidates") == 1))


def tracking_seed(proposals: DataFrame, key: list[str], number: Column | None = None, require_predicate: bool = False) -> DataFrame:
    """(key, candidate_number, selection_source, reject_reason): automatic for one matched candidate, else by a 1-based number.

    A number never overrides a hard rejection.
    """
    number = F.lit(None).cast("int") if number is None else number
    n, status = F.col("n_candidates"), F.col("status")
    reason = F.when(~F.col("visible") | (n == 0), "not_visibly_grounded").when(status.isin(*HARD_REJECTIONS), F.concat(F.lit("rejected_"), status))
    if require_predicate:
        reason = reason.when(F.coalesce(F.col("predicate_status"), F.lit("indeterminate")) != "satisfied", "predicate_not_satisfied")
    reason = reason.when(number.isNull() & (status != "matched"), "needs_review").when(number.isNull() & (n != 1), "needs_number").when((number < 1) | (number > n), "number_out_of_range")
    source = F.when(number.isNull(), "single_matched_candidate").otherwise("explicit_candidate_number")
    out = proposals.select(*key, F.coalesce(number, F.lit(1)).alias("candidate_number"), source.alias("selection_source"), reason.alias("reject_reason"))
    ok = F.col("reject_reason").isNull()
    return out.select(*key, F.when(ok, F.col("candidate_number")).alias("candidate_number"), F.when(ok, F.col("selection_source")).alias("selection_source"), "reject_reason")


def run_pairs(runs: DataFrame) -> DataFrame:
    """(left_run, right_run): the unordered pairs of runs."""
    ids = runs.select("run_id").distinct()
    return ids.select(F.col("run_id").alias("left_run")).join(ids.select(F.col("run_id").alias("right_run")), F.col("left_run") < F.col("right_run"))


def pairs_within(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of two runs of one asset side by side (left_*, right_*): a join on the keys, not a product of all rows."""
    side = lambda p: rows.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ["run_id", *columns]])
    return side("left").join(side("right"), keys).where("left_run_id < right_run_id")


def with_label_similarity(pairs: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """pairs with the similarity of two labels, scored once for each distinct pair of labels."""
    find_package(pairs.sparkSession)
    labels = pairs.select(left, right).distinct().withColumn(name, _scored(left, right))
    return pairs.join(labels, [left, right])


def greedy_match(pairs: DataFrame, keys: list[str], left: str, right: str, floor: float | None = None) -> DataFrame:
    """One-to-one matches in each group of keys: the most similar pair first, ties by left, then right.

    pairs has a column similarity. Spark deals the groups out and sorts them; a task then reads
    its rows in order and keeps only the ids that its current group has matched.
    """
    kept = pairs if floor is None else pairs.where(F.col("similarity") >= floor)
    ordered = kept.repartition(*keys).sortWithinPartitions(*keys, F.col("similarity").desc(), left, right)

    def run(batches):
        group, lefts, rights = None, set(), set()
        for batch in batches:
            chosen = []
            rows = zip(*[batch.column(k).to_pylist() for k in keys], batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)
            for i, (*own, a, b) in enumerate(rows):
                if own != group:
                    group, lefts, rights = own, set(), set()
                if a not in lefts and b not in rights:
                    lefts.add(a)
                    rights.add(b)
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    return arrow_map(ordered, run, pairs.schema)


def greedy_match_rounds(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """greedy_match() by rounds of joins, for groups of any size: a pair that is best for both its sides is matched."""
    from reelwork.operators.rounds import cut_lineage

    order = [F.col("similarity").desc(), F.col(left), F.col(right)]
    rest, done = cut_lineage(pairs), None
    while not rest.isEmpty():
        ranked = rest.withColumn("_l", F.row_number().over(W.partitionBy(*keys, left).orderBy(*order))).withColumn("_r", F.row_number().over(W.partitionBy(*keys, right).orderBy(*order)))
        best = cut_lineage(ranked.where("_l = 1 AND _r = 1").drop("_l", "_r"))
        done = best if done is None else done.unionByName(best)
        rest = cut_lineage(rest.join(best.select(*keys, left), [*keys, left], "left_anti").join(best.select(*keys, right), [*keys, right], "left_anti"))
    return pairs.limit(0) if done is None else done


def match_groundings(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Greedy matches of grounded targets: half the similarity where the kinds differ, and 0.5 at least."""
    halved = pairs.withColumn("similarity", F.col("similarity") * F.when(F.col("left_kind") == F.col("right_kind"), 1.0).otherwise(0.5))
    return greedy_match(halved, keys, left, right, 0.5)


def best_proposal(references: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """For each reference (keys, reference_id, reference_label, reference_time_ms) the most similar proposal, then the nearest in time.

    comparable needs a similarity of 0.75 and 250 ms at most; reason says what is missing.
    """
    pairs = with_label_similarity(references.join(proposals, keys), "reference_label", "label")
    gap = F.abs(F.col("reference_time_ms") - F.col("frame_time_ms"))
    ranked = pairs.withColumn("gap_ms", gap).withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "reference_id").orderBy(F.col("similarity").desc(), "gap_ms", "event_id")))
    reason = F.concat_ws("; ", F.when(F.col("similarity") < 0.75, "label similarity below 0.75"), F.when(F.col("gap_ms") > 250, "frame time gap over 250 ms"))
    return ranked.where("_rn = 1").drop("_rn").withColumn("reason", reason).withColumn("comparable", F.col("reason") == "")


def with_box_metrics(pairs: DataFrame, a: str = "left_", b: str = "right_") -> DataFrame:
    return pairs.withColumn("iou", iou(box(a), box(b))).withColumn("distance", center_distance(box(a), box(b)))


def verdict(comparable: Column, value: Column, reason: Column) -> Column:
    """pass from 0.8, review from 0.5, fail below or for a wrong target, unscored where nothing can be compared."""
    return F.when(~comparable & reason.contains("label similarity"), "fail").when(~comparable, "unscored").when(value >= 0.8, "pass").when(value >= 0.5, "review").otherwise("fail")


def verdict_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, passed, review, failed, unscored."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return scored.groupBy(*by).agg(count("pass").alias("passed"), count("review").alias("review"), count("fail").alias("failed"), count("unscored").alias("unscored"))


def group_stats(rows: DataFrame, by: str) -> DataFrame:
    """Runs, passes (from 0.8), fails, and mean, least and greatest IoU of each group."""
    ok = F.count_if(F.col("iou") >= 0.8)
    return rows.groupBy(by).agg(F.count("*").alias("runs"), ok.alias("passed"), (F.count("*") - ok).alias("failed"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.min("iou"), 6).alias("min_iou"), F.round(F.max("iou"), 6).alias("max_iou"))


def repeat_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated runs on one target: how many, how many gave one matched box, the rest, and the mean center."""
    good = (match_status(F.col("visible"), F.col("n_candidates")) == "matched") & (F.col("n_candidates") == 1)
    middle = (F.col("x_min") + F.col("x_max")) / 2
    return runs.groupBy(*keys).agg(F.count("*").alias("requested"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failures"), F.round(F.avg(F.when(good, middle)), 6).alias("mean_center_x"))


def request_mismatches(cached: DataFrame, requests: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, expected, actual) for each field in which a cached result is not the requested one."""
    from reelwork.operators.shots import echo_mismatches

    return echo_mismatches(cached, requests, key, fields)


def box_violations(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule) for boxes that are empty or leave the space."""
    x0, y0, x1, y1 = box()
    rules = F.array_compact(F.array(F.when(x0 >= x1, F.lit("empty_x")), F.when(y0 >= y1, F.lit("empty_y")), F.when((x0 < 0) | (y0 < 0) | (x1 > 1000) | (y1 > 1000), F.lit("out_of_range"))))
    return boxes.select(*keys, F.explode(rules).alias("rule"))
