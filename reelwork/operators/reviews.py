"""Review rows: pairs of methods, export and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.geometry import center_distance, iou
from reelwork.operators.compare import box

KEYS = ["session_id", "moment_id", "target_id"]


def method_pairs(reviews: DataFrame) -> DataFrame:
    """Reviewed rows with their first sibling of another method on the same moment and target: IoU and distance, null without one."""
    r = reviews.where("reviewed")
    other = r.select(*KEYS, F.col("grounding_method").alias("other_method"), *[F.col(c).alias(f"other_{c}") for c in ("x_min", "y_min", "x_max", "y_max")])
    pairs = r.join(other, KEYS).where("grounding_method <> other_method")
    first = pairs.withColumn("_rn", F.row_number().over(W.partitionBy(*KEYS, "grounding_method", "x_min").orderBy("other_method", "other_x_min"))).where("_rn = 1")
    scored = first.select(*KEYS, "grounding_method", "x_min", "other_method", F.round(iou(box(), box("other_")), 6).alias("iou"), F.round(center_distance(box(), box("other_")), 6).alias("distance"))
    return r.select(*KEYS, "grounding_method", "x_min").join(scored, [*KEYS, "grounding_method", "x_min"], "left").withColumn("comparable", F.col("iou").isNotNull())


def export_reviews(reviews: DataFrame, annotations: DataFrame, proposals: DataFrame) -> DataFrame:
    """(session_id, position, review_id, status, annotation, proposal): each review of a session in order, with what a person and the model said once it is reviewed.

    reviews: session_id, review_id, position, status. annotations and proposals have review_id and one struct, annotation and
    proposal. A pending review shows neither; its model's answer stays hidden. pending_reviews() lists them.
    """
    done = F.col("status") == "reviewed"
    full = reviews.join(annotations, "review_id", "left").join(proposals, "review_id", "left")
    return full.select("session_id", "position", "review_id", "status", F.when(done, F.col("annotation")).alias("annotation"), F.when(done, F.col("proposal")).alias("proposal"))


def pending_reviews(exported: DataFrame) -> DataFrame:
    """(session_id, reviewed, pending): how many reviews of a session are done, and the ids of the others in order."""
    waits = F.when(F.col("status") != "reviewed", F.struct("position", "review_id"))
    return exported.groupBy("session_id").agg(F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.transform(F.array_sort(F.collect_list(waits)), lambda x: x["review_id"]).alias("pending"))


def export_violations(reviews: DataFrame, annotations: DataFrame, proposals: DataFrame) -> DataFrame:
    """(session_id, review_id, rule) of reviews that cannot be exported: reviewed without an annotation or a proposal, or annotated while pending."""
    full = reviews.join(annotations, "review_id", "left").join(proposals, "review_id", "left")
    done = F.col("status") == "reviewed"
    rules = F.array_compact(F.array(F.when(done & F.col("annotation").isNull(), F.lit("annotation_missing")), F.when(done & F.col("proposal").isNull(), F.lit("proposal_missing")), F.when(~done & F.col("annotation").isNotNull(), F.lit("annotated_but_pending"))))
    return full.select("session_id", "review_id", F.explode(rules).alias("rule"))


def review_violations(reviews: DataFrame) -> DataFrame:
    """(session_id, moment_id, rule): one verdict for each review, none revealed before it, and a corrected box (where there is one) from 0 to 1000 with both sides in order."""
    n = F.count("*").over(W.partitionBy(*KEYS, "grounding_method"))
    sides = [F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    outside = F.least(*sides) < 0
    bad = outside | (F.greatest(*sides) > 1000) | (F.col("x_min") >= F.col("x_max")) | (F.col("y_min") >= F.col("y_max"))
    rules = F.array_compact(F.array(F.when(n > 1, F.lit("several_verdicts")), F.when(F.col("revealed") & ~F.col("reviewed"), F.lit("revealed_before_verdict")), F.when(bad, F.lit("bad_box"))))
    return reviews.select("session_id", "moment_id", rules.alias("rules")).select("session_id", "moment_id", F.explode("rules").alias("rule"))
