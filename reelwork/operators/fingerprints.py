"""Hashes of what a result depends on, and the cache keys made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwork.functions.text import json_sha256

SEGMENT_VERSION = "feature-segment-render-v2"
TEMPORAL_VERSION = "query-temporal-refinement-v1"
# what a temporal request depends on, beside its version
COMPONENTS = [
    "source_asset_id", "event_id", "query_id", "grounding_target_id", "required_at", "identity_sha256", "predicate_sha256", "catalog_sha256", "prompt_sha256",
    "system_instruction_sha256", "response_schema_sha256", "task_instruction_sha256", "generation_config_sha256", "model_id",
]


def _fields(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in sorted(columns)])


def _children(order: str, columns: list[str]) -> Column:
    """The child rows of a group in order, as an array of structs with sorted fields."""
    return F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), _fields(columns).alias("_row"))))["_row"]


def track_fingerprints(samples: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, track_sha256) over the given columns of a track's samples, in order of sample_index.

    Each sample is hashed in its row first, so that only a hash of it is gathered per track.
    """
    s = samples.withColumn("_h", json_sha256(_fields(columns)))
    rows = F.array_sort(F.collect_list(F.struct("sample_index", "_h")))
    return s.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["_h"]), "|"), 256).alias("track_sha256"))


def segment_fingerprints(segments: DataFrame) -> DataFrame:
    """segments with variant_sha256: source, interval, filter graph, geometry and track (null: none) of a rendered segment."""
    body = ["contract_version", "source_sha256", "start_ms", "end_ms", "filter_graph", "geometry", "track_fingerprint"]
    return segments.withColumn("contract_version", F.lit(SEGMENT_VERSION)).withColumn("variant_sha256", json_sha256(_fields(body))).drop("contract_version")


def plan_fingerprints(chapters: DataFrame) -> DataFrame:
    """(project_id, catalog_id, plan_sha256) over the selections alone: feature, evidence status and both frames of each chapter, in order of pos."""
    rows = _children("pos", ["feature_id", "evidence_status", "horizontal_frame_id", "vertical_frame_id"])
    g = chapters.groupBy("project_id", "catalog_id").agg(rows.alias("chapters"))
    return g.select("project_id", "catalog_id", json_sha256(_fields(["project_id", "catalog_id", "chapters"])).alias("plan_sha256"))


def dense_fingerprints(frames: DataFrame) -> DataFrame:
    """(source_asset_id, event_id, catalog_sha256) over the frames of a dense catalog in order of pos; paths and the time of making don't count."""
    heads = ["source_asset_id", "event_id", "sampling_fps", "source_start_ms", "source_end_ms", "contact_sheet_hashes"]
    rows = _children("pos", ["frame_id", "event_id", "requested_time_ms", "frame_time_ms", "frame_pts", "frame_hash", "width", "height", "transport_image_hash"])
    # groups of many keys are told apart by sorting: the event first, which few of them share
    g = frames.groupBy("event_id", *[c for c in heads if c != "event_id"]).agg(rows.alias("frames"))
    return g.select("source_asset_id", "event_id", json_sha256(_fields([*heads, "frames"])).alias("catalog_sha256"))


def temporal_requests(requests: DataFrame) -> DataFrame:
    """requests with request_sha256 over all COMPONENTS, and rule: what keeps a request from having a key.

    requests: COMPONENTS, and target_ids and participant_ids of the lock (null: no predicate). Framing, approval and paths don't count.
    """
    target = F.col("grounding_target_id")
    rule = (
        F.when(F.col("participant_ids").isNull(), "no_predicate").when(~F.array_contains("target_ids", target), "unknown_target")
        .when(~F.array_contains("participant_ids", target), "not_a_participant").when(F.col("catalog_sha256").isNull(), "no_catalog")
    )
    keyed = requests.withColumn("protocol_version", F.lit(TEMPORAL_VERSION)).withColumn("rule", rule)
    key = F.when(F.col("rule").isNull(), json_sha256(_fields(["protocol_version", *COMPONENTS])))
    return keyed.withColumn("request_sha256", key).drop("protocol_version")


def temporal_contract() -> Column:
    """Hash of the lock's fields that can change what a temporal result means."""
    return json_sha256(_fields(["query_id", "grounding_target_id", "identity_sha256", "predicate_sha256"]))
