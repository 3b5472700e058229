"""Hashes of what results depend on, and cache keys (views d_crop, g_segment, h_frame, j_target)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwork.operators import fingerprints as P
from reelwork.operators.locks import reusable, target_hashes
from reelwork.plans.base import query
from reelwork.plans.locks import HASHES

_TRACKED = ["sample_index", "t_ms", "state", "x_min", "y_min", "x_max", "y_max"]
_TRACKS = """
, tracks AS (SELECT series, region, sha256(string_agg(sha256(to_json({sample_index: sample_index, state: state, t_ms: t_ms, x_max: x_max, x_min: x_min, y_max: y_max, y_min: y_min})), '|' ORDER BY sample_index)) AS track_sha256 FROM d_crop GROUP BY series, region)"""


@query("f35_track_fingerprint", "d_crop", sql=_TRACKS + " SELECT * FROM tracks")
def _f35t(crops):
    return P.track_fingerprints(crops, ["series", "region"], _TRACKED)


@query("f35_segment_fingerprint", "d_crop", sql=_TRACKS + """
SELECT series, region, sha256(to_json({contract_version: 'feature-segment-render-v2', end_ms: 9000 + series, filter_graph: 'crop=' || region, geometry: {x: series % 9, y: region}, source_sha256: sha256(concat('source-', series)), start_ms: series * 10, track_fingerprint: CASE WHEN series % 4 <> 0 THEN track_sha256 END})) AS variant_sha256 FROM tracks""")
def _f35s(crops):
    t = P.track_fingerprints(crops, ["series", "region"], _TRACKED)
    segments = t.select(
        "series", "region", F.sha2(F.concat(F.lit("source-"), F.col("series")), 256).alias("source_sha256"), (F.col("series") * 10).alias("start_ms"), (9000 + F.col("series")).alias("end_ms"), F.concat(F.lit("crop="), F.col("region")).alias("filter_graph"),
        F.struct((F.col("series") % 9).alias("x"), F.col("region").alias("y")).alias("geometry"), F.when(F.col("series") % 4 != 0, F.col("track_sha256")).alias("track_fingerprint"),
    )
    return P.segment_fingerprints(segments).select("series", "region", "variant_sha256")


@query("f35_plan_fingerprint", "g_segment", sql="""
SELECT project_id, 'catalog' AS catalog_id, sha256(to_json({catalog_id: 'catalog', chapters: list({evidence_status: CASE WHEN keep THEN 'supported' ELSE 'weak' END, feature_id: feature_id, horizontal_frame_id: CASE WHEN keep THEN 'h' || pos END, vertical_frame_id: 'v' || pos} ORDER BY pos), project_id: project_id})) AS plan_sha256 FROM g_segment GROUP BY project_id""")
def _f35p(g):
    name = lambda p: F.concat(F.lit(p), F.col("pos"))
    return P.plan_fingerprints(g.select("project_id", F.lit("catalog").alias("catalog_id"), "pos", "feature_id", F.when(F.col("keep"), "supported").otherwise("weak").alias("evidence_status"), F.when(F.col("keep"), name("h")).alias("horizontal_frame_id"), name("v").alias("vertical_frame_id")))


_CATALOG = """
, dense AS (SELECT concat('asset-', event_id % 7) AS source_asset_id, event_id, sha256(to_json({contact_sheet_hashes: ['sheet'], event_id: event_id, frames: list({event_id: event_id, frame_hash: frame_hash, frame_id: 'DF' || pos, frame_pts: frame_pts, frame_time_ms: pos * 33, height: 1080, requested_time_ms: pos * 30,
    transport_image_hash: CASE WHEN pos % 2 = 0 THEN frame_hash END, width: 1920} ORDER BY pos), sampling_fps: 8, source_asset_id: concat('asset-', event_id % 7), source_end_ms: 9000, source_start_ms: 0})) AS catalog_sha256 FROM h_frame GROUP BY event_id)"""


def _catalog(h):
    frames = h.select(
        F.concat(F.lit("asset-"), F.col("event_id") % 7).alias("source_asset_id"), "event_id", F.lit(8).alias("sampling_fps"), F.lit(0).alias("source_start_ms"), F.lit(9000).alias("source_end_ms"), F.array(F.lit("sheet")).alias("contact_sheet_hashes"), "pos",
        F.concat(F.lit("DF"), F.col("pos")).alias("frame_id"), (F.col("pos") * 30).alias("requested_time_ms"), (F.col("pos") * 33).alias("frame_time_ms"), "frame_pts", "frame_hash", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.when(F.col("pos") % 2 == 0, F.col("frame_hash")).alias("transport_image_hash"),
    )
    return P.dense_fingerprints(frames)


@query("f35_dense_fingerprint", "h_frame", sql=_CATALOG + " SELECT * FROM dense")
def _f35d(h):
    return _catalog(h)


_REQUESTS = HASHES + _CATALOG + """
, q AS (SELECT query_id, list(concat('t', target_id) ORDER BY target_id) AS target_ids FROM j_target GROUP BY query_id)
, r AS (SELECT h.query_id, h.query_id AS event_id, concat('asset-', h.query_id % 7) AS source_asset_id, CASE WHEN h.target_id % 9 = 8 THEN 'other' ELSE concat('t', h.target_id) END AS grounding_target_id, CASE WHEN h.target_id % 2 = 0 THEN 'seed' ELSE 'interval' END AS required_at,
    identity_sha256, sha256(concat('p', h.query_id)) AS predicate_sha256, catalog_sha256, 'm-' || (h.target_id % 3) AS model_id, target_ids, CASE WHEN h.query_id % 5 <> 0 THEN target_ids[1:4] END AS participant_ids FROM hashes h JOIN q USING (query_id) LEFT JOIN dense ON dense.event_id = h.query_id)
, k AS (SELECT *, CASE WHEN participant_ids IS NULL THEN 'no_predicate' WHEN NOT list_contains(target_ids, grounding_target_id) THEN 'unknown_target' WHEN NOT list_contains(participant_ids, grounding_target_id) THEN 'not_a_participant' WHEN catalog_sha256 IS NULL THEN 'no_catalog' END AS rule FROM r)
, keyed AS (SELECT query_id, grounding_target_id, rule, sha256(to_json({grounding_target_id: grounding_target_id, identity_sha256: identity_sha256, predicate_sha256: predicate_sha256, query_id: query_id})) AS contract_sha256,
    CASE WHEN rule IS NULL THEN sha256(to_json({catalog_sha256: catalog_sha256, event_id: event_id, generation_config_sha256: sha256('generation'), grounding_target_id: grounding_target_id, identity_sha256: identity_sha256, model_id: model_id, predicate_sha256: predicate_sha256, prompt_sha256: sha256('prompt'), protocol_version: 'query-temporal-refinement-v1',
    query_id: query_id, required_at: required_at, response_schema_sha256: sha256('schema'), source_asset_id: source_asset_id, system_instruction_sha256: sha256('system'), task_instruction_sha256: sha256('task')})) END AS request_sha256 FROM k)"""


def _requests(t, h):
    targets = t.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("target_id")), lambda x: F.concat(F.lit("t"), x)).alias("target_ids"))
    fixed = {f"{n}_sha256": F.sha2(F.lit(v), 256) for n, v in (("generation_config", "generation"), ("prompt", "prompt"), ("response_schema", "schema"), ("system_instruction", "system"), ("task_instruction", "task"))}
    asked = t.select(F.col("query_id").alias("event_id")).distinct()  # a catalog that no request names needs no hash
    r = target_hashes(t).join(targets, "query_id").join(_catalog(h.join(asked, "event_id", "left_semi")).select(F.col("event_id").alias("query_id"), "catalog_sha256"), "query_id", "left")
    r = r.withColumns({
        "event_id": F.col("query_id"), "source_asset_id": F.concat(F.lit("asset-"), F.col("query_id") % 7), "grounding_target_id": F.when(F.col("target_id") % 9 == 8, "other").otherwise(F.concat(F.lit("t"), F.col("target_id"))), "required_at": F.when(F.col("target_id") % 2 == 0, "seed").otherwise("interval"),
        "predicate_sha256": F.sha2(F.concat(F.lit("p"), F.col("query_id")), 256), "model_id": F.concat(F.lit("m-"), F.col("target_id") % 3), "participant_ids": F.when(F.col("query_id") % 5 != 0, F.slice("target_ids", 1, 4)), **fixed,
    })
    return P.temporal_requests(r).withColumn("contract_sha256", P.temporal_contract())


@query("c15_temporal_fingerprint", "j_target", "h_frame", sql=_REQUESTS + " SELECT query_id, grounding_target_id, rule, contract_sha256, request_sha256 FROM keyed")
def _c15(t, h):
    return _requests(t, h).select("query_id", "grounding_target_id", "rule", "contract_sha256", "request_sha256")


@query("c15_temporal_reuse", "j_target", "h_frame", sql=_REQUESTS + " SELECT query_id, grounding_target_id, request_sha256, CASE WHEN query_id % 3 = 0 THEN 'hit' ELSE 'work' END AS kind FROM keyed WHERE rule IS NULL")
def _c15r(t, h):
    r = _requests(t, h).where("rule IS NULL").select("query_id", "grounding_target_id", "request_sha256")
    cache = r.select("request_sha256", (F.col("query_id") % 3 == 0).alias("complete"))
    hit, work = reusable(r, cache, ["request_sha256"])
    return hit.withColumn("kind", F.lit("hit")).unionByName(work.withColumn("kind", F.lit("work")))
