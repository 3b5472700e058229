"""Views that stand for the engine's tables on the driver's tables.

Each is plain SQL in the part that Spark and DuckDB share; {ms} and {sha} stand for the two
expressions that are spelt differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MS = {"spark": "unix_millis(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)//1000"}
SHA = {"spark": "sha2({0}, 256)", "duckdb": "sha256({0})"}

_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) x"


def _region(r: int) -> str:
    """The boxes of one region of each series: two that must be seen, of which every third series has one, and one that may be cut."""
    shift = (0, 20, 150)[r]
    return f"""SELECT track_id AS series, {r} AS region, sample_index, sample_index * 200 + sample_index % 3 AS t_ms,
        CASE WHEN track_id % 11 = 3 AND components = {r + 2} THEN 'low_confidence' WHEN track_id % 6 = 2 AND components < 3 THEN 'lost' WHEN components = 6 AND sample_index % 2 = {r % 2} AND track_id % 4 = 1 THEN 'lost' ELSE 'tracked' END AS state,
        track_id * 37 % 600 + {shift} + x_min % (4 + track_id % 5 * 15) AS x_min, track_id * 53 % 200 + {15 * r} + y_min % (4 + track_id % 4 * 10) AS y_min,
        least(1000, track_id * 37 % 600 + {shift + 60} + track_id % 8 * 45 + x_min % (4 + track_id % 5 * 15)) AS x_max, least(1000, track_id * 53 % 200 + {15 * r + 200} + track_id % 7 * 120 + y_min % (4 + track_id % 4 * 10)) AS y_max
        FROM d_sample{("", " WHERE track_id % 3 <> 0", " WHERE track_id % 4 = 1")[r]}"""


VIEWS: dict[str, str] = {
    "a_usage": """SELECT concat('run-', l_suppkey, '/', CASE WHEN l_linenumber % 3 = 0 THEN 'attempts/' WHEN l_linenumber % 5 = 0 THEN 'attempt-1/' ELSE '' END, l_orderkey, '-', l_linenumber, '-', l_partkey, '.raw_interaction.json') AS path,
        concat(l_partkey % 97, '|', CAST(l_quantity AS INT)) AS payload, CASE WHEN l_returnflag = 'R' THEN 'm-a' ELSE 'm-b' END AS model,
        CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS cached_tokens,
        CAST(l_quantity AS BIGINT) * 10 AS output_tokens, CAST(l_linenumber * 5 AS BIGINT) AS thought_tokens, l_partkey % 50 <> 0 AS has_usage FROM lineitem""",
    "b_points": "SELECT user_id AS asset_id, event_id, event_type, {ms} - 1704067200000 AS t_ms, value AS score, CAST(2592000000 AS BIGINT) AS duration_ms FROM events",
    "b_boundary": "SELECT asset_id, t_ms, score, event_id AS pos, duration_ms FROM b_points WHERE event_type = 'error'",
    "b_event": """SELECT asset_id, event_id, t_ms AS start_ms, least(t_ms + 60000 + event_id % 7 * 600000, duration_ms) AS end_ms,
        CASE WHEN event_id % 2 = 0 THEN t_ms + 30000 END AS keyframe_ms, duration_ms FROM b_points WHERE event_type = 'purchase'""",
    "c_box": f"""SELECT l_orderkey AS asset_id, rn % 3 AS run_id, rn AS event_id, l_partkey AS entity_id, l_returnflag AS kind, p_name AS label,
        l_partkey % 700 AS x_min, l_suppkey * 7 % 700 AS y_min, l_partkey % 700 + 1 + CAST(l_quantity AS INT) * 5 AS x_max, l_suppkey * 7 % 700 + 1 + l_linenumber * 30 AS y_max,
        CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 1 END AS n_candidates, l_partkey % 17 <> 0 AS visible, rn * 1000 + l_partkey % 300 AS frame_time_ms
        FROM {_LINES} JOIN part ON l_partkey = p_partkey""",
    "d_sample": """SELECT asset_id AS track_id, row_number() OVER (PARTITION BY asset_id ORDER BY t_ms, event_id) - 1 AS sample_index, t_ms,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 0.0 ELSE score / 1000 END AS area_ratio, event_id % 7 AS components, CAST(event_id % 100 AS DOUBLE) / 100 AS probability,
        event_id * 37 % 600 AS x_min, event_id * 53 % 600 AS y_min, event_id * 37 % 600 + 100 + event_id % 200 AS x_max, event_id * 53 % 600 + 100 + event_id % 150 AS y_max, 20 AS seed_index FROM b_points""",
    "d_crop": " UNION ALL ".join(map(_region, range(3))),
    "e_candidate": f"""SELECT l_orderkey AS chapter, concat('c', rn) AS candidate_id, rn AS rank, l_discount * 10 AS confidence, l_partkey % 11 <> 0 AS lineage_ok, l_suppkey % 13 <> 0 AS single_shot,
        CASE WHEN l_partkey % 23 = 0 THEN 'not_visible' WHEN l_returnflag = 'A' THEN 'matched' WHEN l_returnflag = 'N' THEN 'not_revalidated' ELSE 'ambiguous' END AS semantic_status, l_partkey % 5 <> 0 AS confidence_ok, l_partkey % 6 <> 0 AS coverage_ok,
        CASE rn % 3 WHEN 0 THEN 'hard_core' WHEN 1 THEN 'soft_extent' ELSE 'overlay_keepout' END AS role, l_partkey % 10 = 0 AS atomic, 1 - l_tax AS min_visible,
        CASE l_suppkey % 3 WHEN 0 THEN 'overlay_keepout' WHEN 1 THEN 'hard_core' ELSE 'soft_extent' END AS role2, l_suppkey % 7 <> 0 AS assessed2, CASE WHEN l_suppkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS min_visible2, CASE WHEN l_partkey % 4 = 0 THEN 0.2 ELSE 0.0 END AS overlap2,
        CASE l_partkey % 17 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS checkpoints_ok, CAST(l_partkey % 400 AS DOUBLE) * 2 AS max_speed, CAST(l_suppkey % 100 AS DOUBLE) * 20 AS max_acceleration, CAST(l_partkey % 90 AS DOUBLE) * 82 AS max_jerk,
        concat('g', l_partkey) AS geometry_fingerprint, CASE WHEN l_partkey % 19 = 0 THEN concat('h', l_partkey) ELSE concat('g', l_partkey) END AS expected_fingerprint,
        CASE WHEN l_quantity < 5 THEN 'fit_with_background' WHEN l_quantity < 8 THEN 'center_crop' ELSE 'tracked_crop' END AS strategy, l_partkey AS frame_id, l_suppkey AS source_id FROM {_LINES}""",
    "f_text": "SELECT l_orderkey AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, concat(' ', lower(l_returnflag), '-', l_linestatus) AS relevant_text FROM lineitem",
    "g_segment": """SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey AS feature_id, 3000 + CAST(floor(o_totalprice) AS BIGINT) % 7000 AS duration_ms,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'hook' WHEN '5-LOW' THEN 'closing' ELSE 'action' END AS editorial_role, o_orderstatus <> 'F' AS keep FROM orders""",
    "h_frame": """SELECT l_orderkey AS event_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 7007 AS frame_pts, 1 AS tb_num, 30000 AS tb_den, {sha_frame} AS frame_hash FROM lineitem""",
    "i_review": """SELECT conv_id AS session_id, CAST(floor(turn / 2) AS BIGINT) AS moment_id, conv_id % 5 AS target_id, role AS grounding_method, length(text) % 4 <> 0 AS reviewed,
        length(text) % 500 AS x_min, turn * 20 % 500 AS y_min, length(text) % 500 + 200 AS x_max, turn * 20 % 500 + 200 AS y_max FROM conversations""",
    "j_target": "SELECT conv_id AS query_id, turn AS target_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_target_id, text AS target_description FROM conversations",
    "k_file": "SELECT concat(source, '/', doc_id, '.txt') AS path, text AS content, n_chars AS duration_ms FROM documents",
    "l_json": "SELECT event_id, props FROM events",
}
_NEEDS = {"b_boundary": ["b_points"], "b_event": ["b_points"], "d_sample": ["b_points"], "d_crop": ["b_points", "d_sample"]}
_TABLES = ("lineitem", "orders", "part", "events", "documents", "conversations")


def _text(name: str, engine: str) -> str:
    return VIEWS[name].replace("{ms}", MS[engine]).replace("{sha_frame}", SHA[engine].format("concat(l_orderkey, '-', l_linenumber, '-', l_partkey)"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of sf_dir."""
    text, frames = _text(name, "spark"), {}
    for need in _NEEDS.get(name, []):
        frames[need] = view(spark, sf_dir, need)
    for table in _TABLES:
        if f"FROM {table}" in text or f"JOIN {table}" in text:
            frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for each in frames:
        text = text.replace(f"FROM {each}", f"FROM {{{each}}}").replace(f"JOIN {each}", f"JOIN {{{each}}}")
    return spark.sql(text, **frames)


def common_tables(names: list[str]) -> str:
    """The views as the WITH clause of a DuckDB statement, to go on with more of them or a SELECT."""
    order: list[str] = []
    for name in names:
        order += [x for x in [*_NEEDS.get(name, []), name] if x not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_text(n, 'duckdb')})" for n in order)
