"""Files and raw JSON (views k and l)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.text import canonical_sha256, contract_id
from reelwork.operators.rounds import cut_lineage, drop_folder, new_folder
from reelwork.plans.base import query
from reelwork.sources import registry as S
from reelwork.streaming.artifacts import take_new_artifacts

_ID = ", ids AS (SELECT *, 'sha256:' || sha256(content) AS asset_id FROM k_file)"
_DEDUP = _ID + ", dedup AS (SELECT path, asset_id, duration_ms, min(path) OVER (PARTITION BY asset_id) AS canonical_path FROM ids)"


# documents of 100 events each, one a file; of seven, one is cut off and one has a run that is no number
_RUNS = ", runs AS (SELECT *, event_id // 100 AS run FROM l_json)"
_SCHEMA = "run long, events array<struct<event_id: long, props: struct<page: string, k: string>>>"


def _written(j):
    """The folder to which j's events have been written as documents of several lines."""
    run = F.floor(F.col("event_id") / 100)
    event = F.struct("event_id", F.from_json("props", "page string, k string").alias("props"))
    docs = j.groupBy(run.alias("run")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    number = F.when(F.col("run") % 7 == 5, F.concat(F.lit("run "), F.col("run").cast("string"))).otherwise(F.col("run").cast("string"))
    text = F.to_json(F.struct(number.alias("run"), "events"), {"pretty": "true"})
    text = F.when(F.col("run") % 7 == 5, text).otherwise(F.regexp_replace(text, '"run" : "([0-9]+)"', '"run" : $1'))
    folder = new_folder(j.sparkSession, "artifacts")
    docs = docs.select("run", F.when(F.col("run") % 7 == 3, F.substr(text, F.lit(1), F.length(text) - 20)).otherwise(text).alias("value"))
    # a file a document, without a folder for each: those would be listed one by one; files take the time, so all cores write
    dealt = docs.repartition(4 * j.sparkSession.sparkContext.defaultParallelism, "run").select("value")
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    return folder


@query("s1_read_artifacts", "l_json", sql=_RUNS + " SELECT event_id, props->>'$.page' AS page, props->>'$.k' AS k FROM runs WHERE run % 7 NOT IN (3, 5)")
def _s1(j):
    folder = _written(j)
    read, _ = S.check_artifacts(j.sparkSession, folder, "part-*", _SCHEMA)
    out = cut_lineage(read.select(F.explode("events").alias("e")).select("e.event_id", "e.props.page", "e.props.k"))
    drop_folder(j.sparkSession, folder)
    return out


@query("s1_broken_artifacts", "l_json", sql=_RUNS + " SELECT DISTINCT run, CASE run % 7 WHEN 3 THEN 'no_json' ELSE 'schema' END AS rule FROM runs WHERE run % 7 IN (3, 5)")
def _s1b(j):
    folder = _written(j)
    _, broken = S.check_artifacts(j.sparkSession, folder, "part-*", _SCHEMA)
    out = cut_lineage(broken.select(F.regexp_extract("content", '"run" : "?(?:run )?([0-9]+)', 1).cast("long").alias("run"), "rule"))
    drop_folder(j.sparkSession, folder)
    return out


@query("s7_artifact_stream", "k_file", sql="""
, d AS (SELECT CAST(regexp_extract(path, '([0-9]+)[.]txt', 1) AS BIGINT) AS doc, content FROM k_file)
SELECT doc // 50 AS bucket, sha256(string_agg(sha256(content), chr(10) ORDER BY doc) || chr(10)) AS sha256, (doc // 50) % 3 AS run FROM d GROUP BY 1""")
def _s7s(k):
    """A folder grows three times by files of 50 documents' hashes; each run takes the new ones.

    The files lie in one folder, as a folder for each would be listed by a task of its own in every run. A file's name says which partition wrote it
    and which of that partition's files it is; by both it is known which bucket it holds.
    """
    spark = k.sparkSession
    parts = 4 * spark.sparkContext.defaultParallelism
    doc = F.regexp_extract("path", "([0-9]+)[.]txt", 1).cast("long")
    files = k.select(doc.alias("doc"), F.sha2("content", 256).alias("hash")).groupBy(F.floor(F.col("doc") / 50).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("doc", "hash"))).alias("docs"))
    files = files.select("bucket", (F.col("bucket") % 3).alias("run"), F.floor(F.col("bucket") / 3 % parts).cast("int").alias("part"), F.array_join(F.transform("docs", lambda d: d["hash"]), "\n").alias("value"))
    files = cut_lineage(files.withColumn("place", F.row_number().over(W.partitionBy("run", "part").orderBy("bucket")) - 1))
    folder, out = new_folder(spark, "stream"), None
    for run in range(3):
        dealt = files.where(F.col("run") == run).repartitionById(parts, "part").sortWithinPartitions("place").select("value")
        dealt.write.mode("append").option("maxRecordsPerFile", 1).text(f"{folder}/files")
        taken = take_new_artifacts(spark, f"{folder}/files", "part-*", f"{folder}/state").withColumn("run", F.lit(run).cast("long"))
        out = taken if out is None else out.unionByName(taken)
    number = lambda group: F.regexp_extract("path", "part-([0-9]+)-[^/]*-c([0-9]+)[.]txt$", group).cast("int")
    named = out.select(number(1).alias("part"), number(2).alias("place"), "sha256", "run")
    out = cut_lineage(named.join(files.drop("value"), ["run", "part", "place"]).select("bucket", "sha256", "run"))
    drop_folder(spark, folder)
    return out


@query("f23_double_sha256", "a_usage", sql="""
, p AS (SELECT path, input_tokens * 12345.5 AS large, output_tokens / 8e7::DOUBLE AS little FROM a_usage)
SELECT path, sha256('{"large":' || large::DOUBLE || ',"little":' || little || ',"path":"' || path || '"}') AS sha256 FROM p""")
def _f23d(log):
    numbers = log.select("path", (F.col("input_tokens") * 12345.5).alias("large"), (F.col("output_tokens") / 8e7).alias("little"))
    return numbers.select("path", canonical_sha256("path", "large", "little").alias("sha256"))


@query("s2_media_registry", "k_file", sql="SELECT path, split_part(path, '/', -1) AS name FROM k_file")
def _s2(k):
    return S.media_registry(k, suffixes=("txt",)).select("path", "name")


@query("s3_content_identity", "k_file", sql=_ID + " SELECT path, asset_id, substring(asset_id, 8, 16) AS short_key FROM ids")
def _s3(k):
    return S.content_identity(k).select("path", "asset_id", "short_key")


@query("s4_dedupe_assets", "k_file", sql=_DEDUP + " SELECT path, asset_id, CASE WHEN path = canonical_path THEN 'accepted' ELSE 'duplicate_skipped' END AS status, canonical_path FROM dedup")
def _s4(k):
    return S.dedupe_assets(S.content_identity(k)).drop("duration_ms")


@query("s4_library_totals", "k_file", sql=_DEDUP + " SELECT count(*) AS inputs, count(*) FILTER (WHERE path = canonical_path) AS unique_assets, count(*) FILTER (WHERE path <> canonical_path) AS duplicates, sum(CASE WHEN path = canonical_path THEN duration_ms ELSE 0 END)::BIGINT AS duration_ms FROM dedup")
def _s4t(k):
    return S.library_totals(S.dedupe_assets(S.content_identity(k)))


_PROBE = """'{"width":' || (640 + event_id % 7 * 100) || ',"height":' || (360 + event_id % 5 * 10) || CASE event_id % 4 WHEN 0 THEN ',"rotate":"-90"' WHEN 1 THEN ',"side_rotation":180.0' ELSE '' END || ',"sar":"' || CASE event_id % 3 WHEN 0 THEN '4:3' WHEN 1 THEN '0:1' ELSE 'N/A' END || '","rate":"' || CASE event_id % 5 WHEN 0 THEN '0/0' ELSE '30000/1001' END || '","duration":' || (event_id % 1000) || '.25}'"""


@query("s5_normalize_probe", "l_json", sql="""
, p AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 270 WHEN 1 THEN 180 ELSE 0 END AS rotation, 640 + event_id % 7 * 100 AS w, 360 + event_id % 5 * 10 AS h, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END::BIGINT AS sn, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END::BIGINT AS sd FROM l_json)
SELECT id, rotation::BIGINT AS rotation, CASE WHEN rotation = 270 THEN h ELSE w END AS display_width, CASE WHEN rotation = 270 THEN w ELSE h END AS display_height, CASE WHEN rotation = 270 THEN sd ELSE sn END AS sar_num, CASE WHEN rotation = 270 THEN sn ELSE sd END AS sar_den,
    CASE WHEN id % 5 <> 0 THEN 30000::BIGINT END AS rate_num, CASE WHEN id % 5 <> 0 THEN 1001::BIGINT END AS rate_den, id % 1000 * 1000 + 250 AS duration_ms FROM p""")
def _s5(j):
    return S.normalize_probe(j.select(F.col("event_id").alias("id"), F.expr(_PROBE.replace("\\", "")).alias("probe")))


@query("s6_catalog_fingerprint", "k_file", sql="SELECT split_part(path, '/', 1) AS library, sha256(string_agg(path || '|' || duration_ms, chr(10) ORDER BY path || '|' || duration_ms)) AS catalog_id FROM k_file GROUP BY 1")
def _s6(k):
    return S.catalog_fingerprint(k.withColumn("library", F.split("path", "/")[0]), ["library"])


@query("s9_split_public_private", "k_file", sql=_ID + " SELECT asset_id, duration_ms FROM ids")
def _s9(k):
    return S.split_public_private(S.content_identity(k).select("path", "asset_id", "duration_ms"))[0]


@query("f22_contract_id", "k_file", sql="SELECT path, CASE WHEN regexp_full_match(v, '[a-zA-Z0-9][a-zA-Z0-9_.:-]*') THEN v ELSE 'asset-' || substring(sha256(v), 1, 16) END AS id FROM (SELECT path, trim(CASE duration_ms % 3 WHEN 0 THEN path WHEN 1 THEN ' id-' || duration_ms || ' ' ELSE 'id:' || duration_ms END) AS v FROM k_file)")
def _f22(k):
    d = F.col("duration_ms").cast("string")
    v = F.when(F.col("duration_ms") % 3 == 0, F.col("path")).when(F.col("duration_ms") % 3 == 1, F.concat(F.lit(" id-"), d, F.lit(" "))).otherwise(F.concat(F.lit("id:"), d))
    return k.select("path", contract_id(v, "asset").alias("id"))
