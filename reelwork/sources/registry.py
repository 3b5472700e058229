"""Files: readers of JSON artifacts, the media registry, identities, duplicates, probes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SUFFIXES = ("mp4", "mov", "m4v")


def read_artifacts(spark: SparkSession, root: str, glob: str, schema: StructType | str) -> DataFrame:
    """JSON documents below root whose names match, with their path; a document that breaks the schema fails the job."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(root).select("*", F.col("_metadata.file_path").alias("path"))


BROKEN = "_broken"


def check_artifacts(spark: SparkSession, root: str, glob: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(documents, violations): what read_artifacts gives for the documents that fit the schema, and (path, rule, content) of the others.

    A document is one file with one object. It breaks the schema if it is no such thing or if a field has another type; unknown
    fields are left out and missing ones are null, as in read_artifacts. An empty file is no document and not seen.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_broken = StructType([*fields.fields, StructField(BROKEN, StringType())])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    text = F.btrim(F.col("value"), F.lit(" \t\r\n"))
    read = files.select(F.from_json("value", with_broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("d"), text.alias("text"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    fits = F.col("d").isNotNull() & F.col(f"d.{BROKEN}").isNull() & text.startswith("{")
    rule = F.when(F.try_parse_json("text").isNull(), "no_json").otherwise("schema")
    return read.where(fits).select(*[F.col(f"d.`{f.name}`") for f in fields], "path"), read.where(~fits).select("path", rule.alias("rule"), "content")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, modified) of the files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", "content", F.col("modificationTime").alias("modified"))


def media_registry(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, first: int | None = None) -> DataFrame:
    """files of supported suffixes with their name; with first, that many in order of lower-case name, then path."""
    name = F.element_at(F.split("path", "/"), -1)
    f = files.withColumn("name", name).where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes))
    return f if first is None else f.orderBy(F.lower("name"), "path").limit(first)


def content_identity(files: DataFrame) -> DataFrame:
    """files with asset_id ('sha256:' and the content's hash) and a key of 16 hex digits."""
    h = F.sha2(F.col("content").cast("binary"), 256)
    return files.withColumn("asset_id", F.concat(F.lit("sha256:"), h)).withColumn("short_key", F.substring("asset_id", 8, 16))


def dedupe_assets(registry: DataFrame) -> DataFrame:
    """(path, asset_id, status, canonical_path): the first file of an asset in order of path wins."""
    first = registry.groupBy("asset_id").agg(F.min("path").alias("canonical_path"))
    status = F.when(F.col("path") == F.col("canonical_path"), "accepted").otherwise("duplicate_skipped")
    return registry.join(first, "asset_id").select("path", "asset_id", status.alias("status"), "canonical_path", "duration_ms")


def library_totals(deduped: DataFrame) -> DataFrame:
    own = F.col("status") == "accepted"
    return deduped.agg(F.count("*").alias("inputs"), F.count_if(own).alias("unique_assets"), F.count_if(~own).alias("duplicates"), F.sum(F.when(own, F.col("duration_ms")).otherwise(0)).alias("duration_ms"))


def split_public_private(index: DataFrame, hidden: tuple[str, ...] = ("path", "name")) -> tuple[DataFrame, DataFrame]:
    return index.drop(*hidden), index


def catalog_fingerprint(clips: DataFrame, by: list[str]) -> DataFrame:
    """(by, catalog_id): a hash over the clip lines in order."""
    lines = F.array_sort(F.collect_list(F.concat_ws("|", "path", F.col("duration_ms").cast("string"))))
    return clips.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("catalog_id"))


def rational(text: Column) -> Column:
    """A struct (numerator, denominator) from 'a/b'; null for 0/0, N/A and what is not positive."""
    parts = F.split(text, "[:/]")
    n, d = parts[0].try_cast("bigint"), F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(1))
    return F.when((n > 0) & (d > 0), F.struct(n.alias("numerator"), d.alias("denominator")))


def normalize_probe(probes: DataFrame, schema: str = "struct<width:int,height:int,rotate:string,side_rotation:double,sar:string,duration:double,rate:string>") -> DataFrame:
    """probes (id, probe) as display size, rotation, aspect ratio of a sample, rate and duration.

    A rotation tag goes before side data; 90 and 270 degrees swap the sides and invert the ratio.
    """
    p = probes.withColumn("p", F.from_json("probe", schema))
    rotation = F.pmod(F.coalesce(F.col("p.rotate").try_cast("int"), F.col("p.side_rotation").cast("int"), F.lit(0)), F.lit(360))
    sar = F.coalesce(rational(F.col("p.sar")), F.struct(F.lit(1).cast("long").alias("numerator"), F.lit(1).cast("long").alias("denominator")))
    p = p.withColumns({"rotation": rotation, "_sar": sar, "_rate": rational(F.col("p.rate"))})
    turned = F.col("rotation").isin(90, 270)
    return p.select(
        "id", "rotation", F.when(turned, F.col("p.height")).otherwise(F.col("p.width")).alias("display_width"), F.when(turned, F.col("p.width")).otherwise(F.col("p.height")).alias("display_height"),
        F.when(turned, F.col("_sar.denominator")).otherwise(F.col("_sar.numerator")).alias("sar_num"), F.when(turned, F.col("_sar.numerator")).otherwise(F.col("_sar.denominator")).alias("sar_den"),
        F.col("_rate.numerator").alias("rate_num"), F.col("_rate.denominator").alias("rate_den"), F.bround(F.col("p.duration") * 1000, 0).cast("long").alias("duration_ms"),
    )


def append_attempts(attempts: DataFrame, folder: str) -> None:
    """Every paid response is kept: rows are only ever added."""
    attempts.write.mode("append").parquet(folder)
