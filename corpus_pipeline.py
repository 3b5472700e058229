"""A corpus from documents: quality rules, near duplicates, benchmark leaks, mixing, shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.decontaminate import benchmark_leaks
from reelwork.llm.mixing import mix_sources
from reelwork.llm.neardup import near_duplicates
from reelwork.llm.quality import base_failed, quality_signals, repetitive
from reelwork.llm.sharding import shard_documents
from reelwork.llm.shared import drop_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a null text has too few words. Repeated rows all stay or all go."""
    found = quality_signals(docs, COLUMNS)
    return found.where(~base_failed() & ~repetitive()).select(*COLUMNS)


def with_row(docs: DataFrame) -> DataFrame:
    """COLUMNS, and _row: a hash of them all, so rows without a doc_id, or of one doc_id with several texts, stay apart; equal rows share it."""
    return docs.select(*COLUMNS, F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]).alias("_row"))


def _as_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("doc_id"), "source", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id, null last; one if it is repeated."""
    rows = with_row(docs)
    found = near_duplicates(_as_id(rows)).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    kept = rows.select("doc_id", "_row").join(found, "_row").groupBy("component_id").agg(F.min(place).alias("x")).select(F.col("x._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whether they have a doc_id or not; repeated rows all stay or all go, and null texts stay."""
    rows = with_row(docs)
    leaks = benchmark_leaks(_as_id(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaks, "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document that the mix takes; a copy in service at the end counts.

    A document that gives w words of its size s to the mix stands ceil(w / s) times; one without
    words is not taken. Repeated rows count as so many documents.
    """
    rows = with_row(docs)
    taken = mix_sources(_as_id(rows)).where("taken > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    mine = rows.dropDuplicates(["_row"]).join(taken, "_row")
    return mine.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each row: doc_id, size, text_crc32, shard, slot, virtual_slot. Repeated rows each have a place; null ids and texts are placed too."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of sf_dir; each one's rows are written to the shared folder and read again.

    What a stage has written is dropped once the next one has run; the last one's rows stay.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_folder(spark, before)
        before = path
    return docs
