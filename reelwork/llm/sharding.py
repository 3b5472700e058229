"""Shards by fixed virtual slots and a versioned map from slots to shards.

A record hashes into one of a few thousand slots, for good. Bytes are summed per slot, and a
map (version, slot, shard) says which shard holds a slot. The map is stored; a later run reads
its newest version and, where shards have become uneven, adds one that moves whole slots. Equal
texts share a slot; only a group of them that is larger than a shard is dealt over the slots, by
doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.llm.shared import bounded, documents, keep, shared_folder

SHARDS = 24
SLOTS = 4096
OVERHEAD_BYTES = 8
#: A stored map is edited once a shard holds this many times the mean.
UNEVEN = 1.02
#: Records of a slot that one task numbers, about.
RECORDS_PER_PART = 200_000


def sized_records(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, and a 64-bit hash of the text; a null text has no bytes."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(body).cast("long") + OVERHEAD_BYTES).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"))


def with_slots(records: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """records with their virtual slot.

    A group of equal texts that is larger than a shard (fewer than n_shards can be) is dealt over the slots: no map could make
    shards near equal in bytes around it. With 24 shards that is a group of over 4.2 % of all bytes.
    """
    total = records.agg((F.sum("size") / n_shards).alias("shard_bytes"))
    groups = records.groupBy("text_hash", "text_crc32").agg(F.sum("size").alias("bytes"))
    large = groups.crossJoin(F.broadcast(total)).where("bytes > shard_bytes").select("text_hash", "text_crc32", F.lit(True).alias("large"))
    marked = records.join(F.broadcast(large), ["text_hash", "text_crc32"], "left")
    return marked.withColumn("virtual_slot", F.pmod(F.when(F.col("large"), F.xxhash64(F.lit(11), "doc_id", "text_hash")).otherwise(F.xxhash64(F.lit(13), "text_hash")), F.lit(n_slots))).drop("large")


def slot_loads(slotted: DataFrame) -> DataFrame:
    """virtual_slot, bytes, records: at most as many rows as there are slots."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _dealt(slots: DataFrame, held: DataFrame, n_shards: int) -> DataFrame:
    """(virtual_slot, shard): each of slots (virtual_slot, bytes), the largest first, goes to the shard with the fewest bytes; held (shard, bytes) is there already."""
    listed = slots.agg(F.sort_array(F.collect_list(F.struct(F.col("bytes"), F.col("virtual_slot"))), asc=False).alias("slots"))
    loads = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("held"))
    zero = F.lit(0).cast("long")
    begin = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.coalesce(F.try_element_at("held", k), zero))
    empty = F.struct(begin.alias("load"), F.expr("cast(array() as array<int>)").alias("chosen"))

    def give(state: Column, slot: Column) -> Column:
        low = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda x, i: x + F.when(i == low - 1, slot["bytes"]).otherwise(zero))
        return F.struct(load.alias("load"), F.array_append(state["chosen"], low - 1).alias("chosen"))

    made = listed.crossJoin(F.broadcast(loads)).withColumn("chosen", F.aggregate("slots", empty, give, lambda s: s["chosen"]))
    pairs = made.select(F.explode(F.arrays_zip("slots", "chosen")).alias("x"))
    return pairs.select(F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.chosen").alias("shard"))


def first_map(loads: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard)."""
    none = loads.limit(0).select(F.lit(0).alias("shard"), "bytes")
    return _dealt(loads.select("virtual_slot", "bytes"), none, n_shards).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def rebalanced_map(current: DataFrame, loads: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The next version of the map: shards keep slots (in hash order) up to the mean of bytes, the others move, and slots that are new are dealt too."""
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = loads.select("virtual_slot", "bytes").join(current.select("virtual_slot", "shard"), "virtual_slot", "left")
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", F.xxhash64("virtual_slot")))
    marked = keep(sized.withColumn("stays", F.col("shard").isNotNull() & (running <= F.sum("bytes").over(every) / n_shards)))
    stays = marked.where("stays")
    moved = _dealt(marked.where("not stays"), stays.groupBy("shard").agg(F.sum("bytes").alias("bytes")), n_shards)
    version = current.agg((F.max("version") + 1).alias("version"))
    return stays.select("virtual_slot", "shard").unionByName(moved).crossJoin(F.broadcast(version)).select("version", "virtual_slot", "shard")


def newest_map(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version of the map that is stored in folder; None if there is none."""
    try:
        stored = spark.read.schema("virtual_slot long, shard int, version int").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest) if newest is not None else None


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Adds the map's version to those in folder; none is changed."""
    slot_map.select(F.col("virtual_slot").cast("long"), F.col("shard").cast("int"), F.col("version").cast("int")).coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def current_map(loads: DataFrame, n_shards: int, folder: str) -> DataFrame:
    """The stored map for loads; made where there is none, and edited where a slot is new or uneven shards can be made more even."""
    spark = loads.sparkSession
    held = newest_map(spark, folder)
    if held is None:
        store_map(first_map(loads, n_shards), folder)
    else:
        per_shard = loads.join(held, "virtual_slot", "left").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
        state = per_shard.agg(F.max(F.col("shard").isNull()).alias("new"), F.max("bytes").alias("most"), (F.sum("bytes") / n_shards).alias("mean")).first()
        if state["most"] is not None and (state["new"] or state["most"] > UNEVEN * state["mean"]):
            edited = keep(rebalanced_map(held, loads, n_shards))
            most = edited.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0]
            if state["new"] or most < state["most"]:
                store_map(edited, folder)
    return newest_map(spark, folder) or first_map(loads, n_shards)


def grown_map(current: DataFrame, loads: DataFrame) -> DataFrame:
    """The next version of the map, with one more shard, which takes slots only into itself.

    Every shard keeps its first slots (in hash order) up to the new mean of bytes; the new
    shard gets the others.
    """
    per_shard = W.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = current.join(loads, "virtual_slot")
    n = F.max("shard").over(every) + 1
    mean = F.sum("bytes").over(every) / (n + 1)
    moved = F.sum("bytes").over(per_shard) > mean
    return sized.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moved, n).otherwise(F.col("shard")).cast("int").alias("shard"))


def assigned(slotted: DataFrame, slot_map: DataFrame, loads: DataFrame, per_part: int = RECORDS_PER_PART) -> DataFrame:
    """Each record with its shard and its place in it (from 0, without gaps).

    Places run through the shard's virtual slots, and through the parts of a slot: a slot of more than per_part records is
    dealt by a hash of its records, so a task numbers about per_part of them whatever a slot holds.
    """
    n_parts = loads.select("virtual_slot", (F.floor(F.col("records") / per_part) + 1).alias("n_parts"))
    parted = slotted.join(F.broadcast(n_parts), "virtual_slot").withColumn("part", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text_hash"), F.col("n_parts"))).drop("n_parts")
    counts = parted.groupBy("virtual_slot", "part").agg(F.count("*").alias("records")).join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    base = keep(counts.select("virtual_slot", "part", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("base")))
    within = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_hash", "size")) - 1
    return parted.withColumn("within", within).join(bounded(base), ["virtual_slot", "part"]).withColumn("slot", F.col("base") + F.col("within")).drop("base", "within", "part")


def shard_documents(docs: DataFrame, text: str = "text", n_shards: int = SHARDS, n_slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, virtual_slot.

    Shards get near equal bytes. Null texts count 8 bytes and share the slot of empty ones.
    Repeated rows each have a place. The map is kept in folder, by default a new one in the
    shared folder; it has n_slots rows at most, so it is broadcast.
    """
    slotted = keep(with_slots(keep(sized_records(docs, text)), n_shards, n_slots))
    loads = keep(slot_loads(slotted))
    chosen = current_map(loads, n_shards, folder or f"{shared_folder(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}")
    return assigned(slotted, chosen, loads).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot")


def op5_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
