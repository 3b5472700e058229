"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served again from the start up
to MAX_REPEATS times, in quanta of a few words. A quantum's virtual finish time is the running
words of its source over the source's target. Quanta are sorted by that time into ranges over
all sources, and the mix ends where the running words of that order reach the budget.

Running sums are taken in two steps, within slots or ranges and over their totals, so a source
that holds most of the rows is spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.llm.shared import bounded, documents, keep, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words that a source is served at a time; a source ends within so many words of its share.
QUANTUM = 128
#: Hash slots of a source: the rows of a source are sorted in so many pieces.
SLOTS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources by code point, null last, take the weights in turn. A target stops at repeats
    times its source's size; the excess is shared by weight among the rest. With sources in
    order of size over weight, that is one level for all sources that stay below their cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(repeats)
    up = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    rest = up.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))).over(every)
    return leveled.select("source", "source_size", "weight", F.least(cap.cast("double"), F.coalesce(water, F.lit(0.0)) * F.col("weight")).alias("target"))


def _running(df: DataFrame, queue: list[Column], order: list[Column], amount: str, name: str) -> DataFrame:
    """df with the sum of amount over all rows before its own in its queue; rows must have a slot that sorts as order does."""
    slots = df.groupBy(*queue, "slot").agg(F.sum(amount).alias("_in_slot"))
    keys = [f"_k{i}" for i in range(len(queue))]
    over = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.select(*[q.alias(k) for q, k in zip(queue, keys, strict=True)], F.col("slot").alias("_slot"), "_in_slot").withColumn("_before", F.coalesce(F.sum("_in_slot").over(over), F.lit(0)))
    match = F.col("slot") == F.col("_slot")
    for q, k in zip(queue, keys, strict=True):
        match = match & q.eqNullSafe(F.col(k))
    within = W.partitionBy(*queue, "slot").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(slots, match).withColumn(name, F.col("_before") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return out.drop(*keys, "_slot", "_in_slot", "_before")


def quanta(docs: DataFrame, targets: DataFrame, budget: float | None = None, repeats: int = MAX_REPEATS, quantum: int = QUANTUM) -> DataFrame:
    """The quanta of words that may be served: doc_id, source, size, copy, quantum, words, finish_time, budget.

    docs has doc_id, source, size. Ties of the shuffle go by doc_id; equal rows take
    neighbouring places, and which is first makes no difference. budget defaults to the sum of
    the targets. What is served after the budget for sure is left out: by a virtual time V at
    least V times the targets, less a quantum of each source, has been served, and no source
    that is not capped runs out before.
    """
    shuffled = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))).withColumn("shuffle", F.xxhash64(F.lit(7), "doc_id"))
    queue = _running(shuffled, [F.col("source")], [F.col("shuffle"), F.col("doc_id"), F.col("size")], "size", "ahead")
    goal = targets.select(F.col("source").alias("_source"), "source_size", "target")
    free = F.when(F.col("target") < F.col("source_size") * repeats - 1e-6, F.col("target"))
    full = goal.agg(F.sum("target").alias("all_targets"), F.sum(free).alias("free_targets"), F.count("*").alias("n_sources"))
    share = F.lit(1.0) if budget is None else F.least(F.lit(1.0), F.lit(float(budget)) / F.col("all_targets"))
    full = full.select((share * F.col("all_targets")).alias("budget"), (share + F.col("n_sources") * quantum / F.col("free_targets") + 1e-6).alias("latest"))
    goal = goal.where("target > 0").crossJoin(F.broadcast(full))
    copies = queue.where("size > 0").join(bounded(goal), F.col("source").eqNullSafe(F.col("_source"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("copy") * F.col("source_size") + F.col("ahead")
    in_time = lambda words: F.coalesce(words / F.col("target") <= F.col("latest"), F.lit(True))
    served = copies.withColumn("start", start).where(in_time(F.col("start"))).withColumn("quantum", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / quantum))))
    words = F.least(F.lit(quantum).cast("long"), F.col("size") - F.col("quantum") * quantum)
    timed = served.withColumn("words", words).withColumn("finish_time", (F.col("start") + F.col("quantum") * quantum + F.col("words")) / F.col("target"))
    return timed.where(F.col("finish_time") <= F.coalesce("latest", F.lit(float("inf")))).select("doc_id", "source", "size", "copy", "quantum", "words", "finish_time", "budget")


def mixed(served: DataFrame) -> DataFrame:
    """quanta() in order of finish time, with position, the words before each, and taken, what the budget leaves of it.

    The order is cut into ranges; ties go by source, doc_id, copy and quantum.
    """
    order = ["finish_time", "source", "doc_id", "copy", "quantum"]
    ranged = keep(served.repartitionByRange(*order).withColumn("slot", F.spark_partition_id()))
    placed = _running(ranged, [], [F.col(c) for c in order], "words", "position")
    left = F.floor(F.col("budget") + F.lit(1e-6)) - F.col("position")
    return placed.withColumn("taken", F.greatest(F.lit(0), F.least("words", left)).cast("long")).where("taken > 0")


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """One row per document (doc_id, source, text): size, source_size, target, taken and first_position.

    A null or empty text has size 0 and takes nothing. A null source is a source of its own.
    Rows that share doc_id, source and size are one document that occurs several times, and
    share what they take evenly.
    """
    sized = keep(docs.select("doc_id", "source", word_count(F.col(f"`{text}`")).alias("size")))
    targets = keep(source_targets(sized, weights, repeats))
    taken = mixed(quanta(sized, targets, budget, repeats)).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("all_taken"), F.min("position").alias("first_position"))
    t = taken.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "all_taken", "first_position")
    g = targets.select(F.col("source").alias("_of"), "source_size", "target")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    held = W.partitionBy("doc_id", "source", "size")
    turn = F.row_number().over(held.orderBy("first_position"))
    n = F.count("*").over(held)
    share = F.floor(F.col("all_taken") / n) + (turn <= F.col("all_taken") % n).cast("long")
    out = sized.join(t, same, "left").withColumn("taken", F.coalesce(share, F.lit(0)).cast("long"))
    out = out.join(bounded(g), F.col("source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_position")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_position")
