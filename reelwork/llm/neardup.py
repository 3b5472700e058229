"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles. MinHash bands propose candidates; an
odd sketch (the MinHash samples folded into a bitmap of parities) estimates the similarity
of a candidate pair from the population count of an XOR; what passes is confirmed on the
full sets. Equal sets are one class from the start, so copies never meet as pairs. See `links` for the
links within a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.kernel import LOWER, U64, bands_of, least_samples, lists, mix, prefix_hash, rolled, span_hash, words_of
from reelwork.llm.links import PARITY_BITS, link_classes, may_link, packed_bands, parities, shared_bands, with_payloads
from reelwork.llm.shared import documents, join_hot, keep, map_text

SHINGLE = 5
PERCENT = 75
#: A pair of similarity 0.75 misses all bands with probability 1.3e-6.
BANDS, ROWS = 50, 5
SKETCH_BITS = 512
#: Candidates estimated below this are not confirmed: 7 standard errors under the threshold.
ESTIMATE = 0.55

_seeds = np.random.default_rng(20250101)
_FACTORS = _seeds.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the piece's documents one after another, and their counts."""
    data = LOWER[data]
    words = words_of(data, offsets)
    hashes = span_hash(prefix_hash(data), words.starts, words.ends)
    windows = rolled(hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(rolled(hashes[a:b], b - a) + U64(b - a)))
        else:
            out.append(windows[:0])
    return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, _texts) -> list:
    values, counts = shingle_sets(data, offsets)
    return [lists(values.view(np.int64), counts, pa.int64()), lists(parities(values, counts).ravel(), np.full(len(counts), PARITY_BITS // 64), pa.int64())]


def signatures(data: np.ndarray, offsets: np.ndarray, _texts) -> list:
    values, counts = shingle_sets(data, offsets)
    full = np.flatnonzero(counts)
    n = len(counts)
    first = (np.cumsum(counts) - counts)[full]
    keys = np.zeros((2, n), U64)
    small = np.zeros((BANDS * ROWS, len(full)), np.uint32)
    if len(full):
        for i, salt in enumerate((U64(0x51ED2701), U64(0xA4093822299F31D0))):
            keys[i, full] = np.add.reduceat(mix(values + salt), first)
        small = least_samples((values >> U64(32)).astype(np.uint32), first, first + counts[full], _FACTORS)
    bands = bands_of(small, BANDS, ROWS).T
    samples = mix(small.astype(U64) + (np.arange(BANDS * ROWS, dtype=U64) << U64(32))[:, None])
    bits = (samples % U64(SKETCH_BITS)).astype(np.int64) + np.arange(len(full)) * SKETCH_BITS
    odd = (np.bincount(bits.ravel(), minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
    sketch = np.packbits(odd).view(np.int64)
    has = np.zeros(n, np.int64)
    has[full] = 1
    return [counts, keys[0].view(np.int64), keys[1].view(np.int64), lists(np.ascontiguousarray(bands).view(np.int64).ravel(), has * BANDS, pa.int64()), lists(sketch, has * (SKETCH_BITS // 64), pa.int64())]


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the XOR of two odd sketches (arrays of longs)."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    share = F.least(2 * differ / F.lit(float(SKETCH_BITS)), F.lit(0.999))
    return 1 + F.lit(SKETCH_BITS / (4.0 * BANDS * ROWS)) * F.log(1 - share)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets (id, payload)."""
    m, n = F.size("of_a"), F.size("of_b")
    near = with_payloads(pairs, sets).where(100 * F.least(m, n) >= percent * F.greatest(m, n))
    both = near.select("a", "b", m.alias("m"), n.alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("m") + F.col("n") - F.col("common"))).select("a", "b")


def block_links(percent: int):
    """For links_in_blocks(): the pairs whose sizes and whole-set sketches leave room for a link."""

    def prepare(payloads):
        rows = payloads.flatten().to_numpy().reshape(len(payloads), -1)
        return rows[:, 0], rows[:, 1:]

    def links(prepared, comps, probes, builds, at):
        sizes, parity = (x[at] for x in prepared)
        return [(i, j) for i in probes.tolist() for j in may_link(parity, sizes, i, builds[comps[builds] != comps[i]], percent).tolist()]

    return prepare, links


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links of at least percent similarity. A
    null, empty or blank text has no shingles and is its own component; so is a row with a
    null doc_id, whose component is null and which is kept. Repeated rows give repeated rows.
    doc_id names one text: where it names several, they count as linked.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = keep(map_text(rows, signatures, "n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>", ["doc_id"]))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    of_key = usable.groupBy(F.struct("key1", "key2").alias("key")).agg(F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id").alias("x"), F.count("*").alias("n"))
    classes = keep(of_key.select("key", F.col("x.doc_id").alias("id"), "x.bands", "x.sketch", "n"))
    members = shared_bands(packed_bands(classes.select("id", "bands")))
    sets = keep(map_text(rows.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), _sets, "shingles array<long>, parity array<long>", ["doc_id"]).select(F.col("doc_id").alias("id"), "parity", "shingles").dropDuplicates(["id"]))
    full = sets.select("id", F.col("shingles").alias("payload"))
    side = lambda c: classes.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    likely = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= ESTIMATE).select("a", "b")
    confirm = lambda pairs: confirmed(pairs, full, percent)
    described = sets.select("id", F.concat(F.array(F.size("shingles").cast("long")), "parity").alias("payload"))
    of_class = link_classes(members, likely, confirm, described, block_links(percent), confirm)

    named = classes.join(of_class.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("component"), "n")
    out = signed.select("doc_id", "n_shingles", F.struct("key1", "key2").alias("key"))
    unnamed = out.where("n_shingles = 0 or doc_id is null").withColumn("component", F.lit(None).cast("long"))
    out = join_hot(out.where("n_shingles > 0 and doc_id is not null"), named, "key").select(*unnamed.columns).unionByName(unnamed)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
