"""Fuzzy duplicate lines by MinHash over character shingles.

A line is the set of its distinct shingles of SHINGLE code points, in lower case. MinHash
bands propose pairs, the Jaccard similarity of the full sets decides, and of each component
the first line, by doc_id and line number, stays. Equal lines share a key and never meet as
pairs; a line of fewer code points than a shingle equals or does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelwork.llm.kernel import U64, bands_of, least_samples, mix, pieces
from reelwork.llm.links import Packer, Union, link_classes, may_link, n_buckets, parities, shared_bands, with_payloads
from reelwork.llm.shared import bit_table, documents, join_hot, keep, with_bit
from reelwork.session import arrow_map

SHINGLE = 7
PERCENT = 75
#: A pair at the threshold misses all bands with probability 0.5 %, one of similarity 0.85 with 4e-5.
BANDS, ROWS = 14, 4

_seeds = np.random.default_rng(20250202)
_FACTORS = _seeds.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_STEPS = _seeds.integers(0, 1 << 64, 3, U64) | U64(1)
#: Bytes of text that are worked on at a time, so that the arrays stay in the processor's cache.
WORK_BYTES = 1 << 18


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The code points of UTF-8 bytes, and where each begins and the last ends; None where each is a byte."""
    if (data < 128).all():
        return data.astype(U64), None
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U64), np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the shingle that begins at each code point, and for each span its first and the end of its last one."""
    points, places = code_points(data)
    if places is not None:
        starts, ends = np.searchsorted(places, starts), np.searchsorted(places, ends)
    if len(points) < SHINGLE:
        return np.zeros(0, U64), starts, starts
    two = points[:-1] * _STEPS[0] + points[1:]
    four = two[:-2] * _STEPS[1] + two[2:]
    # the two halves share a code point
    return mix(four[: 4 - SHINGLE] * _STEPS[2] + four[SHINGLE - 4 :]), starts, np.maximum(ends - SHINGLE + 1, starts)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, doc, line, key, text for each line of docs (doc_id, doc, text) that is not blank."""
    lines = docs.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    short = (F.octet_length("text") < 4 * SHINGLE) & (F.length("text") < SHINGLE)
    return lines.withColumn("key", F.xxhash64(F.when(short, F.lower("text")).otherwise(F.col("text"))))


def line_bands(lines: DataFrame) -> DataFrame:
    """(bucket, bands, ids): the bands of the lines (key, text) of a shingle or more, their keys being the ids."""
    buckets = n_buckets(lines.sparkSession)

    def run(batches):
        pack = Packer(buckets)
        for batch in batches:
            first = pa.array(np.sort(np.unique(batch.column("key").to_numpy(), return_index=True)[1]))
            lowered = pa.RecordBatch.from_arrays([batch.column("key").take(first), pc.utf8_lower(batch.column("text").take(first))], names=["key", "text"])
            for part, data, offsets in pieces(lowered, "text", WORK_BYTES):
                hashes, begin, end = shingles(data, offsets[:-1], offsets[1:])
                own = end > begin
                bands = bands_of(least_samples((hashes >> U64(32)).astype(np.uint32), begin[own], end[own], _FACTORS), BANDS, ROWS)
                yield from pack.add(bands.view(np.int64).ravel(), np.tile(part.column("key").to_numpy()[own], BANDS))
        yield from pack.rest()

    return arrow_map(lines.select("key", "text"), run, Packer.SCHEMA)


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _part, data, offsets in pieces(pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], ["t"]), "t", WORK_BYTES):
        hashes, begin, end = shingles(data, offsets[:-1], offsets[1:])
        for i, j in zip(begin.tolist(), end.tolist(), strict=True):
            own = np.sort(hashes[i:j])
            new = np.flatnonzero(own[1:] != own[:-1])
            out.append(own if len(new) == len(own) - 1 else own[np.append(new, len(own) - 1)])
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    schema = StructType.fromDDL("a long, b long")

    def run(batches):
        for batch in batches:
            a = batch.column("a").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            of_a, of_b = line_sets(batch.column("of_a").take(pa.array(heads))), line_sets(batch.column("of_b"))
            which = np.searchsorted(heads, np.arange(len(a)), "right") - 1
            own = pa.array([i for i, k in enumerate(which.tolist()) if similar(of_a[k], of_b[i], percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(own), batch.column("b").take(own)], names=schema.names)

    return arrow_map(with_payloads(pairs, texts), run, schema)


def block_links(percent: int):
    """For links_in_blocks(): a spanning set of the links between the components of a block."""

    def prepare(texts):
        sets = line_sets(texts)
        counts = np.array([len(x) for x in sets], np.int64)
        return sets, counts, parities(np.concatenate(sets), counts)

    def links(prepared, comps, probes, builds, at):
        sets, counts, parity = prepared[0][at], prepared[1][at], prepared[2][at]
        groups, out = Union(comps), []
        for i in probes.tolist():
            for j in may_link(parity, counts, i, builds[comps[builds] != comps[i]], percent).tolist():
                if groups.find(i) != groups.find(j) and similar(sets[i], sets[j], percent):
                    groups.join(i, j)
                    out.append((i, j))
        return out

    return prepare, links


def row_hash() -> Column:
    """A hash of doc_id and text, null without a doc_id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, the row's hash, of the rows that have a doc_id."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("doc"))


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, doc, line, first_doc_id, first_line): each line that goes, and the line that stays for it.

    Lines are the parts between newlines, counted from 0, compared in lower case; a null text
    has none, and blank lines stay. Lines are told apart by 64-bit hashes. Rows with a null
    doc_id are left alone. Rows that repeat a document count as one, so both lose the same
    lines; of one doc_id with several texts doc, a hash of both, tells which is meant.
    """
    rows = named_rows(docs)
    members = shared_bands(line_bands(lines_of(rows)))
    ids = keep(members.select("id").distinct())
    lines = keep(with_bit(lines_of(rows), bit_table(ids, "id"), "key").withColumn("text", F.when(F.col("hit"), F.col("text"))))
    texts = keep(lines.where("text is not null").join(ids, F.col("key") == F.col("id"), "left_semi").groupBy(F.col("key").alias("id")).agg(F.first("text").alias("payload")))
    near = link_classes(members, lambda pairs: pairs, lambda pairs: confirmed(pairs, texts, percent), texts, block_links(percent))

    place = F.struct("doc_id", "doc", "line")
    keys = lines.groupBy("key").agg(F.min(place).alias("place"), F.max(place).alias("last"), F.count("*").alias("n"))
    # a line that no other equals, and that has no link, goes no further
    labeled = keep(keys.join(near.withColumnRenamed("node", "key"), "key", "left").where("component is not null or place < last").withColumn("label", F.coalesce("component", "key")))
    stays = labeled.groupBy("label").agg(F.min("place").alias("first"), F.max("last").alias("last")).where("first < last").select("label", "first")
    gone = join_hot(lines.select("doc_id", "doc", "line", "key"), labeled.join(stays, "label").select("key", "first", "n"), "key").where(place > F.col("first"))
    return gone.select("doc_id", "doc", "line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line")).distinct()


def cleaned_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with removed_lines (sorted numbers) and clean_text, the text without them; a null text stays null."""
    gone = duplicate_lines(docs, percent).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("_removed"))
    out = docs.withColumn("_doc", row_hash()).join(gone.withColumnRenamed("doc", "_doc"), "_doc", "left").withColumn("removed_lines", F.coalesce("_removed", F.array().cast("array<int>")))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _x, i: ~F.array_contains("removed_lines", i)), "\n")
    return out.withColumn("clean_text", F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(left)).drop("_doc", "_removed")


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    n = F.when(F.col("text").isNotNull(), F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    counted = docs.select("doc_id", row_hash().alias("doc"), n.cast("long").alias("n_lines"))
    gone = duplicate_lines(docs).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    out = counted.join(gone, "doc", "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
