"""Links among the members of MinHash buckets, each checked, and the components they make.

In a bucket one leading member first meets each of the others, which is linear in the bucket.
What these links leave in different components, though together in some bucket, is then
compared in blocks of bounded size, where only links come out and no pairs; so no link is lost
to the shortcut, and a hot bucket is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelwork.llm.graph import components
from reelwork.llm.kernel import U64
from reelwork.llm.shared import keep
from reelwork.session import arrow_map

#: Members of a bucket that one block holds on either side.
BLOCK = 1024
#: Pairs of a leading member that go to one task.
HUB_PAIRS = 512
PARITY_BITS = 1024


class Packer:
    """Gathers (band, id) pairs and gives them out by range of the band, many to a row."""

    SCHEMA = "bucket int, bands binary, ids binary"
    PAIRS = 1 << 18

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, bands: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((bands, ids))
        self.n += len(bands)
        if self.n >= self.PAIRS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        bands, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        bucket = (((bands.view(U64) >> U64(32)) * U64(self.buckets)) >> U64(32)).astype(np.uint16 if self.buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        own = np.flatnonzero(np.diff(cuts))
        blob = lambda x: pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.append(cuts[own], cuts[-1]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[order]))])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), blob(bands), blob(ids)], ["bucket", "bands", "ids"])


def n_buckets(spark: SparkSession) -> int:
    """Ranges of the bands, several to each partition of a shuffle, so that these come out even."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed_bands(rows: DataFrame) -> DataFrame:
    """(bucket, bands, ids) for rows (id, bands array<long>): pairs of a band and its id, many to a row."""
    buckets = n_buckets(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(buckets)
        for batch in batches:
            bands = batch.column("bands")
            yield from pack.add(bands.flatten().to_numpy(), np.repeat(batch.column("id").to_numpy(), pc.fill_null(pc.list_value_length(bands), 0).to_numpy()))
        yield from pack.rest()

    return arrow_map(rows.select("id", "bands"), run, Packer.SCHEMA)


class Gatherer:
    """Tells from (band, id) pairs those whose band has several ids; only bands with one so far are held."""

    def __init__(self) -> None:
        self.bands, self.ids, self.let = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, bands: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, i = np.concatenate([self.bands, bands]), np.concatenate([self.ids, ids])
        order = np.argsort(b)
        b, i = b[order], i[order]
        same = b[1:] == b[:-1]
        multiple = np.zeros(len(b), bool)
        multiple[1:] |= same
        multiple[:-1] |= same
        if len(self.let):
            multiple |= self.let[np.minimum(np.searchsorted(self.let, b), len(self.let) - 1)] == b
        single_b, single_i = b[~multiple], i[~multiple]
        b, i = b[multiple], i[multiple]
        order = np.lexsort((i, b))
        b, i = b[order], i[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
        b, i = b[new], i[new]
        several = np.zeros(len(b), bool)
        same = b[1:] == b[:-1]
        several[1:] |= same
        several[:-1] |= same
        if len(self.let):
            several |= self.let[np.minimum(np.searchsorted(self.let, b), len(self.let) - 1)] == b
        self.bands, self.ids = np.concatenate([single_b, b[~several]]), np.concatenate([single_i, i[~several]])
        self.let = np.union1d(self.let, b[several])
        return b[several], i[several]


def shared_bands(packed: DataFrame) -> DataFrame:
    """(band, id) of the pairs in packed (bucket, bands, ids) whose band another id has too, each once.

    A task holds the bands of its buckets, but not the ids of a band that has many.
    """
    schema = StructType.fromDDL("band long, id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = Gatherer(), [], 0
        numbers = lambda x: np.frombuffer(x.as_py(), np.int64)
        for batch in batches:
            for bands, ids in zip(batch.column("bands"), batch.column("ids"), strict=True):
                held.append((numbers(bands), numbers(ids)))
                n += len(held[-1][0])
                if n >= max(Packer.PAIRS, len(seen.bands)):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, seen.take(*(np.concatenate(x) for x in zip(*held, strict=True))))), schema.names)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, seen.take(*(np.concatenate(x) for x in zip(*held, strict=True))))), schema.names)

    return keep(arrow_map(packed.repartition("bucket"), run, schema).distinct())


def with_leads(members: DataFrame) -> DataFrame:
    """members (band, id) with lead, the member of the band whose buckets are largest in all.

    In a group of edited copies that is the text they come from, which is like each of them,
    as they need not be.
    """
    sizes = members.groupBy("band").agg(F.count("*").alias("n"))
    ties = members.join(sizes, "band").groupBy("id").agg(F.sum("n").alias("ties"))
    leads = members.join(ties, "id").groupBy("band").agg(F.max(F.struct("ties", (-F.col("id")).alias("minus"))).alias("x")).select("band", (-F.col("x.minus")).alias("lead"))
    return members.join(leads, "band")


def with_payloads(pairs: DataFrame, payloads: DataFrame) -> DataFrame:
    """pairs (a, b) with of_a and of_b from payloads (id, payload); an id with many pairs is dealt over several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_PAIRS)).cast("int").alias("parts"))
    hubs = payloads.join(parts, F.col("id") == F.col("a")).select("a", F.col("payload").alias("of_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = pairs.join(parts, "a").join(payloads.select(F.col("id").alias("b"), F.col("payload").alias("of_b")), "b")
    return rest.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(hubs, ["a", "part"]).select("a", "b", "of_a", "of_b")


def parities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd sketches of whole sets (sets, PARITY_BITS / 64): their XOR never has more bits than the sets have different members."""
    bits = (values % U64(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(len(counts)), counts) * PARITY_BITS
    odd = (np.bincount(bits, minlength=len(counts) * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(counts), PARITY_BITS // 64)


def may_link(parity: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """The others whose sizes and sketches leave room for the similarity with i, nearest first; it never drops a link."""
    differ = np.bitwise_count(parity[others] ^ parity[i]).sum(1, dtype=np.int64)
    own = np.flatnonzero((100 + percent) * differ <= (100 - percent) * (sizes[others] + sizes[i]))
    return others[own[np.argsort(differ[own], kind="stable")]]


def _blocks(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, id, component, probe, build): the members of buckets that hold several components, in blocks of bounded size.

    A probe is a member outside its lead's component; it meets each build of its block. A
    bucket of two has been compared already, and buckets of equal members count once.
    """
    own = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "lead", F.coalesce("component", "id").alias("component"))
    seen = own.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.max(F.when(F.col("id") == F.col("lead"), F.col("component"))).alias("main"),
    )
    apart = seen.where("low < high and n > 2").groupBy("n", "a", "z", "x").agg(F.min(F.struct("band", "main")).alias("x1")).select("x1.band", "x1.main", "n")
    rows = own.join(apart, "band").withColumn("other", F.col("component") != F.col("main"))
    probes = rows.where("other").groupBy("band").agg(F.count("*").alias("n_others"))
    many = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    rows = rows.join(probes, "band").withColumns({"across": many("n"), "down": many("n_others"), "at": F.pmod(F.xxhash64("id"), many("n")).cast("int"), "from": F.pmod(F.xxhash64(F.lit(3), "id"), many("n_others")).cast("int")})
    as_build = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: i * F.col("across") + F.col("at"))
    as_probe = F.when(F.col("other"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: F.col("from") * F.col("across") + c)).otherwise(F.array().cast("array<int>"))
    spread = rows.withColumn("cell", F.explode(F.array_union(as_build, as_probe)))
    probe = F.col("other") & (F.floor(F.col("cell") / F.col("across")) == F.col("from"))
    return spread.select(F.xxhash64("band", "cell").alias("block"), "id", "component", probe.alias("probe"), (F.col("cell") % F.col("across") == F.col("at")).alias("build"))


def links_in_blocks(shared: DataFrame, labels: DataFrame, payloads: DataFrame, prepare: Callable, links: Callable) -> DataFrame:
    """(a, b) of the links found in each block.

    prepare(payloads) is what links(prepared, components, probes, builds, at) needs of the rows
    of many blocks; at is the slice of one block, in which links gives pairs of places.
    """
    rows = _blocks(shared, labels).join(payloads, "id").select("block", "id", "component", "probe", "build", "payload")
    schema = StructType.fromDDL("a long, b long")

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        block, ids, comps, probe, build = (table.column(k).to_numpy() for k in ("block", "id", "component", "probe", "build"))
        prepared = prepare(pa.concat_arrays(table.column("payload").chunks))
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out = []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
            at = slice(i, j)
            out += [(i + x, i + y) for x, y in links(prepared, comps[at], np.flatnonzero(probe[at]), np.flatnonzero(build[at]), at)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            last = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
            if last or (held and held[-1].column("block")[0].as_py() != block[0]):
                whole = [*held, batch.slice(0, last)]
                yield found(pa.Table.from_batches([x for x in whole if x.num_rows]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    return arrow_map(rows.repartition("block").sortWithinPartitions("block"), run, schema)


class Union:
    """Union-find over the components of a block."""

    def __init__(self, comps: np.ndarray):
        self.of = np.unique(comps, return_inverse=True)[1]
        self.up = list(range(int(self.of.max(initial=-1)) + 1))

    def find(self, i: int) -> int:
        x = int(self.of[i])
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def link_classes(members: DataFrame, stars_of: Callable, confirm: Callable, payloads: DataFrame, in_block: tuple[Callable, Callable], recheck: Callable | None = None) -> DataFrame:
    """(node, component) over the links among members (band, id) of the same band.

    stars_of(pairs) keeps the pairs (a, b) of a lead and a member that may be links; confirm(pairs)
    those that are. in_block, prepare and links of links_in_blocks(), finds links in payloads
    (id, payload), or pairs that recheck(pairs) still confirms.
    """
    shared = keep(with_leads(members))
    stars = shared.where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    joined = components(confirm(keep(stars_of(stars))))
    bridges = links_in_blocks(shared, joined, payloads, *in_block)
    if recheck is not None:
        bridges = recheck(keep(bridges.distinct()))
    return components(joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(bridges))
