"""WARC archives: written by tasks, and read back in splits by boundary chains.

A record says how long it is, so its start points to the start of the next one. Readers of a
split cannot know whether the magic that they find starts a record or stands in a payload. Each
task therefore gives every place of the magic as a candidate with its successor. Within a split
the successors are followed to the first candidate beyond it; between the splits of a file,
pointer jumping from the start of the file finds the candidates that are reached. Those are the
records; every other candidate lies within one.

Archives are uncompressed, so Spark can split them, and are written and read by Spark's own
text source, with the record's end and the magic as line separators: any store that Spark reaches
will do.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelwork.llm.shared import bounded, drop_folder, keep, left_hot, shared_folder
from reelwork.session import arrow_map, find_package

CRLF = "\r\n"
GAP = CRLF + CRLF
MAGIC = "WARC/1.1" + CRLF
#: Equal payloads of fewer bytes are stored again and not referred to.
MIN_REVISIT = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def marked_revisits(pages: DataFrame, payload: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, _payload, _sha1, _type, _refers_to) for each row of pages.

    Of rows with equal payloads of at least `least` bytes, those of the largest page_id are
    responses and the others revisits of it. Rows without a page_id come before all ids; if no
    row of a payload has one, all are responses. Rows that share the largest id are all
    responses. A null payload is empty. Payloads are compared by SHA-256.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("_payload"), F.sha1(body.cast("binary")).alias("_sha1"), F.when(F.octet_length(body) >= least, F.unhex(F.sha2(body.cast("binary"), 256))).alias("_same"))
    first = rows.where("_same is not null").groupBy("_same").agg(F.count("*").alias("n"), F.max("page_id").alias("_first")).where("n > 1")
    # longer than any hash
    alone = F.concat(F.unhex(F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), "_sha1"), 256)), F.lit(b"-"))
    found = left_hot(rows, first, "_same", alone)
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select("page_id", "url", "_payload", "_sha1", F.when(again, "revisit").otherwise("response").alias("_type"), F.when(again, F.col("_first")).alias("_refers_to"))


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _uri(url: Column) -> Column:
    """A header's value must stay on its line."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def warc_record(page: Column, url: Column, payload: Column, sha1: Column, kind: Column, refers_to: Column) -> Column:
    """A whole record without the gap behind it. A revisit's block has the HTTP head alone."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(GAP))
    block = F.when(kind == "revisit", http).otherwise(F.concat(http, payload))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    referred = F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", record_id(refers_to)))).otherwise("")
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", kind), line("WARC-Record-ID", record_id(page)), line("WARC-Date", F.lit(DATE)), F.when(url.isNull(), "").otherwise(line("WARC-Target-URI", _uri(url))),
        referred, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def write_warc(pages: DataFrame, path: str, payload: str = "html") -> None:
    """Writes one record for each row of pages (page_id, url, payload) to archives in the folder path, one a task.

    The files have the text source's names. A null url gives no target; line ends in a url are
    escaped as in a URI.
    """
    made = marked_revisits(pages, payload)
    made.select(warc_record(F.col("page_id"), F.col("url"), F.col("_payload"), F.col("_sha1"), F.col("_type"), F.col("_refers_to")).alias("value")).write.option("lineSep", GAP).text(path)


def lines_of(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """(file, block, n_bytes, columns of value, nth, start) of what stands between two places of the magic.

    file is a hash of the path, block a split's start; nth and start are a line's number and
    first byte among the lines of its split. They come from the order within the split, so
    two readings agree however Spark packs splits into tasks.
    """
    found = spark.read.option("lineSep", MAGIC).text(path)
    rows = found.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("n_bytes"), *columns)
    schema = StructType(rows.schema.fields + StructType.fromDDL("nth long, start long").fields)

    def run(batches):
        split, nth, start = None, 0, 0
        for batch in (b for b in batches if b.num_rows):
            file, block, size = (batch.column(c).to_numpy() for c in ("file", "block", "n_bytes"))
            new = np.ones(len(file), bool)
            new[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
            new[0] = (file[0], block[0]) != split
            first = np.maximum.accumulate(np.where(new, np.arange(len(file)), 0))
            goes_on = np.cumsum(new) == 0
            ends = np.concatenate([[0], np.cumsum(size + len(MAGIC))])
            number = np.arange(len(file)) - first + np.where(goes_on, nth, 0)
            begin = ends[:-1] - ends[first] + np.where(goes_on, start, 0)
            split, nth, start = (file[-1], block[-1]), number[-1] + 1, begin[-1] + size[-1] + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64()), pa.array(begin, pa.int64())], names=schema.names)

    return arrow_map(rows, run, schema)


def _field(head: Column, name: str) -> Column:
    """The first field of a name in a head, null if there is none."""
    got = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(got != "", F.rtrim(got))


def described(value: Column, whole_only: bool) -> list[Column]:
    """What a line says if it is a record. All sizes are bytes.

    length is null, and the line no record, without the empty line that ends a head or without
    a length. complete: the line holds the whole block. The payload is an HTTP message's body. With
    whole_only it is read only where the line is exactly a record.
    """
    head = F.substring_index(value, GAP, 1)
    head_bytes, n_bytes = F.octet_length(head).cast("long"), F.octet_length(value).cast("long")
    length = F.when(head_bytes < n_bytes, _field(head, "Content-Length").try_cast("long"))
    length = F.when(length >= 0, length)
    room = n_bytes - head_bytes - len(GAP) - length
    block = F.substring(value.cast("binary"), (head_bytes + len(GAP) + 1).cast("int"), F.least(length, n_bytes).cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), GAP, 1)) + len(GAP)
    payload = F.when(room == len(GAP) if whole_only else length.isNotNull(), F.substring(block, http + 1, F.octet_length(block)))
    names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "declared": "WARC-Payload-Digest"}
    return [head_bytes.alias("head_bytes"), length.alias("length"), *[_field(head, f).alias(c) for c, f in names.items()], (room >= 0).alias("complete"), payload.alias("payload")]


def _digest(payload: Column) -> list[Column]:
    return [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_sha1")]


def placed(lines: DataFrame) -> DataFrame:
    """lines with at, the offset of the magic before each line, and next, the one that it says follows; null if the line is no record."""
    size = lines.groupBy("file", "block").agg(F.sum(F.col("n_bytes") + len(MAGIC)).alias("bytes"))
    base = size.select("file", "block", F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("start") - len(MAGIC)
    past = F.col("at") + len(MAGIC) + F.col("head_bytes") + len(GAP) + F.col("length") + len(GAP)
    return lines.join(base, ["file", "block"]).withColumn("at", at).withColumn("next", F.when(F.col("at") >= 0, past)).drop("base", "start")


def _links(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For places in order, the index of each one's successor, its own if that is not among them; after is -1 for none."""
    i = np.minimum(np.searchsorted(at, after), len(at) - 1)
    return np.where(at[i] == after, i, np.arange(len(at)))


def _sorted(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rows = rows.sort_by("at")
    return rows, rows.column("at").to_numpy(), rows.column("next").fill_null(-1).to_numpy()


def split_exits(candidates: DataFrame) -> DataFrame:
    """(file, block, at, to) for each candidate: where its chain of successors leaves its split. A split's candidates are one group."""

    def run(rows: pa.Table) -> pa.Table:
        rows, at, after = _sorted(rows)
        link = _links(at, after)
        while not np.array_equal(link, beyond := link[link]):
            link = beyond
        return pa.table({"file": rows.column("file"), "block": rows.column("block"), "at": at, "to": after[link]})

    find_package(candidates.sparkSession)
    return candidates.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(run, "file long, block long, at long, to long")


def reached(exits: DataFrame) -> DataFrame:
    """(file, block, at): the candidates at which a chain from a file's start enters a split, by pointer jumping.

    After k rounds the set holds all within 2**k splits of the start, and a jump goes over
    2**k splits; rounds end when no jump reaches anything. Successors lie behind their
    candidates, so there are no cycles.
    """
    named = exits.select("file", F.col("to").alias("at")).where("at >= 0").distinct()
    starts = keep(exits.where("at = 0").select("file", "block", "at"))
    nodes = keep(exits.join(named, ["file", "at"], "left_semi").select("file", "block", "at", "to").unionByName(exits.where("at = 0").select("file", "block", "at", "to")))
    ends = nodes.select("file", F.col("block").alias("to_block"), F.col("at").alias("to"))
    jump = keep(nodes.join(ends, ["file", "to"]).select("file", "at", "to", "to_block"))
    found = starts
    while True:
        new = keep(found.join(jump, ["file", "at"]).select("file", F.col("to_block").alias("block"), F.col("to").alias("at")))
        if new.isEmpty():
            return found
        found = keep(found.unionByName(new))
        step = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("to_block").alias("_block"))
        jump = keep(jump.join(step, ["file", "to"]).select("file", "at", F.col("_to").alias("to"), F.col("_block").alias("to_block")))


def owned(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """placed lines with record, the offset of the record that each belongs to: its own if it is reached, else the last one reached before it."""
    schema = StructType(lines.schema.fields + StructType.fromDDL("record long").fields)

    def run(rows: pa.Table, enter: pa.Table) -> pa.Table:
        rows, at, after = _sorted(rows)
        real = np.isin(at, enter.column("at").to_numpy())
        link = _links(at, after) if len(at) else np.zeros(0, np.int64)
        for _ in range(len(at).bit_length()):
            real[link[real]] = True
            link = link[link]
        last = np.maximum.accumulate(np.where(real, at, -1)) if len(at) else at
        return rows.append_column("record", pa.array(last, pa.int64(), mask=last < 0))

    find_package(lines.sparkSession)
    within = lines.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(run, schema)
    within = keep(within)
    last = within.groupBy("file", "block").agg(F.max("record").alias("last"))
    carried = last.select("file", "block", F.max("last").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return within.join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "carried")).drop("carried")


def verified_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the archives in path with what each says (described, payload by size and SHA-1 only) and the record that it belongs to."""
    *said, payload = described(F.col("value"), True)
    lines = placed(keep(lines_of(spark, path, *said, *_digest(payload))))
    return owned(lines, reached(keep(split_exits(lines.where("at >= 0")))))


def assembled(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """(file, at, described columns with payload) of records from the lines (file, block, nth, record) that they consist of: a second reading."""
    mine = bounded(lines.select("file", "block", "nth", F.col("record").alias("at")))
    pieces = lines_of(spark, path, F.col("value")).join(mine, ["file", "block", "nth"])
    whole = pieces.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("block", "nth", "value"))).alias("pieces"))
    value = F.array_join(F.transform("pieces", lambda p: p["value"]), MAGIC)
    return whole.select("file", "at", value.alias("value")).select("file", "at", *described(F.col("value"), False))


RECORD = ("file", "at", "type", "record_id", "uri", "refers_to", "declared", "length", "complete", "payload_bytes", "payload_sha1")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD for each record of the archives in path.

    A payload that holds the magic comes as several lines; its record is put together in a
    second reading, which is left out if there is none. A chain that leads to no record ends
    there: what follows is not reached. complete is false if the file ends within the block.
    """
    lines = keep(verified_lines(spark, path))
    records = lines.where("at = record")
    broken = records.where("payload_sha1 is null")
    if broken.isEmpty():
        return records.select(*RECORD)
    parts = lines.join(broken.select("file", "record"), ["file", "record"], "left_semi")
    mended = assembled(spark, path, parts)
    mended = keep(mended.withColumns(dict(zip(("payload_bytes", "payload_sha1"), _digest(F.col("payload")), strict=True))).select(*RECORD))
    return records.where("payload_sha1 is not null").select(*RECORD).unionByName(mended)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, type, record_id, uri, refers_to, payload as bytes) for each record of the archives in path."""
    return assembled(spark, path, keep(verified_lines(spark, path).where("record is not null"))).select("file", "at", "type", "record_id", "uri", "refers_to", "payload")


def resolved(records: DataFrame) -> DataFrame:
    """records of read_warc with payload_bytes and payload_sha1 of revisits taken from the response that they refer to; null if that is missing."""
    revisits = records.where("type = 'revisit'").drop("payload_bytes", "payload_sha1")
    asked = revisits.groupBy("refers_to").agg(F.count("*").alias("n")).where("refers_to is not null")
    held = records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_sha1").alias("payload_sha1"))
    full = left_hot(revisits, asked.join(held, "refers_to"), "refers_to", F.concat(F.lit("-"), F.coalesce("record_id", F.lit(""))))
    return records.where("type <> 'revisit'").unionByName(full)


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op13_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = keep(resolved(read_warc(spark, folder)))
    drop_folder(spark, folder)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))
