"""What the operators share on the Spark side."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reelwork.llm import kernel
from reelwork.session import arrow_map

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only in local mode may that be unset, as in tests; a temporary folder is set then. Spark
    drops checkpoints that are out of use with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-reelwork-"))
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that an operator has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is counted to have no more rows than that; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, parts: int = 500) -> DataFrame:
    """rows joined with table, which has each key once and n, the number of its rows; table's n is dropped.

    Keys with more than a parts-th of these rows, fewer than parts of them, are broadcast, so no
    task gets all rows of a hot key.
    """
    table = keep(table)
    most = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") > most / parts).drop("n")
    rest = table.where(F.col("n") <= most / parts).drop("n")
    marked = rows.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    return marked.where("_hot").drop("_hot").join(F.broadcast(hot), key).unionByName(marked.where("_hot is null").drop("_hot").join(rest, key))


def left_hot(rows: DataFrame, table: DataFrame, key: str, spread: Column, parts: int = 500) -> DataFrame:
    """rows left-joined with table, which has each key once and n, the number of its rows; table's n is dropped.

    Keys with more than a parts-th of those rows, fewer than parts of them, are broadcast, and so
    are the others if they are few; beyond that they are joined by key, where rows that are
    served already, or have no key, stand under spread, a value that no key has.
    """
    table = keep(table)
    most = table.agg(F.sum("n")).first()[0] or 0
    names = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") > most / parts).select(key, F.struct(*names).alias("_hot"))
    rest = table.where(F.col("n") <= most / parts).select(F.col(key).alias("_key"), F.struct(*names).alias("_rest"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    joined = marked.join(bounded(rest), "_key", "left")
    return joined.withColumns({c: F.coalesce(f"_hot.{c}", f"_rest.{c}") for c in names}).drop("_key", "_hot", "_rest")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(docs: DataFrame, work, signals: str, carry: list[str], text: str = "text") -> DataFrame:
    """docs' columns in carry, and those that work computes from the text, in one pass.

    work(data, offsets, texts) gets the UTF-8 bytes of a piece of documents, where each
    begins, and a function that gives them as Python strings; it returns an Arrow array or a
    numpy array for each field of signals (a DDL string). A carried column that has the name
    of a signal gives way to it.
    """
    made = StructType.fromDDL(signals)
    carry = [c for c in carry if c not in made.names]
    held = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text}`").alias("_text"))
    schema = StructType([f for f in held.schema if f.name != "_text"] + made.fields)

    def run(batches):
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for part, data, offsets in kernel.pieces(batch, "_text"):
                out = work(data, offsets, lambda p=part: [x or "" for x in p.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(f"_c{i}").cast(kinds[i].type) for i in range(len(carry))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in out], schema=kinds)

    out = arrow_map(held, run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *made.names)


def bit_filter(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A bitmap with the bit of each leading bits of the 64-bit hashes in column.

    It has 2**bits bits (2 MB) whatever the number of hashes, so it may go to every task; at
    most 2**bits / 64 rows reach the driver. A full map lets everything through.
    """
    place = F.shiftrightunsigned(column, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    got = df.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def bit_table(df: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """(word, bits): bit_filter() as a table of at most 2**bits / 64 rows, which stays on Spark's side."""
    place = F.shiftrightunsigned(column, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return keep(df.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")))


def with_bit(rows: DataFrame, table: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """rows with hit, whether the hash in column may be one of those in bit_table()."""
    place = F.shiftrightunsigned(column, 64 - bits)
    held = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(table), "word", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("bits"), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return held.withColumn("hit", hit).drop("word", "bits")


def in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
    place = (hashes >> shift).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
