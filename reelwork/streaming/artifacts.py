"""Folders that grow: each run takes the files that no run before it has taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.operators.usage import changed_artifacts

_FILE = "path string, modificationTime timestamp, length long, content binary"
_SEEN = "path string, sha256 string, modified timestamp"


def take_new_artifacts(spark: SparkSession, root: str, glob: str, state: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, sha256, modified) of the files below root whose names match and that no run with this state has taken.

    A file stream with the trigger availableNow: it ends once it has taken what lies there. state is a folder with the
    stream's checkpoint and its log of files, one folder a batch. A batch that was cut off is done again by the next run
    and overwrites what it had left, so each file is in the log once. A file that is rewritten under its name is not new to
    a stream: changed_since() finds it.
    """
    done: list[int] = []

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/log/batch={number}")
        done.append(number)

    found = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(root)
    hashed = found.select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))
    hashed.writeStream.foreachBatch(log).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], _SEEN)
    return spark.read.schema(_SEEN).parquet(*[f"{state}/log/batch={k}" for k in done])


def taken_artifacts(spark: SparkSession, state: str) -> DataFrame:
    """(path, sha256, modified, batch) of all files that runs with this state have taken."""
    return spark.read.option("basePath", f"{state}/log").parquet(f"{state}/log")


def changed_since(now: DataFrame, spark: SparkSession, state: str) -> DataFrame:
    """Rows (path, sha256) of now that the log of state doesn't have: new files, and files with other content."""
    return changed_artifacts(now, taken_artifacts(spark, state).select("path", "sha256"))
