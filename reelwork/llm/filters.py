"""How filters act together: what each one removes, in every order of them.

The table is read once. A document becomes one cell, pass or fail for each filter, and a part
of the corpus becomes a tensor of counts with one axis of length 2 a filter. Every question
about an order is then a contraction of that tensor, which selects pass, fail or all along each
axis; no order is run over documents.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.shared import documents, keep
from reelwork.session import find_package

#: What is contracted along an axis: (pass, fail) counts.
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
#: Counts that each cell holds.
WEIGHTS = ("n", "good", "toxic")
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails: too few words, too few distinct ones (per cent), too many capitals (per cent), a symbol. None is null if the text is not."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper, chars = F.regexp_count(text, F.lit("[A-Z]")).cast("long"), F.length(text).cast("long")
    return {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * n, "C": 100 * upper > MAX_UPPER * chars, "D": text.rlike("[#$%&*|]")}


def flagged_documents(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of docs (doc_id, text, part); E: a smaller doc_id has the same text.

    A null text is empty, a null part the empty string. Texts are compared by SHA-256. A row
    without a doc_id has no smaller one and no label; rows that share a doc_id and a text are not
    smaller than each other. A document is good, or toxic, if any label of its doc_id says so.
    Texts leave the scan as flags and a hash; copies meet as partial minima, and rows meet the
    first of their text by text and doc_id, so a large group of copies is spread.
    """
    text = F.coalesce("text", F.lit(""))
    rows = keep(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[c.alias(k) for k, c in text_flags(text).items()], F.unhex(F.sha2(text, 256)).alias("same")))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    first = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    judged = named.join(said, "doc_id", "left").join(first, ["same", "doc_id"], "left").withColumn("E", F.col("first").isNull())
    judged = judged.unionByName(unnamed.withColumns({"E": F.lit(False), "good": F.lit(False), "toxic": F.lit(False)}), allowMissingColumns=True)
    return judged.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def cells(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, cell, n, good, toxic): rows of each combination of failures; bit k of cell is that of the k-th filter. At most 2**filters rows a part."""
    bits = [F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters)]
    cell = sum(bits[1:], bits[0])
    counts = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")]]
    return flagged.groupBy("part", cell.cast("int").alias("cell")).agg(*counts)


def tensor(cell: np.ndarray, counts: np.ndarray, axes: int) -> np.ndarray:
    """counts (WEIGHTS, rows) of cells as an array (WEIGHTS, 2, ..., 2), axis k + 1 for bit k."""
    flat = np.zeros((len(counts), 1 << axes), np.int64)
    np.add.at(flat, (slice(None), cell), counts)
    # the first axis after the weights is the highest bit
    return flat.reshape(len(counts), *[2] * axes).transpose(0, *range(axes, 0, -1))


def contracted(t: np.ndarray, select: list[np.ndarray]) -> np.ndarray:
    """Sums of t for each weight, with select[k] along the axis of filter k."""
    axes = "abcdefghijklmnop"[: len(select)]
    return np.einsum(f"z{axes},{','.join(axes)}->z", t, *select)


def order_steps(t: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step."""
    size, found = len(filters), {}
    for k in range(size):
        alone = contracted(t, [FAIL if i == k else PASS for i in range(size)])[0]
        failing = contracted(t, [FAIL if i == k else ALL for i in range(size)])[0]
        for before in itertools.chain.from_iterable(itertools.combinations([i for i in range(size) if i != k], m) for m in range(size)):
            removed = contracted(t, [FAIL if i == k else PASS if i in before else ALL for i in range(size)])
            kept = contracted(t, [PASS if i == k or i in before else ALL for i in range(size)])[0]
            found[k, frozenset(before)] = (kept, removed[0], failing - removed[0], alone, removed[1], removed[2])
    # an order has the filters of `before` ahead of k in so many ways
    times = lambda before: math.factorial(len(before)) * math.factorial(size - 1 - len(before))
    shapley = [sum(times(b) * x[1] for (i, b), x in found.items() if i == k) for k in range(size)]
    out = []
    for order in itertools.permutations(range(size)):
        for step, k in enumerate(order):
            out.append(("".join(filters[i] for i in order), step + 1, *found[k, frozenset(order[:step])], shapley[k]))
    return out


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of filters for each part of cells(): RESULT.

    A part is one group of at most 2**filters rows, whatever it counts. An empty table has no
    parts and so no rows.
    """
    find_package(counted.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell").to_numpy()
        made = order_steps(tensor(cell, np.stack([rows.column(w).to_numpy() for w in WEIGHTS]), len(filters)), filters)
        part = rows.column("part")[0].as_py()
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [pa.array([part] * len(made), pa.string()), *[pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]]
        return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return counted.groupBy("part").applyInArrow(run, RESULT)


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(cells(flagged_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))))
