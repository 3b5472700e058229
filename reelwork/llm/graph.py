"""Connected components: union-find within partitions, rounds of joins between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwork.llm.shared import keep
from reelwork.session import arrow_map

#: Edges that one partition holds: a few MB.
EDGES_PER_PART = 400_000


def contracted(edges: DataFrame) -> DataFrame:
    """(node, low) for each node of each partition of edges (a, b): the least node that it reaches within the partition."""

    def run(batches):
        a, b = [], []
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        nodes, at = np.unique(np.concatenate([*a, *b]) if a else np.zeros(0, np.int64), return_inverse=True)
        up = list(range(len(nodes)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(at[: len(at) // 2].tolist(), at[len(at) // 2 :].tolist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        roots = np.array([find(x) for x in range(len(nodes))], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["node", "low"])

    return arrow_map(edges, run, "node long, low long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable over the undirected edges; nodes are longs.

    Each partition of some EDGES_PER_PART edges contracts its own by union-find. If there are
    several, rounds of joins follow over what is left, one edge for each node of a partition: every
    node takes the least label among its neighbours' and its own, then the label of that label,
    so long chains shorten by more than a step a round. Nodes are only those with an edge. Null
    ends and loops are dropped. A star's centre is left to Spark's handling of skewed joins.
    """
    pairs = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b"))
    parts = 1 + pairs.count() // EDGES_PER_PART
    stars = keep(contracted(pairs.coalesce(parts) if parts == 1 else pairs.repartition(parts)))
    if parts == 1:
        return stars.withColumnRenamed("low", "component")
    both = keep(stars.unionByName(stars.select(F.col("low").alias("node"), F.col("node").alias("low"))).where("node <> low").distinct())
    labels = keep(both.groupBy("node").agg(F.min("low").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("low"), "component"), "low").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        moved = keep(lower.join(target, "low", "left").select("node", F.col("component").alias("was"), F.least("low", F.coalesce("beyond", "low")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
