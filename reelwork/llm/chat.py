"""Reply trees as chat conversations.

Messages form trees (tree, node, parent). Root-to-leaf paths come from iterative self-joins
with doubled steps: after k rounds a node knows its ancestor 2**k steps up, so a thread of
400 replies takes nine joins. Branches are ranked by score, and each chosen path is formatted
as one conversation with the character spans that carry the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.llm.shared import keep

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that must not occur in a text as they are; other families' marks are among them.
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """Every backslash doubled, then one put behind the first character of each control string."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _same(left: dict[str, str]) -> Column:
    match = F.lit(True)
    for a, b in left.items():
        match = match & F.col(a).eqNullSafe(F.col(b))
    return match


def root_to_leaf(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, branch, leaf, depth, node) for the best branches of each tree, all of them if None.

    nodes: tree, node, parent, score; node is unique in its tree and not null. A node whose
    parent is null or unknown is a root; a null score counts 0. A branch's score is the sum
    along its path; ties go to the longer path, then the lesser leaf. Nodes on a cycle have
    no root and are left out.
    """
    n = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = n.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    up = n.join(known, _same({"tree": "_t", "parent": "_n"}) & F.col("parent").isNotNull(), "left")
    step = keep(up.select("tree", "node", F.col("_n").alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    total = keep(n.groupBy("tree").count().agg(F.max("count").alias("m"))).first()["m"] or 1
    steps = [step]
    while 2 ** (len(steps) - 1) < total and not steps[-1].where("above is not null").isEmpty():
        last = steps[-1]
        far = last.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("above").alias("_above"), F.col("total").alias("_total"), F.col("depth").alias("_depth"))
        # what has reached its root stays as it is
        joined = last.where("above is not null").join(far, _same({"tree": "_t", "above": "_n"}), "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        moved = joined.select("tree", "node", F.col("_above").alias("above"), plus("total"), plus("depth"))
        steps.append(keep(moved.unionByName(last.where("above is null"))))
    parents = n.where("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = steps[-1].where("above is null").join(parents, _same({"tree": "_t", "node": "_n"}), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("total").desc(), F.col("depth").desc(), "node"))
    best = leaves.withColumn("branch", rank)
    best = best if branches is None else best.where(F.col("branch") <= branches)
    path = best.select("tree", "branch", F.col("node").alias("leaf"), "depth", "node")
    for jump in reversed(steps[:-1] if len(steps) > 1 else steps):
        j = jump.where("above is not null").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "above")
        more = path.join(j, _same({"tree": "_t", "node": "_n"}))
        size = 2 ** steps.index(jump)
        path = keep(path.unionByName(more.select("tree", "branch", "leaf", (F.col("depth") - size).alias("depth"), F.col("above").alias("node"))))
    return path


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, formatted, loss_spans) from rows tree, branch, depth, role, text.

    A turn is TURN role BODY text END, with role and text escaped; loss_spans are the
    (start, length) in code points of the escaped texts of loss_role. A null role or text is
    an empty one. A conversation is one row, so it must fit in a task.
    """
    t = turns.select("tree", "branch", "depth", F.col("role").eqNullSafe(F.lit(loss_role)).alias("scored"), F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)).alias("head"), escaped(F.col("text")).alias("body"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = W.partitionBy("tree", "branch").orderBy("depth", "piece").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    row = F.sort_array(F.collect_list(F.struct("depth", "start", "piece", "scored", F.length("body").alias("length"))))
    return t.groupBy("tree", "branch").agg(row.alias("rows")).select(
        "tree", "branch", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["scored"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))).alias("loss_spans"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    halves = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|body\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_reply_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, branch, formatted, loss_spans) for the chosen branches of messages (tree, node, parent, score, role, text)."""
    path = root_to_leaf(messages, branches)
    body = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    return format_chats(path.join(body, _same({"tree": "_t", "node": "_n"})))


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: each row answers the row before it, by turn, then role and text."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return c.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op4_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_reply_trees(threads(table.unionByName(extra)))
    turns = read_chats(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
