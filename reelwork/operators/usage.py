"""Usage log: duplicates, cost, totals, changes and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: US dollars for a million tokens: input, cached input, output.
EXAMPLE_PRICES = {"m-a": (1.5, 0.15, 7.5), "m-b": (0.5, 0.05, 3.0)}
ATTEMPT = r"(^|/)attempts/|(^|/)attempt-[0-9]+/|(^|[./])attempt-[0-9]+\.raw_interaction\.json$"


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in prices.items()], "model string, input_price double, cached_price double, output_price double")


def is_attempt(path: Column) -> Column:
    """Whether a path is one paid attempt, which counts even if its payload is not new."""
    return path.rlike(ATTEMPT)


def _marked(log: DataFrame) -> DataFrame:
    return log.withColumn("payload_hash", F.sha2("payload", 256)).withColumn("is_attempt", is_attempt(F.col("path")))


def _heads(marked: DataFrame) -> DataFrame:
    """Of each payload the first row by path that is no attempt; Spark keeps one a task before the shuffle, so a hot payload is no hot task."""
    place = F.row_number().over(W.partitionBy("payload_hash").orderBy("path"))
    return marked.where("NOT is_attempt").withColumn("_rn", place).where("_rn = 1").drop("_rn")


def usage_dedup(log: DataFrame) -> DataFrame:
    """log without rows whose payload an attempt or a lesser path already has. Paths are unique."""
    marked = _marked(log)
    attempts = marked.where("is_attempt")
    return attempts.unionByName(_heads(marked).join(attempts.select("payload_hash").distinct(), "payload_hash", "left_anti"))


def usage_duplicates(log: DataFrame) -> DataFrame:
    """(path, payload_hash) of the rows that usage_dedup() leaves out."""
    rows = log.select("path", "payload", is_attempt(F.col("path")).alias("is_attempt"))
    # one pass finds the first path and the attempts of each payload; payloads are compared themselves, and only what is left out is hashed
    heads = rows.groupBy("payload").agg(F.min(F.when(~F.col("is_attempt"), F.col("path"))).alias("first_path"), F.bool_or("is_attempt").alias("has_attempt"))
    out = rows.where("NOT is_attempt").join(heads, "payload").where(F.col("has_attempt") | (F.col("path") != F.col("first_path")))
    return out.select("path", F.sha2("payload", 256).alias("payload_hash"))


def usage_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests, tokens and cost of each model. Tokens are summed as integers and multiplied last."""
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    per_model = usage_dedup(log).where("has_usage").groupBy("model").agg(
        F.count("*").alias("requests"), total("input_tokens", "input_tokens"), total("cached_tokens", "cached_tokens"), total(F.col("input_tokens") - F.col("cached_tokens"), "uncached_tokens"),
        total("output_tokens", "output_tokens"), total("thought_tokens", "thought_tokens"), total(F.col("output_tokens") + F.col("thought_tokens"), "billed_output_tokens"),
    )
    cost_in = (F.col("uncached_tokens") * F.col("input_price") + F.col("cached_tokens") * F.col("cached_price")) / 1_000_000
    cost_out = F.col("billed_output_tokens") * F.col("output_price") / 1_000_000
    return per_model.join(prices, "model").withColumns({"input_cost": F.round(cost_in, 8), "output_cost": F.round(cost_out, 8)}).drop("input_price", "cached_price", "output_price")


def usage_violations(log: DataFrame, prices: DataFrame) -> DataFrame:
    """(path, rule): unknown_model, cached_out_of_range or unpriced."""
    kept = usage_dedup(log).join(prices.select("model", F.lit(True).alias("known")), "model", "left")
    rules = F.array(
        F.when(F.col("has_usage") & F.col("known").isNull(), F.lit("unknown_model")),
        F.when(F.col("has_usage") & ((F.col("cached_tokens") < 0) | (F.col("cached_tokens") > F.col("input_tokens"))), F.lit("cached_out_of_range")),
        F.when(~F.col("has_usage"), F.lit("unpriced")),
    )
    return kept.select("path", F.explode(F.array_compact(rules)).alias("rule"))


def usage_total(log: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for the log: a model's name or 'mixed', totals, cost, and whether every request has a price."""
    models = usage_cost(log, prices).agg(
        F.when(F.count("*") > 1, "mixed").otherwise(F.max("model")).alias("model"), F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("billed_output_tokens").alias("billed_output_tokens"), F.round(F.sum(F.col("input_cost") + F.col("output_cost")), 6).alias("cost"),
    )
    others = _marked(log).agg(F.count_if(~F.col("is_attempt")).alias("others"))
    kept = usage_dedup(log).agg(F.count_if(~F.col("has_usage")).alias("unpriced"), F.count_if(~F.col("is_attempt")).alias("heads"))
    counts = kept.crossJoin(others).select("unpriced", (F.col("others") - F.col("heads")).alias("duplicates"))
    return models.crossJoin(counts).withColumn("pricing_complete", F.col("unpriced") == 0)


def with_modalities(log: DataFrame) -> DataFrame:
    """log with input tokens split by modality: an array of (modality, tokens)."""
    part = lambda name, tokens: F.struct(F.lit(name).alias("modality"), tokens.alias("tokens"))
    return log.where("has_usage").withColumn("by_modality", F.array(part("video", F.col("cached_tokens")), part("text", F.col("input_tokens") - F.col("cached_tokens"))))


def tokens_by_modality(log: DataFrame) -> DataFrame:
    return log.select(F.explode("by_modality").alias("m")).groupBy(F.coalesce("m.modality", F.lit("UNKNOWN")).alias("modality")).agg(F.sum("m.tokens").alias("tokens"))


def library_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of an asset (the path's first part): the current results alone, and with all attempts."""
    kept = usage_dedup(log).withColumn("asset_id", F.split("path", "/")[0])
    parts = {"fresh": F.col("input_tokens") - F.col("cached_tokens"), "cached": F.col("cached_tokens"), "out": F.col("output_tokens") + F.col("thought_tokens")}
    current, paid = F.col("has_usage") & ~F.col("is_attempt"), F.col("has_usage")
    sums = [F.sum(F.when(when, x).otherwise(0)).alias(f"{name}_{k}") for name, when in (("current", current), ("paid", paid)) for k, x in parts.items()]
    tokens = kept.groupBy("asset_id", "model").agg(*sums, F.count_if(paid).alias("ok"), F.count_if(~paid).alias("bad")).join(prices, "model")
    cost = lambda name: F.round(F.sum(F.col(f"{name}_fresh") * F.col("input_price") + F.col(f"{name}_cached") * F.col("cached_price") + F.col(f"{name}_out") * F.col("output_price")) / 1_000_000, 6)
    return tokens.groupBy("asset_id").agg(cost("current").alias("execution_cost"), cost("paid").alias("lifetime_cost"), F.sum("ok").alias("succeeded"), F.sum("bad").alias("failed"))


def changed_artifacts(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows (path, sha256) that the snapshot doesn't have."""
    return now.join(snapshot, ["path", "sha256"], "left_anti")


def latest_attempt(log: DataFrame) -> DataFrame:
    """The newest row of each subject (subject, path, attempt); ties go to the greater path."""
    return log.groupBy("subject").agg(F.max_by(F.struct("path", "attempt"), F.struct("attempt", "path")).alias("x")).select("subject", "x.path", "x.attempt")
