"""Timelines, budgets and QA of segments; and text claims."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.functions.text import normalized


def _order():
    return W.partitionBy("project_id").orderBy("pos")


def timeline(segments: DataFrame) -> DataFrame:
    """segments with start_ms and end_ms in their project's running order."""
    start = F.coalesce(F.sum("duration_ms").over(_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def budget_manifest(segments: DataFrame, sequence: DataFrame) -> DataFrame:
    """The segments of a budget's sequence (project_id, position, feature_id) in its order, on a new timeline."""
    kept = segments.drop("pos").join(sequence.withColumnRenamed("position", "pos"), ["project_id", "feature_id"])
    return timeline(kept)


def budget_violations(decisions: DataFrame, sequence: DataFrame, durations: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """(project_id, rule) of a budget: decisions (project_id, feature_id, action), a sequence (project_id, position, feature_id) and what was rendered, durations (project_id, feature_id, aspect, duration_ms, editorial_role).

    Ids are unique in both lists, the sequence is the kept set, decisions cover what was rendered, both aspects last
    equally long, the sequence's time is in range, and a hook and a closing are in it.
    """
    key = ["project_id", "feature_id"]
    of = lambda df, rule: df.select("project_id", F.lit(rule).alias("rule")).distinct()
    twice = lambda df, rule: of(df.groupBy(*key).count().where("count > 1"), rule)
    kept, rendered = decisions.where("action = 'keep'"), durations.select(*key).distinct()
    differ = kept.select(*key).distinct().join(sequence, key, "left_anti").unionByName(sequence.select(*key).distinct().join(kept, key, "left_anti"))
    uncovered = rendered.join(decisions, key, "left_anti").unionByName(decisions.select(*key).distinct().join(rendered, key, "left_anti"))
    uneven = durations.groupBy(*key).agg(F.count_distinct("duration_ms").alias("n")).where("n > 1")
    one = durations.groupBy(*key).agg(F.max("duration_ms").alias("duration_ms"), F.max("editorial_role").alias("editorial_role"))
    total = decisions.select("project_id").distinct().join(sequence.join(one, key, "left"), "project_id", "left").groupBy("project_id").agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total"), F.count_if(F.col("editorial_role") == "hook").alias("hooks"), F.count_if(F.col("editorial_role") == "closing").alias("closings"))
    said = F.array_compact(F.array(F.when(~F.col("total").between(least_ms, most_ms), F.lit("total_time")), F.when(F.col("hooks") == 0, F.lit("no_hook")), F.when(F.col("closings") == 0, F.lit("no_closing"))))
    out = total.select("project_id", F.explode(said).alias("rule"))
    for part in (twice(decisions, "duplicate_decision"), twice(sequence, "duplicate_in_sequence"), of(differ, "sequence_not_kept_set"), of(uncovered, "decisions_not_covering"), of(uneven, "aspects_differ")):
        out = out.unionByName(part)
    return out


def budget_check(segments: DataFrame, least_ms: int, most_ms: int) -> DataFrame:
    """(project_id, kept, total_ms, in_budget, has_hook, has_closing, passed) of the kept segments."""
    k = segments.where("keep")
    g = k.groupBy("project_id").agg(F.count("*").alias("kept"), F.sum("duration_ms").alias("total_ms"), F.max(F.col("editorial_role") == "hook").alias("has_hook"), F.max(F.col("editorial_role") == "closing").alias("has_closing"))
    g = g.withColumn("in_budget", F.col("total_ms").between(least_ms, most_ms))
    return g.withColumn("passed", F.col("in_budget") & F.col("has_hook") & F.col("has_closing"))


def open_edit_violations(segments: DataFrame, shots: tuple[int, int] = (10, 16), ms: tuple[int, int] = (60_000, 90_000)) -> DataFrame:
    """(project_id, rule): number of shots, total time, hook first, closing last, no repeated feature."""
    g = segments.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.min_by("editorial_role", "pos").alias("first"), F.max_by("editorial_role", "pos").alias("last"), F.count_distinct("feature_id").alias("features"))
    rules = F.array_compact(F.array(F.when(~F.col("n").between(*shots), F.lit("shot_count")), F.when(~F.col("total").between(*ms), F.lit("total_time")), F.when(F.col("first") != "hook", F.lit("first_not_hook")), F.when(F.col("last") != "closing", F.lit("last_not_closing")), F.when(F.col("features") < F.col("n"), F.lit("repeated_feature"))))
    return g.select("project_id", F.explode(rules).alias("rule"))


def rushes_violations(timelines: DataFrame, shots: DataFrame) -> DataFrame:
    """(project_id, rule): timelines (project_id, aspect_ratio) are exactly one of 16:9 and one of 9:16; no select_id of shots (project_id, aspect_ratio, select_id) stands twice in one."""
    one = lambda a: F.count_if(F.col("aspect_ratio") == a) == 1
    g = timelines.groupBy("project_id").agg((one("16:9") & one("9:16") & (F.count("*") == 2)).alias("both"))
    twice = shots.groupBy("project_id", "aspect_ratio", "select_id").count().where("count > 1").select("project_id", F.lit("duplicate_select").alias("rule")).distinct()
    return g.where("NOT both").select("project_id", F.lit("aspects").alias("rule")).unionByName(twice)


def narrative_trims(segments: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, feature_id, rule): each chapter's trim (source_in_ms, source_out_ms) lies in its event (event_id, event_start, event_end), and its asset is the event's."""
    e = events.withColumnRenamed("asset_id", "_asset")
    inside = (F.col("event_start") <= F.col("source_in_ms")) & (F.col("source_in_ms") < F.col("source_out_ms")) & (F.col("source_out_ms") <= F.col("event_end"))
    rule = F.when(F.col("_asset").isNull(), "unknown_event").when(F.col("_asset") != F.col("asset_id"), "wrong_asset").when(~inside, "outside_event")
    return segments.join(e, "event_id", "left").select("project_id", "feature_id", rule.alias("rule")).where("rule IS NOT NULL")


def narrative_violations(segments: DataFrame, expected: DataFrame, ms: tuple[int, int] = (60_000, 90_000)) -> DataFrame:
    """(project_id, rule): order from 1 without gaps, every expected feature once, total time; see narrative_trims() too."""
    g = segments.groupBy("project_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.sum("duration_ms").alias("total"))
    rules = F.array_compact(F.array(F.when((F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("d") != F.col("n")), F.lit("order")), F.when(~F.col("total").between(*ms), F.lit("total_time"))))
    missing = expected.join(segments, ["project_id", "feature_id"], "left_anti").select("project_id", F.lit("missing_feature").alias("rule")).distinct()
    return g.select("project_id", F.explode(rules).alias("rule")).unionByName(missing)


def duration_ms(given: Column, start: Column, end: Column) -> Column:
    """The given duration, else out minus in; null where neither is usable."""
    return F.coalesce(given, F.when(end > start, end - start))


def same_ids(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of ids that only one of the two has."""
    # dealt by id first: a task then counts a part of the ids once, not all that it reads
    both = a.select(*keys, F.lit(True).alias("_left")).unionByName(b.select(*keys, F.lit(False).alias("_left"))).repartition(*keys)
    g = both.groupBy(*keys).agg(F.min("_left").alias("_all"), F.max("_left").alias("_any")).where("_all = _any")
    return g.select(*keys, F.when(F.col("_any"), "left").otherwise("right").alias("side"))


def review_reasons(segments: DataFrame) -> DataFrame:
    """segments with reasons: what the producer knows and one look at the final picture cannot waive.

    Columns requires_review, coverage_passed, containment_feasible, controlled_clip (each may be
    null: not said), fallback_reason and risk_codes (an array).
    """
    say = lambda when, reason: F.when(when, F.lit(reason))
    facts = F.array_compact(F.array(
        say(F.col("requires_review"), "manifest_requires_gemini_review"), say(~F.col("coverage_passed"), "required_region_tracking_coverage_failed"), say(~F.col("containment_feasible"), "required_region_full_containment_infeasible"),
        say(F.col("controlled_clip"), "controlled_required_region_clip"), F.when(F.col("fallback_reason") != "", F.concat(F.lit("fallback:"), "fallback_reason")),
    ))
    risks = F.transform(F.filter(F.transform(F.coalesce("risk_codes", F.array().cast("array<string>")), lambda r: F.btrim(r)), lambda r: r != ""), lambda r: F.concat(F.lit("risk:"), r))
    return segments.withColumn("reasons", F.array_distinct(F.concat(facts, risks)))


def judged(observations: DataFrame) -> DataFrame:
    """observations with critical and clean, from semantic_match, target_visibility, important_text_status and issues (an array)."""
    text, issues = F.col("important_text_status"), F.coalesce("issues", F.array().cast("array<string>"))
    wrong = F.arrays_overlap(issues, F.array(F.lit("identity_mismatch"), F.lit("semantic_mismatch")))
    critical = (F.col("semantic_match") == "mismatch") | (F.col("target_visibility") == "not_visible") | text.isin("not_visible", "unreadable") | wrong
    clean = (F.col("semantic_match") == "match") & (F.col("target_visibility") == "clearly_visible") & text.isin("not_applicable", "complete") & (F.size(issues) == 0)
    return observations.withColumns({"critical": F.coalesce(critical, F.lit(False)), "clean": F.coalesce(clean, F.lit(False))})


def qa_verdict(observations: DataFrame, contract: DataFrame) -> DataFrame:
    """(project_id, verdict): reject if any observation is critical, pass if all are clean and no segment of the contract has reasons, else review."""
    g = judged(observations).groupBy("project_id").agg(F.max("critical").alias("critical"), F.min("clean").alias("clean"))
    open_ = contract.groupBy("project_id").agg(F.max(F.size("reasons") > 0).alias("open"))
    verdict = F.when(F.col("critical"), "reject").when(F.col("clean") & ~F.coalesce("open", F.lit(False)), "pass").otherwise("review")
    return g.join(open_, "project_id", "left").select("project_id", verdict.alias("verdict"))


# fields of a chapter, and of a value in one, that hold text; lists of regions; the kinds of region whose text counts
TEXT_FIELDS = ["important_text", "important_text_description", "required_text", "required_visible_text", "text_requirements"]
VALUE_FIELDS = ["text", "description", "target_description", "expected", "value", "label"]
REGION_FIELDS = ["reframe_regions", "vertical_regions", "target_regions"]
TEXT_KINDS = ["text", "text_region", "ui_text", "signage"]


def _field(x: Column, name: str, kind: str) -> Column:
    """A field of a struct, null where it is empty or the type has none."""
    return F.when(x[name] != "", x[name]) if re.search(rf"[<,]{name}:", kind) else F.lit(None).cast("string")


def _walk(kind: str):
    return lambda x: F.array(*[_field(x, name, kind) for name in VALUE_FIELDS])


def _region_texts(name: str, kind: str) -> Column:
    def counts(r: Column) -> Column:
        sort = F.lower(F.coalesce(*[_field(r, k, kind) for k in ("semantic_kind", "region_kind", "kind")], F.lit("")))
        return sort.isin(TEXT_KINDS) & (F.lower(F.coalesce(_field(r, "role", kind), F.lit("required"))) == "required")

    return F.flatten(F.transform(F.filter(name, counts), _walk(kind)))


def important_text(chapters: DataFrame) -> DataFrame:
    """chapters with important_text: what must be legible, each text once, in the order of the fields.

    TEXT_FIELDS are arrays of text or of structs of VALUE_FIELDS, REGION_FIELDS are arrays of structs of VALUE_FIELDS and any of
    semantic_kind, region_kind, kind and role (null: required); fields that are missing or null say nothing. Only required regions of text count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    none = F.array().cast("array<string>")
    given = [f for f in (*TEXT_FIELDS, *REGION_FIELDS) if f in kinds]
    parts = [_region_texts(f, kinds[f]) if f in REGION_FIELDS else F.col(f) if kinds[f] == "array<string>" else F.flatten(F.transform(f, _walk(kinds[f]))) for f in given]
    said = F.concat(none, *[F.coalesce(p, none) for p in parts])
    trimmed = F.transform(F.array_compact(said), lambda x: F.btrim(x))
    return chapters.withColumn("important_text", F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def segment_contract(chapters: DataFrame) -> DataFrame:
    """The rows a QA job gets, with start_ms and end_ms on the timeline, and rule for a chapter that is no segment: no_feature, no_identity, no_duration, duplicate_identity.

    chapters: project_id, pos, feature_id, segment_id, segment_path, segment_render_fingerprint (the first that is given names the
    segment), expected_semantics, semantic_intent, target_description (the first that is given is expected), duration_ms or
    source_in_ms and source_out_ms, the fields of review_reasons() and of important_text(); vertical_regions have region_id and kind.
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.regexp_extract("segment_path", "([^/]*)/*$", 1)
    segment = F.coalesce(given("segment_id"), F.when(F.col("segment_path") != "", F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")), F.substring(given("segment_render_fingerprint"), 1, 16))
    expected = F.coalesce(given("expected_semantics"), given("semantic_intent"), given("target_description"), F.lit("No explicit semantic expectation was recorded; observe conservatively."))
    time = F.coalesce("duration_ms", F.col("source_out_ms") - F.col("source_in_ms"))
    region = lambda r: F.struct(F.coalesce(r["region_id"], F.lit("")).alias("region_id"), F.coalesce(F.when(r["kind"] != "", r["kind"]), F.lit("other")).alias("kind"), F.coalesce(r["target_description"], F.lit("")).alias("target_description"))
    regions = F.transform(F.filter("vertical_regions", lambda r: F.coalesce(F.when(r["role"] != "", r["role"]), F.lit("required")) == "required"), region)
    c = review_reasons(important_text(chapters)).withColumns({"segment_id": segment, "expected_semantics": expected, "duration_ms": time, "required_regions": F.coalesce(regions, F.array().cast("array<struct<region_id:string,kind:string,target_description:string>>"))})
    again = F.row_number().over(W.partitionBy("project_id", "feature_id", "segment_id").orderBy("pos")) > 1
    rule = F.when(F.coalesce(F.col("feature_id").cast("string"), F.lit("")) == "", "no_feature").when(F.col("segment_id").isNull(), "no_identity").when(F.coalesce(F.col("duration_ms"), F.lit(0)) <= 0, "no_duration").when(again, "duplicate_identity")
    columns = ["project_id", "feature_id", "segment_id", "pos", "start_ms", "end_ms", "duration_ms", "expected_semantics", "target_description", "important_text", "required_regions", "requires_review", "risk_codes", "reasons"]
    return timeline(c).select(*columns, (F.size("important_text") > 0).alias("text_check"), rule.alias("rule"))


def qa_result_mismatches(contract: DataFrame, result: DataFrame) -> DataFrame:
    """(project_id, pos, rule): the result has the same segments in the same order, and a text check where one is due."""
    r = result.select("project_id", "pos", F.col("feature_id").alias("got"), F.col("text_check").alias("checked"))
    both = contract.join(r, ["project_id", "pos"], "full")
    rule = F.when(F.col("got").isNull(), "missing").when(F.col("feature_id").isNull(), "extra").when(F.col("got") != F.col("feature_id"), "wrong_segment").when(F.col("checked") != F.col("text_check"), "text_check")
    return both.select("project_id", "pos", rule.alias("rule")).where("rule IS NOT NULL")


def render_violations(renders: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, rule): what a file is (sha256, width, height, duration_ms) against what its manifest declares (declared_*), and its chapters.

    The hash and the size are the declared ones, the picture is 9:16, and the time is within
    250 ms of the declared one and within 500 ms of the chapters'; each chapter has a time.
    """
    total = segments.groupBy("project_id").agg(F.sum("duration_ms").alias("total"), F.count_if(F.coalesce(F.col("duration_ms"), F.lit(0)) <= 0).alias("without"))
    say = lambda when, rule: F.when(when, F.lit(rule))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"declared_{c}"))
    rules = F.array_compact(F.array(
        say(differs("sha256"), "hash"), say((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("width") * 16 != F.col("height") * 9), "aspect"), say(differs("width") | differs("height"), "size"),
        say((F.col("duration_ms") <= 0) | (F.abs(F.col("duration_ms") - F.coalesce("declared_duration_ms", F.lit(0))) > 250), "declared_duration"), say(F.col("without").isNull(), "no_chapters"), say(F.col("without") > 0, "chapter_without_time"), say(F.abs(F.col("duration_ms") - F.col("total")) > 500, "duration"),
    ))
    return renders.join(total, "project_id", "left").select("project_id", F.explode(rules).alias("rule"))


def text_consensus(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, text, votes, total, matches, methods_agree, status) for claims (claim_id, claim_text, selected_text) and their readings (claim_id, pos, relevant_text).

    The most frequent normalized reading wins, the first seen on a tie; readings that are empty
    once normalized have no vote, but count in total. text is the first reading that says it. status:
    machine_verified if all readings agree and say the claim's text; needs_human_review if they
    agree on something else, or if a second method chose another text (selected_text, null if
    it was not asked); else uncertain.
    """
    n = observations.withColumn("key", normalized(F.col("relevant_text")))
    seen = n.groupBy("claim_id", "key").agg(F.count("*").alias("votes"), F.min(F.struct("pos", "relevant_text")).alias("first"))
    order = F.struct((F.col("key") != "").alias("has"), "votes", (-F.col("first.pos")).alias("early"))
    g = seen.groupBy("claim_id").agg(F.max_by(F.struct("key", "votes", "first"), F.when(F.col("key") != "", order).otherwise(F.struct(F.lit(False).alias("has"), F.lit(0).cast("long").alias("votes"), F.lit(0).cast("long").alias("early")))).alias("x"), F.sum("votes").alias("total"))
    key, votes = F.col("x.key"), F.when(F.col("x.key") != "", F.col("x.votes")).otherwise(0)
    both = g.join(claims, "claim_id").withColumns({"votes": votes, "matches": key == normalized(F.col("claim_text")), "methods_agree": F.col("selected_text").isNull() | (normalized(F.col("selected_text")) == key)})
    unanimous = (key != "") & (F.col("votes") == F.col("total"))
    status = F.when(~F.col("methods_agree") | (unanimous & ~F.col("matches")), "needs_human_review").when(unanimous, "machine_verified").otherwise("uncertain")
    return both.select("claim_id", F.col("x.first.relevant_text").alias("text"), "votes", "total", "matches", "methods_agree", status.alias("status"))
