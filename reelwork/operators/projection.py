"""What a plan's choices mean for the renderer: chapters with ranked candidates of both aspects and the regions to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwork.functions.text import safe_token
from reelwork.operators.candidates import region_kind

REGION = "struct<region_id: string, entity_id: string, target_description: string, kind: string, role: string, atomic: boolean, minimum_visible_fraction: double, observable_relations: array<string>>"
MOST_REGIONS = 8

# fixed values: what a chapter without evidence says, and how an event may relate to an entity, in order
NOT_FOUND = {"observed": "No supported Clip Card evidence was selected.", "reason": "The evidence-bound planner returned not_found.", "risk": "No supported source evidence."}
RELATIONS = {"event_member": "entity_ids", "primary": "primary_ids", "required": "required_ids", "optional": "optional_ids", "avoid_overlay": "avoid_overlay_ids"}
SAID = (*RELATIONS, "grounding_target")
KINDS = ("text_region", "ui_region", "graphic", "other", "subject")
ROLE_OF_CONSTRAINT = {"hard_core": "required", "soft_extent": "preferred", "overlay_keepout": "avoid_overlay"}
UNION_PREFIX = "Preserve the union of all required framing regions: "
CLIP_RISK = "model_proposed_controlled_clip_requires_human_policy"

# what names a candidate's entities, what goes to its event, and what that answers
NAMING = ("focus_id", "required", "preferred")
ASKED = ("asset_id", "event_id", "asked")
ANSWER = ("known", "overlay", "facts")
_SHARED = ("asset_id", "event_id", "frame_id", "observed_visual_evidence", "selection_reason")
DESCRIBED = ("position", "candidate_id", *_SHARED, "horizontal_strategy", "zoom_intent", "vertical_strategy", "crop_mode", "quality_risks", "confidence")


def _first(items: Column, keep) -> Column:
    return F.get(F.filter(items, keep), F.lit(0))


def _note(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}="), value)


def entity_text(entity_id: Column) -> Column:
    """How an event's row (targets, entities) describes an entity: the grounding target's words, else its label and features, else its label; null if the event does not know it."""
    target = _first(F.col("targets"), lambda t: t["entity_id"] == entity_id)
    entity = _first(F.col("entities"), lambda e: e["entity_id"] == entity_id)
    features = F.regexp_replace(entity["features"], r"(?U)^\s+|\s+$", "")
    return F.coalesce(target["target_description"], F.when(features != "", F.concat(entity["label"], F.lit("; "), features)), entity["label"])


def entity_facts() -> Column:
    """What an event's row says of each entity that it names: (entity_id, fact). A fact is a number and, behind a blank, the entity's text; the number is the place of its kind in KINDS, times 64, and a bit for each of SAID that holds."""
    none = F.array().cast("array<string>")
    ids_of = lambda c: F.coalesce(F.transform(c, lambda x: x["entity_id"]), none)
    ids = F.array_distinct(F.concat(ids_of("entities"), ids_of("targets"), *[F.coalesce(c, none) for c in RELATIONS.values()]))

    def said(e: Column) -> Column:
        kind = region_kind(_first(F.col("entities"), lambda x: x["entity_id"] == e)["kind"])
        holds = [*[F.array_contains(F.col(c), e) for c in RELATIONS.values()], F.exists("targets", lambda t: t["entity_id"] == e)]
        return sum((F.when(x, 2**i).otherwise(0) for i, x in enumerate(holds)), 64 * (F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1))

    return F.transform(ids, lambda e: F.struct(e.alias("entity_id"), F.concat_ws(" ", said(e).cast("string"), entity_text(e)).alias("fact")))


def _fact_number(fact: Column) -> Column:
    return F.substring_index(fact, " ", 1).cast("int")


def _fact_text(fact: Column) -> Column:
    return F.get(F.split(fact, " ", 2), F.lit(1))


def _asked(focus_id: Column, required: Column, preferred: Column) -> Column:
    """The entities that a candidate names. That doesn't hang on its crop, so that the rows that go to the events hold nothing else."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array_compact(F.array(focus_id)), F.coalesce(required, none), F.coalesce(preferred, none)))


def _ids(asked: Column, overlay: Column) -> Column:
    """The entities that an answer tells of."""
    return F.array_distinct(F.concat(asked, F.coalesce(overlay, F.array().cast("array<string>"))))


def _answered(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """candidates with asked and ANSWER: known, overlay, and facts, one for each of _ids(). Of several rows of one event the least counts, so that each row is answered once."""
    told = events.select("asset_id", "event_id", F.struct("avoid_overlay_ids", entity_facts().alias("of")).alias("_facts")).groupBy("asset_id", "event_id").agg(F.min("_facts").alias("_facts"))
    facts = F.col("_facts")["of"]
    rows = candidates.withColumn("asked", _asked(*map(F.col, NAMING))).join(told, ["asset_id", "event_id"], "left").withColumns({"known": F.col("_facts").isNotNull(), "overlay": F.col("_facts")["avoid_overlay_ids"]})
    return rows.withColumn("facts", F.transform(_ids(F.col("asked"), F.col("overlay")), lambda e: F.get(facts["fact"], _place(facts["entity_id"], e)))).drop("_facts")


def _place(items: Column, item: Column) -> Column:
    """Where an array holds an item, from 0; -1 if it doesn't, which get() takes for null."""
    return (F.array_position(items, item) - 1).cast("int")


def _regions_of(c: Column, a: Column, preferred: Column, fact) -> Column:
    """(id, role, text, number) of the regions of a candidate with its answer: required entities, then preferred ones, then those not to be covered, each once by its first role; none unless the crop is tracked."""
    required = c["required"]
    overlay = F.filter(a["overlay"], lambda e: ~F.array_contains(required, e) & ~F.array_contains(preferred, e) & ~F.array_contains(c["sacrificable"], e))
    named = lambda ids, role: F.transform(ids, lambda e: F.struct(e.alias("id"), F.lit(role).alias("role"), _fact_text(fact(e)).alias("text"), _fact_number(fact(e)).alias("number")))
    return F.when(c["vertical_strategy"] == "tracked_crop", F.concat(named(required, "required"), named(preferred, "preferred"), named(overlay, "avoid_overlay"))).otherwise(F.slice(named(required, "required"), 1, 0))


def _region(c: Column, token: Column, x: Column) -> Column:
    """A region (id, role, text, number) of a candidate, whose id as a token is given."""
    must, known = x["role"] == "required", F.coalesce(x["number"], F.lit(64 * KINDS.index("subject")))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.shiftright(known, 6))
    relations = F.concat(F.array_compact(F.array(*[F.when(known.bitwiseAND(2**i) > 0, F.lit(f"event_relation={name}")) for i, name in enumerate(SAID)])), F.array(_note("editorial_framing_intent", c["framing_intent"])))
    return F.struct(
        F.concat_ws(".", token, x["role"], safe_token(x["id"])).alias("region_id"), x["id"].alias("entity_id"), x["text"].alias("target_description"), kind.alias("kind"), x["role"].alias("role"),
        (must & kind.isin("text_region", "ui_region", "graphic")).alias("atomic"), F.when(must, F.lit(1.0)).alias("minimum_visible_fraction"), relations.alias("observable_relations"),
    )


def _pair(c: Column, a: Column) -> Column:
    """A candidate and its answer, with the entities that the answer tells of and the preferred ones that aren't required."""
    return F.struct(c.alias("c"), a.alias("a"), _ids(a["asked"], a["overlay"]).alias("ids"), F.filter(c["preferred"], lambda e: ~F.array_contains(c["required"], e)).alias("preferred"))


def _described(pairs: Column) -> Column:
    """_pair()s as candidates with horizontal_target, vertical_target, regions and _rule, what is wrong with it."""

    def named(p: Column) -> Column:
        c, a = p["c"], p["a"]
        fact = lambda e: F.get(a["facts"], _place(p["ids"], e))
        texts = F.transform(c["required"], lambda e: _fact_text(fact(e)))
        return F.struct(c.alias("c"), a["known"].alias("known"), _regions_of(c, a, p["preferred"], fact).alias("named"), texts.alias("texts"), _fact_text(fact(c["focus_id"])).alias("focus"), safe_token(c["candidate_id"]).alias("token"))

    def card(p: Column) -> Column:
        c = p["c"]
        unknown = (c["focus_id"].isNotNull() & p["focus"].isNull()) | F.exists(p["texts"], lambda t: t.isNull()) | F.exists(p["named"], lambda x: x["text"].isNull())
        rule = F.when(~p["known"], "event_missing").when(unknown, "entity_missing").when(F.size(p["named"]) > MOST_REGIONS, "too_many_regions")
        made = {"horizontal_target": p["focus"], "vertical_target": F.when(F.size(c["required"]) > 0, F.array_join(p["texts"], " | ")), "regions": F.transform(p["named"], lambda x: _region(c, p["token"], x)), "_rule": rule}
        return F.struct(*[c[f].alias(f) for f in DESCRIBED], *[v.alias(f) for f, v in made.items()])

    return F.transform(F.transform(pairs, named), card)


def union_regions(regions: Column) -> Column:
    """Regions over several entities (region_id, target_description, kind, constraint_role, atomic, observable_relation, refs) as one region for each entity."""

    def members(r: Column) -> Column:
        several = F.size(r["refs"]) > 1
        role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_OF_CONSTRAINT.items() for x in pair]), r["constraint_role"])

        def member(ref: Column, i: Column) -> Column:
            said = F.concat(r["target_description"], F.lit("; exact member entity_id="), ref["entity_id"], F.lit(", event_relation="), ref["event_relation"])
            return F.struct(
                F.when(several, F.concat(r["region_id"], F.lit(".member-"), (i + 1).cast("string"))).otherwise(r["region_id"]).alias("region_id"), ref["entity_id"].alias("entity_id"), F.when(several, said).otherwise(r["target_description"]).alias("target_description"),
                r["kind"].alias("kind"), role.alias("role"), r["atomic"].alias("atomic"), F.when((r["constraint_role"] == "hard_core") | r["atomic"], F.lit(1.0)).alias("minimum_visible_fraction"), F.array(_note("event_relation", ref["event_relation"]), r["observable_relation"]).alias("observable_relations"),
            )

        return F.transform(r["refs"], member)

    return F.flatten(F.transform(regions, members))


def _chapters(chapters: DataFrame, candidates: DataFrame) -> DataFrame:
    """chapters with cards, their candidates as an array in order of position."""
    card = F.struct("position", *[c for c in candidates.columns if c not in ("chapter", "position")])
    return chapters.join(candidates.groupBy("chapter").agg(F.array_sort(F.collect_list(card), lambda a, b: a["position"] - b["position"]).alias("cards")), "chapter", "left")


def _selected_first(selected: str) -> Column:
    chosen = lambda c: c["candidate_id"] == F.col(selected)
    return F.concat(F.filter("cards", chosen), F.filter("cards", lambda c: ~chosen(c)))


def _ranked(cards: Column, *own: tuple[str, str]) -> Column:
    """The candidates of an aspect in order, with ranks from 1 and the fields that only it has (name, field)."""
    return F.transform(cards, lambda c, i: F.struct(c["candidate_id"].alias("candidate_id"), (i + 1).cast("int").alias("rank"), *[c[f].alias(f) for f in _SHARED], *[c[f].alias(n) for n, f in own], c["quality_risks"].alias("quality_risks"), c["confidence"].alias("confidence")))


HORIZONTAL = (("strategy", "horizontal_strategy"), ("zoom_intent", "zoom_intent"), ("target_description", "horizontal_target"))
VERTICAL = (("strategy", "vertical_strategy"), ("crop_mode", "crop_mode"), ("target_description", "vertical_target"), ("regions", "regions"))


def _with_options(df: DataFrame) -> DataFrame:
    """df with h and v, the selected candidates, and all candidates ranked for each aspect."""
    df = df.withColumns({"_h": _selected_first("horizontal_candidate_id"), "_v": _selected_first("vertical_candidate_id")})
    return df.withColumns({"h": F.get("_h", F.lit(0)), "v": F.get("_v", F.lit(0)), "horizontal_candidates": _ranked(F.col("_h"), *HORIZONTAL), "vertical_candidates": _ranked(F.col("_v"), *VERTICAL)}).drop("_h", "_v")


def _heads() -> list[Column]:
    """The fields of a chapter that come from its selected candidates."""
    h, v = F.col("h"), F.col("v")
    return [
        h["frame_id"].alias("horizontal_frame_id"), v["frame_id"].alias("vertical_frame_id"), h["horizontal_strategy"].alias("horizontal_strategy"), h["zoom_intent"].alias("horizontal_zoom_intent"), h["horizontal_target"].alias("horizontal_target_description"),
        v["vertical_strategy"].alias("vertical_strategy"), v["vertical_target"].alias("vertical_target_description"), F.least(h["confidence"], v["confidence"]).alias("confidence"),
    ]


def described_candidates(candidates: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with horizontal_target, vertical_target and regions, violations (chapter, candidate_id, rule)).

    candidates: chapter, position, candidate_id, asset_id, event_id, frame_id, observed_visual_evidence, selection_reason, quality_risks,
    horizontal_strategy, zoom_intent, focus_id, vertical_strategy, crop_mode, framing_intent, required, preferred, sacrificable,
    confidence. events: asset_id, event_id, the id lists of RELATIONS, entities (entity_id, kind, label, features) and targets
    (entity_id, target_description).
    """
    pair = _pair(F.struct(*candidates.columns), F.struct(*ASKED, *ANSWER))
    described = _answered(candidates, events).select("chapter", F.get(_described(F.array(pair)), F.lit(0)).alias("x")).select("chapter", "x.*")
    return described.drop("_rule"), described.where("_rule IS NOT NULL").select("chapter", "candidate_id", F.col("_rule").alias("rule"))


def _described_chapters(chapters: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """chapters with cards, their described candidates in order of position.

    Only what a candidate asks goes to its event and only the answer comes back to the chapter; all else of it stays where the chapter is.
    A chapter's candidates and answers are as many and, in order of what was asked, in the same order.
    """
    own = [c for c in candidates.columns if c != "chapter"]
    cards = candidates.groupBy("chapter").agg(F.collect_list(F.struct(*own)).alias("_cards"))
    answered = _answered(candidates.select("chapter", "asset_id", "event_id", *NAMING), events).select("chapter", F.struct(*ASKED, *ANSWER).alias("_answer"))
    # an answer travels as one text: fields of a row, and items of an array, take 8 bytes each that compress badly
    kind = answered.schema["_answer"].dataType
    # the session's number of partitions is kept as it is: Spark would put several together by their narrow rows, whose wide cards then don't fit in a task's memory
    parts = int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = answered.select("chapter", F.to_json("_answer").alias("_answer")).repartition(parts, "chapter").groupBy("chapter").agg(F.collect_list("_answer").alias("_answers"))
    key = lambda x, asked: F.struct(x["asset_id"].alias("asset_id"), x["event_id"].alias("event_id"), asked.alias("asked"))
    asking = F.transform("_cards", lambda c: F.struct(key(c, _asked(*[c[f] for f in NAMING])).alias("key"), c.alias("c")))
    same = lambda x, a: F.when(x["key"].eqNullSafe(key(a, a["asked"])), _pair(x["c"], a)).otherwise(F.raise_error(F.lit("an answer without its candidate")))
    pairs = F.zip_with(F.array_sort(asking), F.array_sort(F.transform("_answers", lambda a: F.from_json(a, kind))), same)
    return chapters.join(cards, "chapter", "left").join(answers, "chapter", "left").select(*chapters.columns, F.array_sort(_described(pairs)).alias("cards"))


def selection_violations(chapters: DataFrame, candidates: DataFrame) -> DataFrame:
    """(chapter, aspect, rule): a chapter with evidence selects one of its candidates for each aspect."""
    held = candidates.select("chapter", "candidate_id", F.lit(True).alias("held")).distinct()
    each = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_candidate_id").alias("candidate_id")) for a in ("horizontal", "vertical")])
    asked = chapters.where("evidence_status <> 'not_found'").select("chapter", F.explode(each).alias("x")).select("chapter", "x.*").join(held, ["chapter", "candidate_id"], "left")
    return asked.where("held IS NULL").select("chapter", "aspect", F.when(F.col("candidate_id").isNull(), "selection_missing").otherwise("selection_unknown").alias("rule"))


def projected_choices(chapters: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """project_choices() as one frame, so that no candidate is described a second time to find out what is wrong: chapters for the renderer with rule null, and a row (chapter, rule) for each rule that a chapter breaks."""
    found = _described_chapters(chapters.where("evidence_status <> 'not_found' AND chapter IS NOT NULL"), candidates, events)
    held = lambda name: F.coalesce(F.exists("cards", lambda c: c["candidate_id"] == F.col(name)), F.lit(False))
    selected = [F.when(~held(n), F.when(F.col(n).isNull(), "selection_missing").otherwise("selection_unknown")) for n in ("horizontal_candidate_id", "vertical_candidate_id")]
    broken = F.array_compact(F.concat(F.coalesce(F.transform("cards", lambda c: c["_rule"]), F.array().cast("array<string>")), F.array(*selected)))
    found = found.withColumn("_rules", F.array_distinct(broken)).withColumn("rule", F.explode_outer("_rules"))
    p = _with_options(found.withColumn("cards", F.when(F.col("rule").isNull(), F.col("cards"))))
    h, v = F.col("h"), F.col("v")
    both = lambda f: F.when(h["candidate_id"] == v["candidate_id"], h[f]).otherwise(F.concat(F.lit("16:9: "), h[f], F.lit(" 9:16: "), v[f]))
    made = p.select(
        "chapter", "evidence_status", both("observed_visual_evidence").alias("observed_visual_evidence"), both("selection_reason").alias("selection_reason"), F.array_distinct(F.concat(h["quality_risks"], v["quality_risks"])).alias("quality_risks"), *_heads(), "horizontal_candidates", "vertical_candidates", "rule",
    )
    none = chapters.where("evidence_status = 'not_found'").select(
        "chapter", "evidence_status", F.lit(NOT_FOUND["observed"]).alias("observed_visual_evidence"), F.lit(NOT_FOUND["reason"]).alias("selection_reason"), F.array(F.lit(NOT_FOUND["risk"])).alias("quality_risks"),
        F.lit("original").alias("horizontal_strategy"), F.lit("none").alias("horizontal_zoom_intent"), F.lit("fit_with_background").alias("vertical_strategy"), F.lit(0.0).alias("confidence"),
    )
    empty = {c: F.array().cast(made.schema[c].dataType) for c in ("horizontal_candidates", "vertical_candidates")}
    return made.unionByName(none.withColumns(empty), allowMissingColumns=True)


def project_choices(chapters: DataFrame, candidates: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters for the renderer, violations (chapter, rule)) of a plan that holds choices only; descriptions and regions come from the events.

    chapters: chapter, evidence_status, horizontal_candidate_id, vertical_candidate_id. A chapter without evidence has fixed
    words and no candidates; one with a violation is left out. Candidates are as in described_candidates().
    """
    every = projected_choices(chapters, candidates, events)
    return every.where("rule IS NULL").drop("rule"), every.where("rule IS NOT NULL").select("chapter", "rule").distinct()


def project_resolved(chapters: DataFrame, candidates: DataFrame, with_candidates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chapters for the renderer, violations) of a plan whose chapters say themselves what is shown and whose candidates have their own targets and resolved regions.

    Candidates have horizontal_target, vertical_target and regions (as union_regions() takes them); all else in chapters goes
    through. The oldest form of plan has no candidates: with_candidates is false, and their lists are empty.
    """
    own = candidates.withColumn("regions", union_regions(F.col("regions")))
    violations = selection_violations(chapters, candidates).select("chapter", "rule").distinct() if with_candidates else chapters.select("chapter", F.lit("").alias("rule")).where(F.lit(False))
    p = _with_options(_chapters(chapters.join(violations.select("chapter"), "chapter", "left_anti"), own))
    lists = ["horizontal_candidates", "vertical_candidates"]
    held = {c: F.coalesce(c, F.array().cast(p.schema[c].dataType)) if with_candidates else F.array().cast(p.schema[c].dataType) for c in lists}
    return p.withColumns(held).select(*[c for c in chapters.columns if c not in ("horizontal_candidate_id", "vertical_candidate_id")], *lists), violations


def region_union_text(target: Column, regions: Column) -> Column:
    """The target's words, else one text for all required regions in order of their ids, else null."""
    required = F.array_sort(F.filter(regions, lambda r: r["role"] == "required"), lambda a, b: F.when(a["region_id"] < b["region_id"], -1).when(a["region_id"] > b["region_id"], 1).otherwise(0))
    said = F.transform(required, lambda r: F.concat(F.lit("region_id="), r["region_id"], F.lit(", kind="), r["kind"], F.lit(", target="), r["target_description"]))
    return F.when(F.coalesce(target, F.lit("")) != "", target).when(F.size(required) > 0, F.concat(F.lit(UNION_PREFIX), F.array_join(said, "; ")))


def project_open_edit(shots: DataFrame, candidates: DataFrame, with_candidates: bool = True) -> tuple[DataFrame, DataFrame]:
    """((chapter, brief, selected, audit), violations) of an open edit: the brief, the chapter for the renderer and the trim plan's record of each shot.

    shots: chapter, title, editorial_role, intended_effect, target_duration_seconds, horizontal_candidate_id, vertical_candidate_id.
    Candidates have horizontal_target, vertical_target (may be null), regions (REGION) and overflow_proposal (null: none).
    """
    own = candidates.withColumn("vertical_target", region_union_text(F.col("vertical_target"), F.col("regions")))
    told = shots.withColumn("evidence_status", F.lit("supported"))
    violations = selection_violations(told, candidates).select("chapter", "rule").distinct()
    p = _with_options(_chapters(told.join(violations.select("chapter"), "chapter", "left_anti"), own))
    h, v = F.col("h"), F.col("v")
    brief = F.struct(
        "title", F.array(_note("editorial_role", F.col("editorial_role")), F.col("intended_effect")).alias("detail_lines"), "target_duration_seconds", F.when(v["vertical_strategy"] == "tracked_crop", v["vertical_target"]).alias("vertical_primary_target_description"),
        v["crop_mode"].alias("vertical_crop_mode"), v["regions"].alias("vertical_regions"), F.lit("preserve_all").alias("vertical_overflow_policy"), F.lit("balanced").alias("vertical_edge_priority"),
    )
    risks = F.array_sort(F.array_distinct(F.concat(h["quality_risks"], v["quality_risks"], F.when(v["overflow_proposal"].isNotNull(), F.array(F.lit(CLIP_RISK))).otherwise(F.array().cast("array<string>")))))
    lists = [F.col(c) if with_candidates else F.array().cast(p.schema[c].dataType).alias(c) for c in ("horizontal_candidates", "vertical_candidates")]
    selected = F.struct(
        "evidence_status", F.concat(F.lit("16:9: "), h["observed_visual_evidence"], F.lit(" 9:16: "), v["observed_visual_evidence"]).alias("observed_visual_evidence"), F.concat(F.lit("16:9 "), h["selection_reason"], F.lit("; 9:16 "), v["selection_reason"]).alias("selection_reason"),
        risks.alias("quality_risks"), *_heads(), *lists,
    )
    audit = F.struct(
        "evidence_status", *[x[f].alias(f"{a}_{f}") for a, x in (("horizontal", h), ("vertical", v)) for f in ("asset_id", "event_id", "frame_id")],
        F.lit("preserve_all").alias("execution_vertical_overflow_policy"), v["overflow_proposal"].alias("model_vertical_overflow_proposal"),
    )
    return p.select("chapter", brief.alias("brief"), selected.alias("selected"), audit.alias("audit")), violations


def _if(when: Column, rule: str) -> Column:
    return F.when(when, F.lit(rule))


def _held(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def region_rules(r: Column) -> Column:
    """What is wrong with a region (REGION): required and atomic ones are whole, keepouts have no visible share, and relations are said once each."""
    whole = F.coalesce(r["minimum_visible_fraction"], F.lit(1.0)) == 1.0
    said = r["observable_relations"]
    return _held(
        _if((r["role"] == "required") & ~whole, "required_not_whole"), _if(r["atomic"] & ~whole, "atomic_not_whole"), _if((r["role"] == "avoid_overlay") & r["minimum_visible_fraction"].isNotNull(), "keepout_with_share"),
        _if(F.exists(said, lambda x: F.trim(x) == ""), "empty_relation"), _if(~_unique(said), "repeated_relation"),
    )


def hard_core(r: Column) -> Column:
    return (r["role"] != "avoid_overlay") & ((r["role"] == "required") | r["atomic"])


def _zoom_rules(strategy: Column, zoom: Column, target: Column) -> list[Column]:
    tracked = strategy == "tracked_reframe"
    return [_if(tracked & ((zoom == "none") | _empty(target)), "reframe_needs_zoom_and_target"), _if(~tracked & (zoom != "none"), "zoom_without_reframe")]


def _option_rules(c: Column) -> list[Column]:
    return [_if(~c["frame_id"].rlike("^RF[0-9]{6}$"), "frame_id"), _if(~c["candidate_id"].rlike("^[A-Za-z0-9_-]{1,64}$"), "candidate_id"), _if(~c["rank"].between(1, 4), "rank_range"), _if(~c["confidence"].between(0, 1), "confidence_range")]


def horizontal_rules(c: Column) -> Column:
    return _held(*_option_rules(c), *_zoom_rules(c["strategy"], c["zoom_intent"], c["target_description"]))


def vertical_rules(c: Column) -> Column:
    """What is wrong with a vertical candidate: a tracked crop has a target or a hard core, regions need a tracked crop, and each region and entity is there once."""
    regions, tracked = c["regions"], c["strategy"] == "tracked_crop"
    entities = F.filter(F.transform(regions, lambda r: r["entity_id"]), lambda e: ~_empty(e))
    own = _held(
        *_option_rules(c), _if(tracked & _empty(c["target_description"]) & ~F.exists(regions, hard_core), "crop_needs_target"), _if(~tracked & (F.size(regions) > 0), "regions_without_crop"), _if(~_unique(F.transform(regions, lambda r: r["region_id"])), "repeated_region"),
        _if(~_unique(entities), "repeated_entity"), _if(F.size(regions) > MOST_REGIONS, "too_many_regions"),
    )
    return F.concat(own, F.flatten(F.transform(regions, region_rules)))


def chapter_rules() -> Column:
    """What is wrong with a chapter for the renderer as a whole."""
    lost = F.col("evidence_status") == "not_found"
    frames = [F.col(f"{a}_frame_id") for a in ("horizontal", "vertical")]
    first = F.get(F.filter("vertical_candidates", lambda c: c["rank"] == 1), F.lit(0))
    pointless = (F.col("vertical_strategy") == "tracked_crop") & _empty(F.col("vertical_target_description")) & (F.coalesce(F.size(first["regions"]), F.lit(0)) <= 0)
    heads = {"horizontal": {"frame_id": "horizontal_frame_id", "strategy": "horizontal_strategy", "zoom_intent": "horizontal_zoom_intent", "target_description": "horizontal_target_description"}, "vertical": {"frame_id": "vertical_frame_id", "strategy": "vertical_strategy", "target_description": "vertical_target_description"}}
    lists = []
    for a, fields in heads.items():
        c = F.col(f"{a}_candidates")
        ranks, n = F.transform(c, lambda x: x["rank"]), F.size(c)
        best = F.get(F.array_sort(c, lambda x, y: x["rank"] - y["rank"]), F.lit(0))
        differs = F.lit(False)
        for own, head in fields.items():
            differs = differs | ~best[own].eqNullSafe(F.col(head))
        lists += [
            _if((n == 1) | (n > 4), f"{a}_two_to_four_options"), _if(~_unique(F.transform(c, lambda x: x["candidate_id"])), f"{a}_repeated_candidate"), _if((n > 0) & (F.array_sort(ranks) != F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), f"{a}_ranks"),
            _if(~_unique(F.transform(c, lambda x: F.struct(x["asset_id"], x["event_id"], x["frame_id"]))), f"{a}_same_evidence"), _if((n > 0) & differs, f"{a}_head_differs"), _if(lost & (n > 0), f"{a}_options_without_evidence"),
        ]
    zoom = _zoom_rules(F.col("horizontal_strategy"), F.col("horizontal_zoom_intent"), F.col("horizontal_target_description"))
    return _held(_if(lost & (frames[0].isNotNull() | frames[1].isNotNull()), "frames_without_evidence"), _if(~lost & (frames[0].isNull() | frames[1].isNull()), "frames_missing"), *zoom, _if(pointless, "crop_needs_target"), *lists)


def _of_aspect(aspect: str, rules) -> Column:
    return F.flatten(F.transform(f"{aspect}_candidates", lambda c: F.transform(rules(c), lambda r: F.struct(F.lit(aspect).alias("aspect"), c["candidate_id"].alias("candidate_id"), r.alias("rule")))))


def plan_violations(chapters: DataFrame) -> DataFrame:
    """(chapter, aspect, candidate_id, rule) of chapters for the renderer (as project_choices() gives them); aspect is null for a chapter's own rules."""
    none = F.lit(None).cast("string")
    own = F.transform(chapter_rules(), lambda r: F.struct(none.alias("aspect"), none.alias("candidate_id"), r.alias("rule")))
    every = F.concat(own, _of_aspect("horizontal", horizontal_rules), _of_aspect("vertical", vertical_rules))
    return chapters.select("chapter", F.explode(every).alias("x")).select("chapter", "x.*")


def brief_violations(briefs: DataFrame, least_seconds: float = 60.0, most_seconds: float = 90.0, most_chapters: int = 16) -> DataFrame:
    """(project_id, rule) of briefs (project_id, target_duration_seconds, chapters as an array of feature_id, vertical_regions, vertical_edge_priority, vertical_overflow_policy)."""
    chapters = F.col("chapters")
    ids = lambda c: F.transform(c["vertical_regions"], lambda r: r["region_id"])
    rules = _held(
        _if(~F.col("target_duration_seconds").between(least_seconds, most_seconds), "duration"), _if(~F.size(chapters).between(1, most_chapters), "chapters"), _if(~_unique(F.transform(chapters, lambda c: c["feature_id"])), "repeated_chapter"),
        _if(F.exists(chapters, lambda c: ~_unique(ids(c))), "repeated_region"), _if(F.exists(chapters, lambda c: (F.size(c["vertical_regions"]) > 0) & ~F.exists(c["vertical_regions"], lambda r: r["role"] == "required")), "no_required_region"),
        _if(F.exists(chapters, lambda c: (F.coalesce(c["vertical_edge_priority"], F.lit("balanced")) != "balanced") & (F.coalesce(c["vertical_overflow_policy"], F.lit("")) != "controlled_clip")), "edge_needs_clip"),
    )
    return briefs.select("project_id", F.explode(rules).alias("rule"))
