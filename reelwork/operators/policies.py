"""Human policies on plans: what they may change, and whether all that they rest on is still what it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: they stand in stored bindings
PLAN_BINDING_VERSION = "feature-plan-binding-v1"
POLICY_ORIGIN = "human_reframe_policy"
PROJECTED = "external_projection"
#: What a plan's binding must say, beside its files.
MODEL_FIELDS = ("plan_prompt_sha256", "system_instruction_sha256", "model_id", "model_id_sha256", "response_schema_sha256", "request_sha256")


def _file(kind: str, path: Column, saved: Column, root: Column | None = None, when: Column | None = None) -> Column:
    row = F.struct(F.lit(kind).alias("kind"), path.alias("path"), saved.alias("saved"), (F.lit(None).cast("string") if root is None else root).alias("root"))
    return row if when is None else F.when(when, row)


def _value(kind: str, saved: Column, current: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), saved.cast("string").alias("saved"), current.cast("string").alias("current"))


def file_bindings() -> Column:
    """The bindings (kind, path, saved, root; null: does not apply) of a bundle's row to files: the hash that each file must have, and the folder that it must lie in, if any."""
    saved, source, side, policy = F.col("saved"), F.col("source"), F.col("sidecar"), F.col("policy")
    projected = source["origin"] == PROJECTED
    return F.array(
        _file("saved_catalog", F.col("catalog_path"), saved["catalog_sha256"]), _file("saved_brief", F.col("brief_path"), saved["brief_sha256"]), _file("saved_plan", F.col("plan_path"), saved["plan_sha256"]),
        _file("policy_sidecar", policy["sidecar_path"], policy["sidecar_sha256"], policy["sidecar_root"]),
        _file("sidecar_catalog", side["catalog_path"], side["catalog_sha256"]), _file("sidecar_source_brief", side["source_brief_path"], side["source_brief_sha256"]), _file("sidecar_source_plan", side["source_plan_path"], side["source_plan_sha256"]), _file("sidecar_source_binding", side["source_binding_path"], side["source_binding_sha256"]),
        _file("source_catalog", source["catalog_path"], source["catalog_sha256"]), _file("source_brief", source["brief_path"], source["brief_sha256"]), _file("source_plan", source["plan_path"], source["plan_sha256"]), _file("source_request", source["request_path"], source["request_sha256"]),
        _file("projection_pointer", source["pointer_path"], source["projection_pointer_sha256"], when=projected), _file("projection_record", source["record_path"], source["projection_record_sha256"], source["record_root"], projected), _file("projection_pointer_record", source["record_path"], source["pointer_record_sha256"], source["record_root"], projected),
    )


def value_bindings() -> list[Column]:
    """The bindings (kind, saved, current) of a bundle's row between what was saved and what holds now."""
    saved, source, side, policy = F.col("saved"), F.col("source"), F.col("sidecar"), F.col("policy")
    record = source["record"]
    own = lambda c: F.when(source["origin"] == PROJECTED, c).otherwise(F.lit(None))
    return [
        _value("saved_version", saved["binding_version"], F.lit(PLAN_BINDING_VERSION)), _value("saved_origin", saved["origin"], F.lit(POLICY_ORIGIN)), _value("source_version", source["binding_version"], F.lit(PLAN_BINDING_VERSION)),
        _value("project", side["project_id"], F.col("project_id")), _value("catalog", side["catalog_id"], F.col("catalog_id")), _value("sidecar_catalog_path", side["catalog_path"], F.col("catalog_path")),
        _value("source_catalog_path", source["catalog_path"], F.col("catalog_path")), _value("source_brief_path", source["brief_path"], side["source_brief_path"]), _value("source_plan_path", source["plan_path"], side["source_plan_path"]),
        _value("selection", side["selection_fingerprint"], F.col("selection_fingerprint")), _value("saved_selection", saved["selection_fingerprint"], F.col("selection_fingerprint")), _value("saved_sidecar", saved["reframe_policy_sidecar_sha256"], policy["sidecar_sha256"]), _value("saved_source_binding", saved["source_plan_binding_sha256"], side["source_binding_sha256"]),
        *[_value(f"saved_{c}", saved[c], source[c]) for c in MODEL_FIELDS],
        *[_value(f"record_{c}", own(record[c]), own(source[s])) for c, s in (("catalog_sha256", "catalog_sha256"), ("brief_sha256", "brief_sha256"), ("feature_plan_sha256", "plan_sha256"))],
    ]


def binding_mismatches(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle_id, kind, saved, current, rule) for each binding of a policy's bundle that no longer holds.

    bundles: bundle_id, project_id, catalog_id, catalog_path, brief_path, plan_path, selection_fingerprint and the structs saved (the
    plan binding), source (the binding of the plan below the policy), sidecar and policy (the brief's binding), null where there is
    none. files: path, sha256 as they are. A binding without a saved value is missing, one to no file is without a file, and one to
    a file outside its folder escapes it; a source without a model's field is not complete.
    """
    f = bundles.select("bundle_id", F.explode(file_bindings()).alias("x")).where("x IS NOT NULL").select("bundle_id", "x.*").join(files.select("path", F.col("sha256").alias("current")), "path", "left")
    outside = F.col("root").isNotNull() & (~F.startswith("path", F.concat("root", F.lit("/"))) | F.contains("path", F.lit("/../")))
    f = f.withColumn("rule", F.when(F.col("saved").isNull(), "not_saved").when(outside, "escapes_folder").when(F.col("current").isNull(), "no_file").when(F.col("current") != F.col("saved"), "differs"))
    none = F.lit(None).cast("string")
    row = lambda kind, saved, current, rule: F.struct(kind.alias("kind"), saved.alias("saved"), current.alias("current"), rule.alias("rule"))

    def differing(x: Column) -> Column:
        rule = F.when(x["saved"].isNull() & x["current"].isNotNull(), "not_saved").when(~x["saved"].eqNullSafe(x["current"]), "differs")
        return F.when(rule.isNotNull(), row(x["kind"], x["saved"], x["current"], rule))

    # what a bundle's row settles alone is told in one pass, and only what no longer holds is made into rows
    gone = [F.when(F.coalesce(F.col("source")[c], F.lit("")) == "", row(F.lit(f"source_{c}"), none, none, F.lit("not_complete"))) for c in (*MODEL_FIELDS, "request_path")]
    absent = [F.when(F.col(c).isNull(), row(F.lit(k), none, none, F.lit("absent"))) for c, k in (("policy", "policy_binding"), ("sidecar", "policy_record"), ("source", "source_binding"))]
    told = [*map(differing, value_bindings()), *gone, *absent]
    own = bundles.select("bundle_id", F.explode(F.array(*told)).alias("x")).where("x IS NOT NULL")
    return f.where("rule IS NOT NULL").select("bundle_id", "kind", "saved", "current", "rule").unionByName(own.select("bundle_id", "x.*"))


OVERRIDES = ("vertical_overflow_policy", "vertical_edge_priority", "vertical_crop_mode", "vertical_regions")


def apply_policy(chapters: DataFrame, overrides: DataFrame) -> DataFrame:
    """chapters (project_id, feature_id, OVERRIDES) with what a policy's overrides (the same columns, null: as it was) say, and overridden."""
    o = overrides.select("project_id", "feature_id", *[F.col(c).alias(f"_{c}") for c in OVERRIDES], F.lit(True).alias("overridden"))
    return chapters.join(o, ["project_id", "feature_id"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in OVERRIDES}).withColumn("overridden", F.coalesce("overridden", F.lit(False))).drop(*[f"_{c}" for c in OVERRIDES])


def revised_brief_violations(chapters: DataFrame, overrides: DataFrame, bindings: DataFrame) -> DataFrame:
    """(project_id, feature_id, rule) of a brief once a policy is applied.

    overrides name known chapters, each once; the regions of a chapter have unique ids and one that is required; an edge priority
    other than balanced needs a controlled clip, and a controlled clip needs the project's binding (project_id) to a human policy.
    """
    key = ["project_id", "feature_id"]
    unknown = overrides.join(chapters, key, "left_anti").select(*key, F.lit("unknown_chapter").alias("rule")).distinct()
    twice = overrides.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate_chapter").alias("rule"))
    once = overrides.dropDuplicates(key)
    r = apply_policy(chapters, once).join(bindings.select("project_id", F.lit(True).alias("_bound")).distinct(), "project_id", "left")
    ids = F.transform("vertical_regions", lambda x: x["region_id"])
    clip = F.col("vertical_overflow_policy") == "controlled_clip"
    say = lambda when, rule: F.when(when, F.lit(rule))
    rules = F.array_compact(F.array(
        say(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_region"), say((F.size(ids) > 0) & ~F.exists("vertical_regions", lambda x: x["role"] == "required"), "no_required_region"),
        say((F.coalesce("vertical_edge_priority", F.lit("balanced")) != "balanced") & ~F.coalesce(clip, F.lit(False)), "edge_needs_clip"), say(clip & F.col("_bound").isNull(), "clip_needs_binding"),
    ))
    return r.select(*key, F.explode(rules).alias("rule")).unionByName(unknown).unionByName(twice)
