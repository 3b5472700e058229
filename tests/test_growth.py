"""Steps whose memory, shuffles and files must not grow faster than the tables."""

from pathlib import Path

import pytest

from reelwork.operators import candidates, segments
from reelwork.operators.rounds import drop_folder
from reelwork.plans import files
from reelwork.plans.registry import QUERIES
from reelwork.sources.views import view

TABLES = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_same_ids_counts_once(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "i long") for ids in ([1, 1, 2, None], [2, 3, 3]))
    got = segments.same_ids(a, b, ["i"])
    assert {tuple(r) for r in got.collect()} == {(1, "left"), (None, "left"), (3, "right")} and got.count() == 3
    assert plan_of(got).count("Aggregate") == 1


def test_replan_counts_once(spark):
    a, b = (spark.createDataFrame(rows, "chapter long, candidate_id string") for rows in ([(1, "a"), (1, "a"), (1, "a"), (2, None)], [(1, "a"), (2, None), (3, "c"), (3, "c")]))
    got = candidates.replan_differences(a, b)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "stored")] * 2 + [(3, "c", "computed")] * 2
    assert plan_of(got).count("Aggregate") == 1


def test_plan_contract_gathers_narrow_rows(spark):
    gathered = [line for line in plan_of(QUERIES["v16_plan_contract"](spark, TABLES)).split("\n") if "collect_list(" in line]
    assert gathered and not any("observable_relations" in line for line in gathered)


def test_plan_evidence_settles_the_refs_before_the_frames_join(spark):
    lines = plan_of(QUERIES["v13_plan_evidence"](spark, TABLES)).split("\n")
    before = lines[next(i for i, line in enumerate(lines) if "Join LeftOuter" in line) + 1]
    assert "AS _last" in before or "_last#" in before


def test_topk_contract_copies_no_rows(spark):
    assert "Expand" not in plan_of(QUERIES["t7_topk_contract"](spark, TABLES))
    rows = [(1, "a", 7, 1), (1, "a", 7, 2), (1, "b", None, 4), (2, "a", 1, 1), (2, "b", 2, 2)]
    got = candidates.topk_violations(spark.createDataFrame(rows, "chapter long, candidate_id string, frame_id long, rank int"), spark.createDataFrame([(1, "z"), (2, "b")], "chapter long, selected string"))
    assert {tuple(r) for r in got.collect()} == {(1, "duplicate_id"), (1, "same_evidence"), (1, "ranks"), (1, "selected_missing"), (1, "selected_not_first"), (2, "selected_not_first")}


def test_artifacts_are_files_of_one_folder(spark):
    events = view(spark, TABLES, "l_json")
    folder = files._written(events)
    there = list(Path(folder.removeprefix("file:")).iterdir())
    assert not any(x.is_dir() for x in there)
    assert sum(x.name.startswith("part-") and x.stat().st_size > 0 for x in there) == events.selectExpr("event_id div 100 AS run").distinct().count()
    drop_folder(spark, folder)


def test_projected_plan_reads_entities_once_an_event(spark):
    plan = plan_of(QUERIES["c8_project_plan"](spark, TABLES))
    joins = [line for line in plan.split("\n") if "Join LeftOuter" in line and "event_id" in line]
    assert joins and len(joins) <= 2
    assert "_facts" in plan


def test_projected_plan_moves_only_what_is_asked_and_answered(spark):
    plan = plan_of(QUERIES["c8_project_plan"](spark, TABLES))
    assert plan.count("Window [row_number") == 1  # no candidate is described again to find out what is wrong
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line and "event_id" in line)
    assert "why " in plan and not any("why " in line or "selection_reason" in line for line in lines[at:])  # not among the rows that go to the events
    assert "RepartitionByExpression [chapter" in lines[at - 3] + lines[at - 2] and "StructsToJson" in lines[at - 2] + lines[at - 1]  # nor among those that come back, as one text


def test_usage_duplicates_needs_no_window(spark):
    from reelwork.operators.usage import usage_dedup, usage_duplicates

    rows = [("b.json", "p"), ("a.json", "p"), ("attempts/c.json", "q"), ("d.json", "q"), ("e.json", "r"), ("f.json", None)]
    log = spark.createDataFrame(rows, "path string, payload string")
    assert "Window" not in plan_of(usage_duplicates(log))
    assert {r["path"] for r in usage_duplicates(log).collect()} == {"b.json", "d.json"}
    assert {r["path"] for r in usage_dedup(log).collect()} == {"a.json", "attempts/c.json", "e.json", "f.json"}


@pytest.mark.parametrize("name", ["t2_greedy_match_groundings", "c1_compare_runs"])
def test_labels_are_scored_after_distinct(spark, name):
    plan = plan_of(QUERIES[name](spark, TABLES))
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate [left_label")


def test_policy_bindings_are_made_once_a_chapter(spark):
    plan = plan_of(QUERIES["v20_policy_lineage"](spark, TABLES))
    assert "l_orderkey" not in plan.split("LogicalRDD")[0] and "Aggregate" not in plan and plan.count("Generate explode") == 3


def test_failure_codes_are_no_functions_of_arrays(spark):
    plan = plan_of(QUERIES["f34_audit_bounded_clip"](spark, TABLES))
    assert "concat_ws(,, CASE WHEN NOT lineage_ok" in plan and "isnotnull(lambda arg" not in plan
    assert plan.index("Contains(lambda x") < plan.index("RLIKE(lambda x")  # JSON without a point or an escape doesn't meet the pattern


def test_proposals_make_a_region_once(spark):
    plan = plan_of(QUERIES["c13_candidate_proposals"](spark, TABLES))
    assert plan.count("avoid_overlay") <= 2 and "(?U)" not in plan  # once in the table's view, once in the pass over the regions


def test_stripped_takes_all_white_space(spark):
    from pyspark.sql import functions as F

    from reelwork.functions.text import stripped

    c = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    rows = spark.range(1, 0xD800).unionByName(spark.range(0xE000, 0xFFFE)).select(F.concat(c, F.lit("a"), c, F.lit("b"), c, F.lit("\n")).alias("t"))
    assert rows.where(stripped(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert rows.where(stripped(F.col("t")) == F.concat(F.lit("a"), F.substring("t", 1, 1), F.lit("b"))).count() == 25


def test_dense_fingerprints_sort_by_event_first(spark):
    plan = plan_of(QUERIES["f35_dense_fingerprint"](spark, TABLES))
    assert "sort_array(collect_list(" in plan and "lambda left" not in plan
    assert "Aggregate [event_id#" in plan


def test_wrong_segments_need_no_geometry(spark):
    plan = plan_of(QUERIES["c12_crop_audit"](spark, TABLES))
    assert plan.count("Window [sum(") == 1, plan.count("Window [sum(")


def test_spaced_json_of_a_long_text(spark):
    from pyspark.sql import functions as F

    from reelwork.operators.audits import spaced_json

    text = '{"a":"' + "x,:" * 20000 + '\\\\","b":["c:d",1,2],"e":"f, g:"}'
    said = spark.createDataFrame([(text,)], "t string").select(spaced_json(F.col("t"))).first()[0]
    assert said == '{"a": "' + "x,:" * 20000 + '\\\\", "b": ["c:d", 1, 2], "e": "f, g:"}'


def test_vertical_routing_reads_its_view_once(spark):
    assert "user_id" not in plan_of(QUERIES["f28_vertical_routing"](spark, TABLES))


def test_stream_takes_files_of_one_folder(spark, tmp_path, monkeypatch):
    from hashlib import sha256

    ids = [*range(50, 100), 120, 7003, *range(9050, 9150)]  # none of the first run, gaps, buckets of one document, two of equal texts
    rows = [(i, f"text {i % 50}", "s", 1) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    take, folders = files.take_new_artifacts, []

    def seen(session, root, *rest):
        folders.extend(x for x in Path(root.removeprefix("file:")).iterdir() if x.is_dir())
        return take(session, root, *rest)

    monkeypatch.setattr(files, "take_new_artifacts", seen)
    got = sorted(tuple(r) for r in QUERIES["s7_artifact_stream"](spark, str(tmp_path)).select("bucket", "sha256", "run").collect())
    lines = {b: [sha256(t.encode()).hexdigest() for i, t, *_ in rows if i // 50 == b] for b in {i // 50 for i in ids}}
    assert got == sorted((b, sha256(("\n".join(x) + "\n").encode()).hexdigest(), b % 3) for b, x in lines.items())
    assert folders == []


def test_preflight_regions_need_no_lambda(spark):
    plan = plan_of(QUERIES["f33_preflight_from_geometry"](spark, TABLES))
    assert "lambda" not in plan


def test_preflight_regions_of_any_number(spark):
    roles, softs = ["hard_core", "soft_extent", "overlay_keepout", "soft_extent", "soft_extent"], [None, [], [("r1", None)], [("r3", 0.5), ("r1", 0.25), ("r3", 0.9)], [(None, 0.1), ("r3", 0.75)]]
    rows = []
    for n in [None, *range(11)]:
        for k, soft in enumerate(softs):
            intents = None if n is None else [(f"r{i}" if i != 4 else None, roles[i % 5], i % 2 == 0, i / 16) for i in range(n)]
            geometry = ("blur", None, True, None, None, None, 1.0, None if k == 0 else k / 8, soft)
            rows.append((n, f"c{k}", 1, 0.5, "s", "crop", None, k % 2 == 0, intents, geometry))
    g = "struct<applied_strategy: string, confidence_passed: boolean, coverage_passed: boolean, lineage_passed: boolean, max_acceleration: double, max_jerk: double, max_speed: double, min_required_area: double, soft_extents: array<struct<region_id: string, min_area: double>>>"
    intent = "struct<region_id: string, execution_role: string, atomic: boolean, floor: double>"
    df = spark.createDataFrame(rows, f"chapter long, candidate_id string, rank int, confidence double, source_fingerprint string, filter_graph string, track_fingerprint string, titles_rendered boolean, intents array<{intent}>, geometry {g}")

    def region(name, role, atomic, floor, least, soft, titles):
        known = [a for i, a in soft or [] if i is not None and i == name]
        if role == "hard_core":
            return (name, role, atomic, True, 1.0 if least is None else least, 1.0, 0.0)
        if role == "soft_extent":
            return (name, role, False, bool(known), (known[0] or 0.0) if known else 0.0, floor, 0.0)
        return (name, role, atomic, not titles, 1.0, 0.0, 1.0 if titles else 0.0)

    got = {(r.chapter, r.candidate_id): r.regions for r in candidates.preflight_rows(df).select("chapter", "candidate_id", "regions").collect()}
    assert len(got) == len(rows)
    for chapter, name, *_, titles, intents, geometry in rows:
        want = None if intents is None else [region(*i, geometry[7], geometry[8], titles) for i in intents]
        have = got[chapter, name]
        assert (have if have is None else [tuple(r) for r in have]) == want, (chapter, name)
