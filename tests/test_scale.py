"""Nearest samples and smoothing on one long series, canonical JSON, and files that come and go."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwork.functions.text import canonical_json, shortest_double
from reelwork.operators import crops, tracks
from reelwork.plans.registry import QUERIES
from reelwork.sources import registry
from reelwork.streaming import artifacts

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 7, 40, 10_000])
def test_nearest_at_the_borders_of_blocks(spark, block):
    r = random.Random(block)
    samples = [(k, i, r.randint(-60, 200)) for k in range(3) for i in range(60)] + [(9, 0, 5)]
    references = [(k, r.randint(-80, 260), i) for k in range(3) for i in range(6 * k + 1)] + [(0, 50, 70), (0, 50, 60)]
    s, ref = spark.createDataFrame(samples, "k int, i int, t_ms long"), spark.createDataFrame(references, "k int, reference_ms long, reference_id long")
    got = {(x.k, x.i): (x.reference_ms, x.reference_id, x.gap_ms) for x in tracks.nearest(s, ref, "k", block).collect()}
    assert len(got) == len(samples) and got[9, 0] == (None, None, None)
    for k, i, t in samples[:-1]:
        gap, at, name = min((abs(t - at), at, name) for key, at, name in references if key == k)
        assert got[k, i] == (at, name, gap)


def test_nearest_of_one_long_series(spark):
    n = 400_000
    s = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 40).alias("t_ms"))
    ref = spark.range(n // 10).select(F.lit(1).alias("k"), (F.col("id") * 400 + F.col("id") % 7 * 3).alias("reference_ms"), F.col("id").alias("reference_id"))
    got = tracks.nearest(s, ref, "k").select("id", "reference_ms").toPandas().sort_values("id")["reference_ms"].to_numpy()
    at, t = np.arange(n // 10) * 400 + np.arange(n // 10) % 7 * 3, np.arange(n) * 40
    i = np.searchsorted(at, t, "right")
    before, after = at[np.maximum(i - 1, 0)], at[np.minimum(i, len(at) - 1)]
    assert (got == np.where((i == len(at)) | (t - before <= after - t), before, after)).all()


def smoothed(values, alpha=0.34):
    out, y = [], None
    for x in values:
        y = y if x is None else x if y is None else alpha * x + (1 - alpha) * y
        out.append(y)
    return out


def test_smoothing_of_series_with_gaps(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice([None, r.uniform(0, 1000)]) if k % 2 else r.uniform(0, 1000)) for k in range(6) for i in range(0, 40 * k * k + 1) if k != 3 or i % 50 == 0]
    rows += [(7, i, None) for i in range(70)] + [(8, i, None if i < 100 else 3.0) for i in range(130)]
    df = spark.createDataFrame(rows, "track_id int, sample_index int, x double")
    got = {(q.track_id, q.sample_index): q.y for q in crops.ema_smooth(df, {"x": "y"}).collect()}
    for k in {q[0] for q in rows}:
        mine = sorted(q[1:] for q in rows if q[0] == k)
        want = smoothed(smoothed([x for _, x in mine])[::-1])[::-1]
        for (i, _), w in zip(mine, want, strict=True):
            assert got[k, i] == (None if w is None else pytest.approx(w, rel=1e-12)), (k, i)


def test_smoothing_of_one_long_track(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("track_id"), F.col("id").alias("sample_index"), (F.col("id") * 7919 % 1009).cast("double").alias("x"))
    got = crops.ema_smooth(df, {"x": "y"}).orderBy("sample_index").select("y").toPandas()["y"].to_numpy()
    want = smoothed(smoothed((np.arange(n) * 7919 % 1009).astype(float).tolist())[::-1])[::-1]
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_doubles_as_python_writes_them(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1e7, 12345678.0, 1e-3, 1e-4, 9.999e-5, 1e15, 1e16, 5e-324, 1.7976931348623157e308, 2 / 3, 1e22, 1e23, 2.0**-44, -1.5e-7, 2e-3, 4.35, float("inf"), float("-inf"), float("nan")]
    while len(values) < 10_000:
        x = r.choice([lambda: struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0], lambda: r.uniform(-1e9, 1e9), lambda: round(r.uniform(-1000, 1000), r.randint(0, 8))])()
        values += [x] if x == x else []
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", shortest_double(F.col("x"))).collect()
    assert [g for x, g in got if g != json.dumps(x)] == []
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(shortest_double(F.col("x"))).first()[0] is None


def test_json_as_python_writes_it(spark):
    rows = [(1.0, 'a"b\\u001A \x1f\x01\x7f\n é ', [1e7, 2.5e-9, None], 10**12, None, True), (12345678.9, "\\", [], -1, "E7 1.5E7 -2.0", False), (None, "", None, 0, "", None)]
    df = spark.createDataFrame(rows, "b double, a string, c array<double>, i long, n string, t boolean")
    want = [json.dumps({k: v for k, v in zip("bacint", q, strict=True) if v is not None}, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for q in rows]
    assert [q[0] for q in df.select(canonical_json("b", "a", "c", "i", "n", "t")).collect()] == want


def test_json_of_long_texts_needs_no_deep_stack(spark):
    rows = [('long "text" \\ ' * 20_000, 0.5), ("x" * 300_000 + "\x1f", 1e-9), (",1.25e3" * 1000, None)]
    want = [json.dumps({"a": a} if b is None else {"a": a, "b": b}, ensure_ascii=False, separators=(",", ":")) for a, b in rows]
    assert [q[0] for q in spark.createDataFrame(rows, "a string, b double").select(canonical_json("a", "b")).collect()] == want


def test_doubles_in_json_as_python_writes_them(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 1.0, -2.5, 100.0, 0.0001, 0.00012, 1e-5, 0.000099, 123456789012345.0, 1234567.25, 1e7, 0.1 + 0.2, -1 / 3]
    values += [round(r.uniform(-10, 10) * 10 ** r.randint(-8, 9), r.randint(0, 12)) for _ in range(3000)]
    rows = [(x, [x, -x]) for x in values]
    want = [json.dumps({"a": a, "b": b}, separators=(",", ":")) for a, b in rows]
    assert [q[0] for q in spark.createDataFrame(rows, "a double, b array<double>").select(canonical_json("a", "b")).collect()] == want


@pytest.mark.parametrize("name", ["c15_temporal_fingerprint", "c15_temporal_reuse"])
def test_temporal_requests_hash_only_the_catalogs_they_name(spark, name):
    assert "Join LeftSemi" in QUERIES[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()


def test_broken_documents_are_set_aside(spark, tmp_path):
    texts = {"a/good.json": '{\n "run": 1,\n "extra": {},\n "events": [{"id": 2}]\n}', "a/b/missing.json": "{}", "cut.json": '{"run": 1, "ev', "kind.json": '{"run": "one"}', "empty.json": "", "list.json": "[1]", "other.txt": "{"}
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    schema = "run long, events array<struct<id: long>>"
    read, broken = registry.check_artifacts(spark, str(tmp_path), "*.json", schema)
    assert sorted((q.path.rsplit("/", 1)[1], q.run, q.events and [e.id for e in q.events]) for q in read.collect()) == [("good.json", 1, [2]), ("missing.json", None, None)]
    assert sorted((q.path.rsplit("/", 1)[1], q.rule) for q in broken.collect()) == [("cut.json", "no_json"), ("kind.json", "schema"), ("list.json", "schema")]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        registry.read_artifacts(spark, str(tmp_path), "*.json", schema).collect()


def test_each_run_takes_the_new_files(spark, tmp_path):
    root, state = tmp_path / "files", str(tmp_path / "state")
    take = lambda: sorted(q.path.rsplit("/", 1)[1] for q in artifacts.take_new_artifacts(spark, str(root), "*.json", state, 2).collect())
    (root / "deep").mkdir(parents=True)
    for k in range(5):
        (root / f"{k}.json").write_text(str(k))
    (root / "note.txt").write_text("no")
    assert take() == [f"{k}.json" for k in range(5)]
    assert take() == []
    (root / "deep" / "5.json").write_text("5")
    assert take() == ["5.json"]
    (root / "0.json").write_text("changed")
    assert take() == []  # a stream knows files by name
    now = registry.content_identity(registry.read_files(spark, str(root), "*.json")).select("path", F.substring("asset_id", 8, 64).alias("sha256"))
    known = artifacts.taken_artifacts(spark, state)
    assert known.count() == 6 and known.select("batch").distinct().count() > 3
    same = now.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    logged = known.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    assert [q.path.rsplit("/", 1)[1] for q in artifacts.changed_artifacts(same, logged.select("path", "sha256")).collect()] == ["0.json"]


def test_a_batch_that_was_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    root, state = tmp_path / "files", str(tmp_path / "state")
    root.mkdir()
    for k in range(4):
        (root / f"{k}.json").write_text(str(k))
    kept = type(spark.range(1).write).parquet
    calls = []

    def fails(self, path, *a, **b):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")
        return kept(self, path, *a, **b)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", fails)
    with pytest.raises(Exception, match="lost"):
        artifacts.take_new_artifacts(spark, str(root), "*.json", state, 2)
    monkeypatch.undo()
    again = artifacts.take_new_artifacts(spark, str(root), "*.json", state, 2)
    assert again.count() == 2
    assert sorted(q.path.rsplit("/", 1)[1] for q in artifacts.taken_artifacts(spark, state).collect()) == [f"{k}.json" for k in range(4)]


@pytest.mark.parametrize("text, cut", [('{"a":"x 1.25E7","b":0.5}', False), ('{"a":[1,2.25],"b":-0.0001}', False), ('{"a":1.0E7}', True), ('{"a":0.00001}', True), ('{"a":"\\\\u001A"}', True), ('{"a":0.30000000000000004}', True)])
def test_only_json_that_python_writes_otherwise_is_cut(text, cut):
    import re

    from reelwork.functions.text import _DIFFERS

    assert bool(re.search(_DIFFERS, text)) == cut
