"""The pipeline's stages on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_llm import SCHEMA, odd_rows, prose


def test_stages(spark, tmp_path):
    item = "Thonea re anly was in the old mill and there erly tionea whly when st ingly hadn then ouble re tha onst"
    rows = odd_rows() + [(100 + k, prose(100 + k, 80), "en", "s", 0) for k in range(12)] + [(200, prose(200, 60) + " " + item, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS, name
    clean = {100 + k for k in range(12)}
    assert clean | {0, 1, 2, 200} <= kept[0] and not {3, 4, 5, 6, 10} & kept[0]
    assert clean | {0, 200} <= kept[1] and not {1, 2} & kept[1]
    assert clean <= kept[2] and 200 not in kept[2]
    assert P.run(spark, str(tmp_path)).count() == docs.count() > 0


def test_rows_without_or_with_a_shared_id(spark, tmp_path):
    item = "Thonea re anly was in the old mill and there erly tionea whly when st ingly hadn then ouble re tha onst"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = {k: prose(300 + k, 80) for k in range(6)}
    rows = [(None, own[0], "en", "s", 0), (None, own[1], "en", "s", 0), (None, own[0] + " more", "en", "s", 0), (7, own[2], "en", "s", 0), (7, own[3], "en", "s", 0), (8, own[2], "en", "t", 0), (None, own[4] + " " + item, "en", "s", 0), (None, own[5], "en", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = lambda df: {r.text for r in df.collect()}
    near = P.near_dedup(spark, docs, str(tmp_path))
    got = texts(near)
    assert {own[1], own[2], own[3], own[5], rows[6][1]} <= got and len({own[0], rows[2][1]} & got) == 1 and near.count() == 6
    assert {r.doc_id for r in near.where(F.col("text") == own[2]).collect()} == {7}
    assert texts(P.decontaminate(spark, docs, str(tmp_path))) == {r[1] for r in rows} - {rows[6][1]}
    # of one source each document is taken once
    mixed = P.mix(spark, docs.withColumn("source", F.lit("s")), str(tmp_path))
    assert texts(mixed) == {r[1] for r in rows} and mixed.count() == len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
