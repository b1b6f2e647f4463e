from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from pathweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, FOLDER)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == docs.columns, name
            assert after.join(before, docs.columns, "left_anti").count() == 0  # rows as they were
        if i < 3:
            assert 0 < after.count() <= before.count()
        if i == 4:
            assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").distinct().collect()}
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
        before = after


def test_all_are_registered():
    names = queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLES) <= set(oracle_sql()) and "pipeline" not in oracle_sql()
