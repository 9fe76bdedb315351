"""The pipeline's stages on their own inputs."""

from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    from cohortry.llm.scratch import Scratch

    scratch = Scratch(spark, "test-pipeline")
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf), f"s{k}")
        assert docs.columns == before.columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("item"))
    assert docs.join(bench, F.contains("text", "item")).count() == 0
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_null_rows_pass_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0)], docs.schema)
    for _, stage in P.STAGES:
        stage(spark, docs.union(odd), sf).write.format("noop").mode("overwrite").save()
        stage(spark, docs.limit(0), sf).write.format("noop").mode("overwrite").save()
