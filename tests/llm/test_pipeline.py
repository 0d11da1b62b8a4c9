"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        kept = out.count()
        assert 0 < kept <= before
        assert out.join(docs, docs.columns, "left_anti").where(F.col("lang").isNotNull() & F.col("source").isNotNull()).count() == 0
        docs, before = out, kept
        assert name
    packed = pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == before


def test_one_of_each_group_stays(spark, awkward):
    out = pipeline.copies_stage(spark, awkward, "")
    assert out.columns == awkward.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 2, 3, 4, 5, None, 7, 8, -50, 100])


def test_stages_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    """Nulls, empty, long and repeated rows, clashing names: each stage keeps columns and rows as its docstring says."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (4, 5, 6, 8, 100)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clash = awkward.selectExpr("*", "'x' as __copy", "'y' as lang_pred")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns, name
        assert out.exceptAll(clash).count() == 0, name
        assert stage(spark, clash.limit(0), str(tmp_path)).collect() == [], name
    assert pipeline.STAGES[-1][1](spark, clash.limit(0), str(tmp_path)).collect() == []
    kept = pipeline.language_stage(spark, clash, str(tmp_path))
    assert not {1, 2, 3, 7} & {r.doc_id for r in kept.collect()}


def test_run_is_the_stages_by_hand(spark, data):
    """The whole run against decisions taken from the operators' own queries and pairwise Jaccard."""
    from test_jaccard import brute

    from talus.llm import langid, quality

    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = {r.doc_id for r in quality.op6_quality(spark, data).collect() if r.score >= pipeline.MIN_QUALITY}
    first = docs.where(F.col("doc_id").isin(sorted(good)))
    seen = langid.predict(first, langid.fit(langid.training_rows(first))).collect()
    known = {r.doc_id for r in seen if r.lang_pred != "und" and r.score >= pipeline.MIN_LANGUAGE}
    groups = brute([(r.doc_id, r.text) for r in first.collect() if r.doc_id in known])
    assert {r.doc_id for r in pipeline.run(spark, data).collect()} == {i for i, (_, c) in groups.items() if i == c}
