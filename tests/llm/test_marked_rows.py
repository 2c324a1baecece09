"""The filter by a bounded bit table keeps every asked row, and few others."""

from spindrift.llm.simhash import marked_rows


def test_asked_rows_stay_and_few_others(spark):
    docs = spark.range(-50000, 50000).selectExpr("id as doc", "'x' as text").union(spark.sql("select cast(null as bigint), 'n'"))
    docs = docs.union(docs.where("doc in (0, 7)"))
    ids = spark.range(-9000, 9000, 6).toDF("doc")
    kept = marked_rows(docs, ids)
    assert ids.join(kept, "doc", "left_anti").isEmpty()
    assert kept.where("doc is null").isEmpty()
    assert kept.where("doc = 0").count() == 2
    assert kept.count() <= 3001 + 100000 // 16


def test_no_ids_and_no_rows(spark):
    docs = spark.range(100).selectExpr("id as doc", "'x' as text")
    assert marked_rows(docs, docs.select("doc").limit(0)).isEmpty()
    assert marked_rows(docs.limit(0), docs.select("doc")).isEmpty()
