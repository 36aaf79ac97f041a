from pyspark.sql import functions as F

from loomgraph.llm.prefilter import _marked, with_ids, without_ids


def test_joins_equal_plain_ones(spark):
    rows = spark.range(5000).selectExpr("CAST(IF(id % 50 = 0, NULL, id % 3000) AS INT) AS doc_id", "id AS bucket", "'r' AS row", "'b' AS bits")
    ids = spark.range(0, 4000, 7).selectExpr("id AS doc_id", "id + 1 AS more")
    plain = rows.join(ids, "doc_id")
    assert sorted(map(tuple, with_ids(rows, ids, "doc_id").collect())) == sorted(map(tuple, plain.collect()))
    got = without_ids(rows, ids, "doc_id")
    assert got.columns == rows.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(ids, "doc_id", "left_anti").select(*rows.columns).collect()))
    assert _marked(rows, ids, "doc_id").where("near").count() < 1.05 * plain.count()
    assert without_ids(rows, ids.limit(0), "doc_id").count() == 5000 and with_ids(rows, ids.limit(0), "doc_id").count() == 0
    assert without_ids(rows.limit(0), ids, "doc_id").count() == 0


def test_more_ids_than_bits_of_some_buckets(spark):
    rows = spark.range(300_000).select((F.col("id") * 2).alias("doc_id"))
    ids = spark.range(0, 600_000, 3).withColumnRenamed("id", "doc_id")
    assert with_ids(rows, ids, "doc_id").count() == 100_000 and without_ids(rows, ids, "doc_id").count() == 200_000
