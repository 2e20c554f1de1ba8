from pyspark.sql import functions as F

from txnwatch.operators.lookup import fetch_by_key


def test_fetch_by_key_equals_left_join(spark):
    source = spark.range(0, 5000).select(F.col("id").alias("txn_id"), (F.col("id") % 2).cast("int").alias("flag"),
                                          F.lit("x").alias("other"))
    target = spark.createDataFrame([(1, 0.9), (4, 0.2), (4, 0.2), (4999, 0.5), (7777, 0.1), (None, 0.3)],
                                   "txn_id long, prob double")
    got = fetch_by_key(target, source, "txn_id", ["flag"])
    want = target.join(source.select("txn_id", "flag"), "txn_id", "left")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.columns == ["txn_id", "prob", "flag"]


def test_repeated_source_keys_multiply_no_row(spark):
    source = spark.createDataFrame([(1, 5), (1, 3), (2, None), (None, 9)], "txn_id long, flag int")
    target = spark.createDataFrame([(1,), (1,), (2,), (None,)], "txn_id long")
    got = fetch_by_key(target, source, "txn_id", ["flag"]).collect()
    assert sorted(got, key=str) == sorted([(1, 3), (1, 3), (2, None), (None, None)], key=str)
