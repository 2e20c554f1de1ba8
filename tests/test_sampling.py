import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from txnwatch.operators import sampling


def table(spark, n=3000, pos_rate=0.05, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"txn_id": np.arange(n), "label": (rng.random(n) < pos_rate).astype(int)})
    return spark.createDataFrame(pdf)


def test_class_capped_sample_is_exact_and_stable(spark):
    df = table(spark)
    s = sampling.class_capped_sample(df, 500, 42)
    got = s.toPandas()
    pos = df.where("label = 1").count()
    assert len(got) == pos + 500
    assert got.label.sum() == pos
    again = sampling.class_capped_sample(df.repartition(13), 500, 42).toPandas()
    assert sorted(got.txn_id) == sorted(again.txn_id)
    # the kept negatives are the 500 smallest keyed hashes
    h = df.where("label = 0").select("txn_id", sampling.keyed_hash("txn_id", 42).alias("h")).toPandas()
    want = h.sort_values(["h", "txn_id"]).txn_id[:500]
    assert sorted(got[got.label == 0].txn_id) == sorted(want)


def test_sample_larger_than_class_keeps_all(spark):
    df = table(spark, n=200)
    assert sampling.class_capped_sample(df, 10_000, 42).count() == 200


def test_stratified_split_exact(spark):
    df = table(spark, n=2000, pos_rate=0.1)
    sp = sampling.stratified_split(df, 7).toPandas()
    assert sp.txn_id.is_unique and len(sp) == 2000
    for lab, grp in sp.groupby("label"):
        n = len(grp)
        c = grp.split.value_counts()
        assert c.get("train", 0) == int(np.floor(0.6 * n))
        assert c.get("train", 0) + c.get("val", 0) == int(np.floor(0.8 * n))
    sp2 = sampling.stratified_split(df.repartition(5), 7).toPandas()
    assert sp.sort_values("txn_id").split.tolist() == sp2.sort_values("txn_id").split.tolist()


def test_uniform_sample_and_hash_split(spark):
    df = table(spark, n=1500)
    assert sampling.uniform_sample(df, 1000, 42).count() == 1000
    assert sampling.uniform_sample(df.limit(10), 1000, 42).count() == 10
    hs = sampling.hash_split(df, 42).groupBy("split").count().toPandas().set_index("split")["count"]
    assert abs(hs["train"] / 1500 - 0.6) < 0.06


def test_keyed_hash_matches_duckdb():
    import duckdb
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    got = spark.range(5).select(sampling.keyed_hash("id", 42).alias("h")).toPandas().h.tolist()
    con = duckdb.connect()
    want = [con.execute(f"select cast(('0x' || substr(md5('42:{i}'), 1, 8)) as bigint)").fetchall()[0][0]
            for i in range(5)]
    assert got == want


def test_class_capped_sample_skips_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else int(i % 7 == 0)) for i in range(400)],
                               "txn_id long, label int")
    got = sampling.class_capped_sample(df, 50, 42).toPandas()
    assert got.label.notna().all() and got.txn_id.is_unique
    assert (got.label == 1).sum() == df.where("label = 1").count() and (got.label == 0).sum() == 50


def test_smallest_by_hash_exact(spark):
    df = table(spark, n=1500)
    got = sampling.smallest_by_hash(df.repartition(7), 123, "txn_id", 5).toPandas()
    h = df.select("txn_id", sampling.keyed_hash("txn_id", 5).alias("h")).toPandas()
    assert sorted(got.txn_id) == sorted(h.sort_values(["h", "txn_id"]).txn_id[:123])
    assert list(got.columns) == df.columns
