import os

import pytest
from pyspark.sql import functions as F

from txnwatch.sources import tables


def test_replacement_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    first = spark.range(3).withColumn("a", F.lit("x"))
    assert tables.replace(first, path).count() == 3
    old = tables.read(spark, path)                             # planned before the next write
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception):
        tables.replace(broken, path)
    assert sorted(r.id for r in tables.read(spark, path).collect()) == [0, 1, 2]
    # another schema, and from its own content
    assert tables.replace(tables.read(spark, path).select((F.col("id") + 10).alias("n")), path).columns == ["n"]
    assert old.count() == 3                                    # the version before stays readable
    for k in range(3):
        tables.replace(spark.range(k), path)
    assert tables.read(spark, path).count() == 2
    kept = [d for d in os.listdir(path) if d.startswith("v-")]
    assert len(kept) <= 3


def test_file_uri_and_catalog(spark, tmp_path):
    spark.sql("create database if not exists tables_test")
    uri = f"file://{tmp_path}/u"
    tables.replace(spark.range(4), uri, "tables_test.u")
    tables.replace(spark.range(5).withColumn("b", F.lit(1)), uri, "tables_test.u")
    assert spark.table("tables_test.u").count() == 5 and spark.table("tables_test.u").columns == ["id", "b"]
    assert tables.read(spark, uri).count() == 5
    spark.sql("drop database tables_test cascade")


def test_runs_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda run, n: spark.createDataFrame([(k, run) for k in range(n)], "k int, run string")
    tables.append_run(rows("0012", 3), path, "run")
    tables.append_run(rows("9e5", 2), path, "run")
    both = tables.append_run(rows("0012", 3), path, "run")     # a repeat adds nothing
    assert sorted((r.k, r.run) for r in both.collect()) == [(0, "0012"), (0, "9e5"), (1, "0012"), (1, "9e5"), (2, "0012")]
