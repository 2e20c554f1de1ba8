import os
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from txnwatch.operators import ingest

PATTERNS = """2022/09/01 00:01,001,A0,002,B0,5.00,Euro,5.00,Euro,ACH,1
BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 16-degree Fan-Out
2022/09/01 00:06,021174,A1,012,B1,10.00,Euro,10.00,Euro,ACH,1
2022/09/01 00:07,021174,A1,012,B2,11.00,Euro,11.00,Euro,ACH,1,extra
END LAUNDERING ATTEMPT - FAN-OUT

BEGIN LAUNDERING ATTEMPT - CYCLE
2022/09/02 10:00,000952,C1,000953,C2,99.50,US Dollar,99.50,US Dollar,Wire,1
END LAUNDERING ATTEMPT - CYCLE
2022/09/02 11:00,000952,C3,000953,C4,1.00,US Dollar,1.00,US Dollar,Wire,1
BEGIN LAUNDERING ATTEMPT - STACK: empty block
END LAUNDERING ATTEMPT - STACK
"""

CSV = """Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering
2022/09/01 00:06,021174,A1,012,B1,10.00,Euro,10.00,Euro,ACH,1
2022/09/01 00:06,021174,A1,012,B1,10.00,Euro,10.00,Euro,ACH,1
2022/09/02 10:00,000952,C1,000953,C2,99.50,US Dollar,99.50,US Dollar,Wire,0
2022/09/03 10:00,000952,C9,000953,C2,5.00,US Dollar,5.00,US Dollar,Wire,0
not a time,000952,C9,000953,C2,5.00,US Dollar,5.00,US Dollar,Wire,0
"""


T0 = dt.datetime(2022, 9, 1)

def write(text, name):
    d = tempfile.mkdtemp(prefix="txnwatch-ingest-")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_pattern_blocks(spark):
    recs = ingest.read_pattern_records(spark, write(PATTERNS, "p.txt")).toPandas()
    got = sorted(zip(recs.from_account, recs.typology.fillna("-")))
    assert got == [("A0", "-"), ("A1", "FAN-OUT"), ("A1", "FAN-OUT"), ("C1", "CYCLE"), ("C3", "CYCLE")]
    assert set(recs.from_bank) == {"001", "021174", "000952"}          # zero padding kept
    assert "extra" not in set(recs.payment_format)


def test_blocks_of_any_size_are_split(spark):
    """A block over many file splits, markers in the middle of a line, and files of their own."""
    row = "2022/09/01 00:06,021174,{},012,{},10.00,Euro,10.00,Euro,ACH,1"
    text, want = [row.format("A-none", "BEGIN LAUNDERING ATTEMPT - X")], [("A-none", None)]
    for block, n in (("FAN-OUT", 900), ("CYCLE", 3), ("EMPTY", 0), ("STACK", 700)):
        text += [f"  BEGIN LAUNDERING ATTEMPT - {block}:  Max 3\r"] + [row.format(f"{block}{i}", "B") for i in range(n)] + ["END LAUNDERING ATTEMPT", ""]
        want += [(f"{block}{i}", block) for i in range(n)]
    text += [row.format("late", "B")]
    want += [("late", "STACK")]
    d = os.path.dirname(write("\n".join(text), "one.txt"))
    with open(os.path.join(d, "two.txt"), "w") as f:
        f.write(row.format("other", "B") + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(d).rdd.getNumPartitions() > 10
        got = ingest.read_pattern_records(spark, d).select("from_account", "typology").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=str) == sorted(want + [("other", None)], key=str)


def test_csv_lookup_join_profile(spark):
    trans = ingest.read_transactions(spark, write(CSV, "t.csv"))
    assert trans.columns[:2] == ["from_bank", "from_account"] and "ts" in trans.columns
    recs = ingest.read_pattern_records(spark, write(PATTERNS, "p.txt"))
    dup = recs.unionByName(recs.withColumn("typology", F.lit("AAA-FIRST")))
    lookup = ingest.typology_lookup(dup)
    assert lookup.count() == 5                      # one row per record key
    bronze = ingest.attach_typology(trans, lookup)
    assert bronze.count() == 5
    p = ingest.ingest_profile(bronze).first()
    assert (p["rows"], p["positives"], p["null_timestamps"]) == (5, 2, 1)
    assert p["rows_with_typology"] == 3 and p["positives_with_typology"] == 2
    typ = {r["typology"]: r["count"] for r in ingest.typology_counts(bronze).collect()}
    assert typ == {"AAA-FIRST": 2}


def test_pipeline_tables_in_catalog(spark):
    from txnwatch.plans import pipeline as pl
    d = tempfile.mkdtemp(prefix="txnwatch-db-")
    cfg = pl.PipelineConfig(out_dir=d, database="txnw_test")
    df = spark.range(3).withColumnRenamed("id", "txn_id")
    back = pl.write(df, cfg, "bronze", "ids")
    assert back.count() == 3
    assert spark.table("txnw_test_bronze.ids").count() == 3
    pl.write(df.limit(1), cfg, "bronze", "ids")                     # overwrite
    assert spark.table("txnw_test_bronze.ids").count() == 1


def test_hot_sender_is_written_in_several_blocks(spark):
    from txnwatch.sources import raw_files
    from txnwatch.session import work_dir
    rows = [(i, T0, "1", "HOT" if i % 5 else f"A{i}", "2", "R", float(i), "ACH", 1, "CYCLE") for i in range(500)] + \
        [(900, T0, "1", None, "2", "R", 9.0, "ACH", 1, "CYCLE")]
    txn = spark.createDataFrame(rows, "txn_id long, ts timestamp_ntz, from_bank string, from_account string, to_bank string, "
                                      "to_account string, amount_paid double, payment_format string, label int, typology string")
    path = work_dir(spark, "hot-blocks")
    raw_files.write_pattern_blocks(txn, path, block_rows=50)
    blocks = [b for r in spark.read.option("wholetext", True).text(path).collect() for b in r[0].split("BEGIN LAUNDERING")[1:]]
    assert max(b.count(",ACH,") for b in blocks) < 120 and len(blocks) > 100
    got = ingest.read_pattern_records(spark, path)
    assert got.count() == 501 and got.where("typology = 'CYCLE'").count() == 501
