import pytest
from pyspark.sql import functions as F

from txnwatch.operators import rules


def test_summary_reproduces_published_rule_row(spark):
    # counts of the published comparison: 407,046 test rows, 7,046 positives, 5,506 caught, 295,992 false alerts
    n, pos, tp, fp = 407_046, 7_046, 5_506, 295_992
    df = spark.range(n).select(
        (F.col("id") < pos).cast("int").alias("label"),
        ((F.col("id") < tp) | ((F.col("id") >= pos) & (F.col("id") < pos + fp))).cast("int").alias("pred"))
    r = rules.summarise(df, rules.RULES_SYSTEM, "pred").first()
    assert (r["alerts"], r["true_positives"], r["false_positives"]) == (301_498, 5_506, 295_992)
    assert round(r["recall"], 4) == 0.7814 and round(r["precision"], 4) == 0.0183
    assert round(r["alert_rate"], 4) == 0.7407
    comp = spark.createDataFrame([(rules.RULES_SYSTEM, 295_992), ("m @ same recall as rules", 14_298)],
                                 "system string, false_positives long")
    assert round(rules.false_positive_reduction(comp).first()[0], 3) == 0.952


def test_rules_and_breakdown(spark):
    rows = [(1, 20000.0, 1, 0, 1), (2, 3000.0, 5, 0, 0), (3, 6000.0, 1, 1, 1), (4, 1000.0, 1, 0, 0),
            (5, None, None, None, 0)]
    df = spark.createDataFrame(rows, "txn_id long, amount_paid double, sender_24h_count int, is_interbank int, "
                                     "label int")
    flags = rules.rule_flags(df, rules.default_rules()).orderBy("txn_id").toPandas()
    assert flags.large_amount.tolist() == [1, 0, 0, 0, 0]
    assert flags.high_velocity.tolist() == [0, 1, 0, 0, 0]
    assert flags.round_number.tolist() == [1, 1, 1, 1, 0]
    assert flags.interbank_risk.tolist() == [0, 0, 1, 0, 0]
    assert flags.rbs_alert.tolist() == [1, 1, 1, 1, 0]
    b = {r["rule"]: r for r in rules.rule_breakdown(df, rules.default_rules()).collect()}
    assert b["round_number"]["alerts"] == 4 and b["round_number"]["precision"] == 0.5
    assert b["large_amount"]["recall"] == 0.5


def test_all_rules_silent_and_no_positives(spark):
    df = spark.createDataFrame([(1, 1.5, 1, 0, 0, 0.2)], "txn_id long, amount_paid double, "
                               "sender_24h_count int, is_interbank int, label int, prob double")
    comp = rules.compare_with_model(df, rules.default_rules(), "m", 0.5, ["txn_id"]).collect()
    assert [r["alerts"] for r in comp] == [0, 0, 0]
    assert all(r["recall"] == 0.0 for r in comp)
    b = rules.rule_breakdown(df, rules.default_rules()).collect()
    assert all(r["precision"] == 0.0 and r["recall"] is None for r in b)
