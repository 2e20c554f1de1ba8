import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyspark.sql import Window

from txnwatch.functions.expr import epoch_seconds
from txnwatch.operators.features import _finish, add_features
from txnwatch.schema import FeatureSpec

SPEC = dict(pay_formats=("ACH", "Wire"))
COLS = ["sender_24h_count", "sender_24h_volume", "amt_vs_7d_avg", "unique_receivers_24h", "is_round_1000",
        "rapid_exit_risk", "is_interbank", "pay_ach", "pay_wire"]
T0 = dt.datetime(2022, 9, 1, 0, 0, 0)


def txn_frame(spark, rows):
    schema = ("txn_id long, ts timestamp_ntz, from_bank string, from_account string, to_bank string, "
              "to_account string, amount_paid double, payment_format string, label int")
    return spark.createDataFrame(rows, schema)


def plain_frames(df, spec):
    """The definition: range frames over the whole sender (the table of every test is small)."""
    base = Window.partitionBy("from_account").orderBy("_sec")
    day, week = base.rangeBetween(-(spec.short_window - 1), 0), base.rangeBetween(-(spec.long_window - 1), 0)
    framed = df.withColumn("_sec", epoch_seconds(df, "ts")).select(
        "*", F.count(F.lit(1)).over(day).alias("_c24"), F.sum("amount_paid").over(day).alias("_s24"),
        F.avg("amount_paid").over(week).alias("_avg7"), F.size(F.collect_set("to_account").over(day)).alias("_u24"))
    return _finish(framed, df.columns, spec)


def features(df, method="blocks"):
    spec = FeatureSpec(**SPEC)
    out = (plain_frames if method == "frame" else add_features)(df, spec).toPandas()
    return out.sort_values("txn_id").reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame):
    assert list(a.txn_id) == list(b.txn_id)
    for c in COLS:
        pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_names=False, rtol=1e-12,
                                       atol=1e-9)


def edge_rows():
    s = lambda sec: T0 + dt.timedelta(seconds=sec)
    return [
        (1, s(0), "B1", "A", "B2", "R1", 1000.0, "ACH", 0),
        (2, s(86399), "B1", "A", "B1", "R2", 50.0, "Wire", 0),      # 86,399 s later: same 24h frame
        (3, s(86400), "B1", "A", "B2", "R1", 70.0, "ACH", 1),       # 86,400 s after row 1: row 1 has left
        (4, s(86400), "B1", "A", "B2", "R3", 30.0, "Cash", 0),      # same second as row 3: peers
        (5, None, "B1", "A", "B2", "R4", 10.0, "ACH", 0),           # no time: own frame
        (6, None, "B1", "A", "B2", "R4", 20.0, "ACH", 0),
        (7, s(100), "B1", "A", "B2", None, None, "ACH", 0),         # null receiver and amount
        (8, s(5), "B9", None, "B2", "R1", 0.0, None, 0),            # null sender: one group of its own
        (9, s(6), None, None, "B2", "R2", 2000.0, "ACH", 0),
        (10, s(7 * 86400 + 50), "B1", "A", "B2", "R1", 1.0, "ACH", 0),
    ]


def test_frame_edges_by_hand(spark):
    out = features(txn_frame(spark, edge_rows())).set_index("txn_id")
    assert out.loc[2, "sender_24h_count"] == 3            # rows 1, 7, 2
    assert out.loc[3, "sender_24h_count"] == 4            # rows 7 (100 s), 2, 3 and its peer 4
    assert out.loc[3, "unique_receivers_24h"] == 3        # R2, R1, R3 (row 1 left the frame)
    assert out.loc[4, "sender_24h_count"] == out.loc[3, "sender_24h_count"]
    assert out.loc[5, "sender_24h_count"] == 2 and out.loc[6, "sender_24h_volume"] == 30.0
    assert out.loc[8, "sender_24h_count"] == 1 and out.loc[9, "sender_24h_count"] == 2
    assert out.loc[8, "is_round_1000"] == 1               # zero is a multiple of 1000
    assert pd.isna(out.loc[9, "is_interbank"])            # null bank -> null flag
    assert out.loc[1, "is_interbank"] == 1 and out.loc[2, "is_interbank"] == 0
    assert pd.isna(out.loc[7, "amt_vs_7d_avg"])


def test_blocks_equal_frames_on_edges(spark):
    df = txn_frame(spark, edge_rows())
    assert_same(features(df, "frame"), features(df, "blocks"))


def random_rows(n, senders, receivers, span_days, seed, hot=None):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        sender = hot if (hot and rnd.random() < 0.4) else f"S{rnd.randrange(senders)}"
        sec = rnd.randrange(span_days * 86400) if rnd.random() > 0.1 else rnd.choice([0, 86399, 86400, 604799])
        amt = None if rnd.random() < 0.02 else float(rnd.choice([1000, 2500, rnd.randrange(1, 20000)]))
        ts = None if rnd.random() < 0.01 else T0 + dt.timedelta(seconds=sec)
        rec = None if rnd.random() < 0.02 else f"R{rnd.randrange(receivers)}"
        rows.append((i, ts, f"B{rnd.randrange(3)}", sender, f"B{rnd.randrange(3)}", rec, amt,
                     rnd.choice(["ACH", "Wire", "Cash"]), int(rnd.random() < 0.1)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_frames_random(spark, seed):
    df = txn_frame(spark, random_rows(3000, 20, 15, 20, seed))
    assert_same(features(df, "frame"), features(df, "blocks"))


def test_hot_sender(spark):
    df = txn_frame(spark, random_rows(4000, 30, 200, 3, 7, hot="HOT"))
    assert_same(features(df, "frame"), features(df, "blocks"))


def test_result_independent_of_partitioning(spark):
    df = txn_frame(spark, random_rows(1500, 10, 10, 10, 3))
    base = features(df, "blocks")
    for n in (1, 7, 64):
        assert_same(base, features(df.repartition(n), "blocks"))


@pytest.mark.parametrize("seed", [4, 9])
def test_amounts_of_any_size_keep_full_precision(spark, seed):
    """Amounts from 1e-4 to 1e15 in one sender, held against exact sums."""
    rnd = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randrange(9 * 86400)), "B", "S" if rnd.random() < .7 else f"C{i % 40}", "B2",
             f"R{rnd.randrange(9)}", rnd.choice([1e15, 1e12, 0.01, 1e-4, rnd.random(), rnd.random() * 1e6]), "ACH", 0) for i in range(800)]
    rows += [(900, T0, "B", "X", "B", "R", 1e15, "ACH", 0), (901, T0 + dt.timedelta(seconds=60), "B", "X", "B", "R", 0.01, "ACH", 0),
             (902, T0 + dt.timedelta(days=1), "B", "X", "B", "R", 0.01, "ACH", 0)]
    got = features(txn_frame(spark, rows)).set_index("txn_id")
    assert got.loc[902, "sender_24h_volume"] == 0.02
    for r in rows:
        own = [x for x in rows if x[3] == r[3]]
        day = [x[6] for x in own if dt.timedelta(0) <= r[1] - x[1] < dt.timedelta(days=1)]
        week = [x[6] for x in own if dt.timedelta(0) <= r[1] - x[1] < dt.timedelta(days=7)]
        assert got.loc[r[0], "sender_24h_volume"] == pytest.approx(math.fsum(day), rel=1e-12)
        assert got.loc[r[0], "amt_vs_7d_avg"] == pytest.approx(r[6] / (math.fsum(week) / len(week) + 1e-6), rel=1e-12)


def test_no_group_holds_a_whole_hot_sender(spark):
    """A sender with 60 days of payments is dealt to groups of a day or a week."""
    rows = [(i, T0 + dt.timedelta(seconds=i * 500), "B", "HOT", "B", "R", 1.0, "ACH", 0) for i in range(10_000)]
    from txnwatch.operators.features import _block_sums, _next_visits, _placed
    df = txn_frame(spark, rows)
    pairs = df.select("from_account", F.col("to_account").alias("_r"), epoch_seconds(df, "ts").alias("_ts_sec"),
                      F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("s"), F.lit(1).cast("long").alias("m"))
    placed = _placed(_next_visits(pairs, ["from_account"], 86400), ["from_account"], 86400, 604800)
    plan = _block_sums(placed, ["from_account"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(from_account" in plan and "block" in plan.split("windowspecdefinition(from_account")[1].split("ASC")[0]


def test_fixture_velocity_count(spark):
    from txnwatch.plans.queries import silver
    s = silver(spark, "/root/testdata/sf0.01")
    assert s.count() == 10000
    assert s.where(F.col("sender_24h_count") > 3).count() == 3815
    assert s.agg(F.max("sender_24h_count")).first()[0] == 11


def test_groups_are_dealt_to_as_many_tasks_as_the_payments_need(spark, monkeypatch):
    from txnwatch.operators import features as fe
    from txnwatch.sources.fixture import FIXTURE_FORMATS, load_txn

    assert fe.task_count(6_000_000, 12) == 60 and fe.task_count(36_000_000, 12) == 360
    assert fe.task_count(0, 12) == 1 and fe.task_count(30_000, 12) == 3 and fe.task_count(500_000, 12) == 12
    txn = load_txn(spark, "/root/testdata/sf0.001")
    spec = FeatureSpec(pay_formats=FIXTURE_FORMATS)
    expected = sorted(map(tuple, add_features(txn, spec).collect()))
    monkeypatch.setattr(fe, "ROWS_PER_TASK", -(-txn.count() // 23))
    silver = add_features(txn, spec)
    plan = silver._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and all(line.rstrip().endswith(", 23") for line in dealt)
    assert sorted(map(tuple, silver.collect())) == expected
