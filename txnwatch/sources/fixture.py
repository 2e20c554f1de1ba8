"""The canonical transaction table built from the driver's test tables.

The published pipeline reads a payments CSV that is not available offline, so
the tests and registered queries run on a stand-in derived from ``events`` and
``customer`` (see FIXTURES.md section 3).  Every column is computed by Spark
from the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stand-in (FIXTURES.md section 3).
RECEIVER_BANKS = 25
LABEL_MIN_VALUE = 100
LABEL_RECEIVER_MOD = 4
TYPOLOGY_MOD = 3
FIXTURE_FORMATS = ("click", "error", "purchase", "signup", "view")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn_id, ts, from_bank, from_account, to_bank, to_account, amount_paid,
    payment_format, label, typology`` from ``events`` left-joined to ``customer``.

    The customer join is left to the optimizer: it broadcasts ``customer`` only
    while its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    events = read_table(spark, sf_dir, "events")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    planted = (F.col("value") > LABEL_MIN_VALUE) & (F.col("k") % LABEL_RECEIVER_MOD == 0)
    j = e.join(customer, e.user_id == customer.c_custkey, "left")
    return j.select(
        F.col("event_id").alias("txn_id"),
        F.col("ts"),
        F.col("c_nationkey").alias("from_bank"),
        F.col("user_id").alias("from_account"),
        (F.col("k") % RECEIVER_BANKS).alias("to_bank"),
        F.col("k").alias("to_account"),
        F.round(F.col("value") * 100).alias("amount_paid"),
        F.col("event_type").alias("payment_format"),
        F.when(planted, 1).otherwise(0).cast("int").alias("label"),
        F.when(planted & (F.col("k") % TYPOLOGY_MOD != 0),
               F.concat(F.lit("PATTERN-"), (F.col("k") % TYPOLOGY_MOD).cast("string"))).alias("typology"),
    )


# The same table in DuckDB SQL, for the oracle side of every registered query.
TXN_SQL = """
select e.event_id as txn_id, e.ts,
       c.c_nationkey as from_bank, e.user_id as from_account,
       e.k % 25 as to_bank, e.k as to_account,
       round(e.value * 100) as amount_paid,
       e.event_type as payment_format,
       cast(case when e.value > 100 and e.k % 4 = 0 then 1 else 0 end as int) as label,
       case when e.value > 100 and e.k % 4 = 0 and e.k % 3 <> 0
            then concat('PATTERN-', cast(e.k % 3 as varchar)) end as typology
from (select *, cast(props->>'$.k' as bigint) as k from events) e
left join customer c on c.c_custkey = e.user_id
"""


def load_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored-set stand-in from ``lineitem`` (FIXTURES.md section 4): many tied scores.

    ``id`` columns ``l_orderkey, l_linenumber`` order ties; ``label`` is a
    returned line, ``prob`` a rounded price score.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.round(F.col("l_extendedprice") / 105000, 3).alias("prob"),
    )


SCORED_SQL = """
select l_orderkey, l_linenumber,
       cast(l_returnflag = 'R' as int) as label,
       round(l_extendedprice / 105000, 3) as prob
from lineitem
"""
SCORED_IDS = ["l_orderkey", "l_linenumber"]
