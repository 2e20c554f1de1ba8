"""Per-sender behaviour over trailing time frames (silver features).

For every payment at second ``t`` the frame is ``(t - width, t]`` over the same
sender's payments, peers in the same second included:

* ``sender_24h_count``      rows in the 24h frame
* ``sender_24h_volume``     sum of amounts in the 24h frame
* ``amt_vs_7d_avg``         amount / (7-day mean amount + 1e-6)
* ``unique_receivers_24h``  distinct receivers in the 24h frame
* ``is_round_1000``, ``rapid_exit_risk``, ``is_interbank`` and one-hot formats.

One physical form serves every size.  Payments are summed per (sender, receiver, second)
first (map-side), and all frames follow from that one table:

* A frame is cut at multiples of its width: the part inside the payment's own block is a
  running sum up to ``t``, the part in the block before it a running sum from its end down
  to ``t - width``.  Both only ever add amounts that lie in the frame, so nothing is
  retracted and sums keep full precision whatever else the sender paid.
* Distinct receivers are counted by integers: each visit of a receiver opens at ``t`` and
  closes at the pair's next visit or ``t + width``; the running count of open visits at ``t``
  is the answer (exact, as counts do not round).

Sums, questions and visit changes of a (sender, block) are added up per second, so a group
holds at most one row per second of a day or week however hot the sender is, and a hot
sender's blocks are dealt to different tasks.  Bronze is read twice: for the pairs, and to
attach the values of its second to every payment.

Payments without a time form one frame per sender.

The groups are dealt to as many tasks as the payments need (``ROWS_PER_TASK``, one count
ahead): a payment is up to seven rows on the way, so tasks of Spark's usual size in shuffled
bytes would hold many times that in their sorts and hash tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from txnwatch.functions.expr import differs, epoch_seconds, is_multiple, one_hot, safe_ratio
from txnwatch.schema import ROUND_UNIT, FeatureSpec

ROWS_PER_TASK = 100_000      # payments whose groups a task sorts and sums
FEW_ROWS = 10_000            # a small table is spread over the cores down to so many payments
MOST_TASKS = 100_000


def add_features(txn: DataFrame, spec: FeatureSpec | None = None) -> DataFrame:
    """Bronze transactions -> silver: every input column plus the feature columns."""
    spec = spec or FeatureSpec()
    return _finish(_frame_values(txn, spec), txn.columns, spec)


def _finish(df: DataFrame, base_cols: list[str], spec: FeatureSpec) -> DataFrame:
    c = spec.cols
    return df.select(
        *[F.col(x) for x in base_cols],
        F.col("_c24").cast("int").alias("sender_24h_count"),
        F.col("_s24").alias("sender_24h_volume"),
        safe_ratio(c.amount, "_avg7").alias("amt_vs_7d_avg"),
        F.col("_u24").cast("int").alias("unique_receivers_24h"),
        is_multiple(c.amount, ROUND_UNIT).alias("is_round_1000"),
        safe_ratio("_s24", c.amount).alias("rapid_exit_risk"),
        differs(c.sender_bank, c.receiver_bank).alias("is_interbank"),
        *one_hot(c.payment_format, spec.pay_formats),
    )


# ---------------------------------------------------------------------------
# frame values
# ---------------------------------------------------------------------------
def _null_safe_key(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Two non-null columns that identify a possibly-null key, so equi-joins keep
    the null group (a plain join on a null key would drop it)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NumericType):
        fill = F.lit(0).cast(dtype)
    elif isinstance(dtype, StringType):
        fill = F.lit("")
    else:
        return F.col(name).isNull(), F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.col(name).isNull(), F.coalesce(F.col(name), fill)


def task_count(rows: int, cores: int) -> int:
    """Tasks for the groups of so many payments."""
    return max(1, min(MOST_TASKS, -(-rows // ROWS_PER_TASK)), min(cores, -(-rows // FEW_ROWS)))


def _dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``df`` in so many tasks by the columns ``by``; without a number the windows' own exchange deals it."""
    return df.repartition(tasks, *by) if tasks else df


def _frame_values(txn: DataFrame, spec: FeatureSpec) -> DataFrame:
    c = spec.cols
    tasks = task_count(txn.count(), txn.sparkSession.sparkContext.defaultParallelism)
    kn, kv = _null_safe_key(txn, c.sender)
    rows = txn.withColumn("_ts_sec", epoch_seconds(txn, c.ts)).withColumn("_kn", kn).withColumn("_kv", kv)
    keys = ["_kn", "_kv"]
    amount = F.col(c.amount).cast("double")
    pairs = rows.groupBy(*keys, F.col(c.receiver).alias("_r"), "_ts_sec").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("s"), F.count(amount).alias("m"))
    placed = _placed(_next_visits(pairs, keys, spec.short_window, tasks), keys, spec.short_window, spec.long_window)
    sums = _block_sums(placed, keys, tasks)

    # the up to four parts of a second's frames
    day, week, untimed = F.col("width") == spec.short_window, F.col("width") == spec.long_window, F.col("width") == 0
    parts = sums.select(*keys, "_ts_sec", *[F.when(day | untimed, F.col(v)).alias(v + "24") for v in ("n", "s", "m", "u")],
                        *[F.when(week | untimed, F.col(v)).alias(v + "7") for v in ("s", "m")])
    at = parts.groupBy(*keys, "_ts_sec").agg(*[F.sum(v).alias(v) for v in ("n24", "s24", "m24", "u24", "s7", "m7")])
    tn, tv = F.col("_ts_sec").isNull().alias("_tn"), F.coalesce("_ts_sec", F.lit(0).cast("long")).alias("_tv")
    at = at.select(*keys, tn, tv, F.col("n24").alias("_c24"), F.when(F.col("m24") > 0, F.col("s24")).alias("_s24"),
                   F.when(F.col("m7") > 0, F.col("s7") / F.col("m7")).alias("_avg7"), F.col("u24").alias("_u24"))
    return rows.select("*", tn, tv).join(at, on=[*keys, "_tn", "_tv"], how="inner").drop(*keys, "_tn", "_tv", "_ts_sec")


def _next_visits(pairs: DataFrame, keys: list[str], width: int, tasks: int | None = None) -> DataFrame:
    """``pairs`` with ``_off``, the end of a visit's coverage: the pair's next visit or
    ``t + width``, whichever is first.

    The next visit is a ``lead`` inside buckets of the width; every visit is also
    copied into the previous bucket as a look-ahead row, so a bucket's last
    visit sees the first visit of the next bucket (a later one is past
    ``t + width`` anyway).  Groups hold at most two buckets of seconds.
    """
    bucket = F.floor(F.col("_ts_sec") / F.lit(width))
    copies = F.array_compact(F.array(F.struct(bucket.alias("_db"), F.lit(True).alias("_own")),
                                     F.when(F.col("_ts_sec").isNotNull(), F.struct((bucket - 1).alias("_db"), F.lit(False).alias("_own")))))
    both = pairs.select("*", F.explode(copies).alias("_c")).select(*pairs.columns, "_c.*")
    both = _dealt(both, tasks, *keys, "_r", "_db")
    order = Window.partitionBy(*keys, "_r", "_db").orderBy("_ts_sec")
    end = F.col("_ts_sec") + F.lit(width)
    return both.withColumn("_next", F.lead("_ts_sec").over(order)).where("_own") \
        .withColumn("_off", F.least(F.coalesce("_next", end), end)).drop("_db", "_own", "_next")


def _placed(visits: DataFrame, keys: list[str], short: int, long: int) -> DataFrame:
    """Rows (sender, width, block, at) of everything that happens in a block, one per second:
    the sums n, s, m paid then, ``by``, by how much the number of open visits changes,
    ``point``, whether a payment was made, and ``asks``, whether a frame begins there whose
    second lies in the next block.  Payments without a time are width 0."""
    t, off, zero = F.col("_ts_sec"), F.col("_off"), F.lit(0).cast("long")
    visit = F.when(F.col("_r").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")

    def row(width, block, at, by=zero, point=False, asks=False):
        paid = (F.col("n"), F.col("s"), F.col("m")) if point else (zero, F.lit(0.0), zero)
        return F.struct(F.lit(width).alias("width"), block.alias("block"), at.alias("at"), *[x.alias(v) for x, v in zip(paid, ("n", "s", "m"))],
                        by.alias("by"), F.lit(point).alias("point"), F.lit(asks).alias("asks"))

    timed = []
    for w in sorted({short, long}):
        block = F.floor(t / F.lit(w))
        timed += [row(w, block, t, visit if w == short else zero, point=True), row(w, block - 1, t - w + 1, asks=True)]
    # a visit closes in its block, or goes on into the next one
    block = F.floor(t / F.lit(short))
    border = (block + 1) * F.lit(short)
    met, beyond = F.col("_r").isNotNull(), off > border
    timed += [F.when(met & ~beyond, row(short, block, off, -visit)), F.when(met & beyond, row(short, block + 1, border, visit)),
              F.when(met & beyond, row(short, block + 1, off, -visit))]
    untimed = F.array(row(0, zero, F.lit(None).cast("long"), visit, point=True))
    rows = visits.select(*keys, F.explode(F.when(t.isNull(), untimed).otherwise(F.array_compact(F.array(*timed)))).alias("p"))
    return rows.select(*keys, "p.*").groupBy(*keys, "width", "block", "at").agg(
        *[F.sum(v).alias(v) for v in ("n", "s", "m", "by")], *[F.max(v).alias(v) for v in ("point", "asks")])


def _block_sums(placed: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """(sender, second, width) rows n, s, m, u whose sums are the frame ``(t - width, t]``: the
    own block up to ``t``, and the block before from its end down to ``t - width + 1``."""
    group = Window.partitionBy(*keys, "width", "block")
    up = group.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = group.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = _dealt(placed, tasks, *keys, "width", "block")
    sums = dealt.select("*", *[F.sum(v).over(up).alias(f"{v}_up") for v in ("n", "s", "m", "by")],
                         *[F.sum(v).over(down).alias(f"{v}_down") for v in ("n", "s", "m")])

    def part(second, way, u):
        return F.struct(second.alias("_ts_sec"), *[F.col(f"{v}_{way}").alias(v) for v in ("n", "s", "m")], u.alias("u"))

    both = F.array_compact(F.array(F.when(F.col("point"), part(F.col("at"), "up", F.col("by_up"))),
                                   F.when(F.col("asks"), part(F.col("at") + F.col("width") - 1, "down", F.lit(0).cast("long")))))
    return sums.select(*keys, "width", F.explode(both).alias("p")).select(*keys, "width", "p.*")


# ---------------------------------------------------------------------------
# checks on the silver table
# ---------------------------------------------------------------------------
def class_means(silver: DataFrame, features: list[str], label: str = "label", digits: int = 3) -> DataFrame:
    """Per-class feature means rounded to ``digits`` (D3), ordered by label."""
    return (silver.groupBy(label).agg(*[F.round(F.avg(f), digits).alias(f) for f in features])
            .orderBy(label))


def reconcile(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Row counts of silver and bronze side by side and whether they agree."""
    both = (silver.select(F.lit(1).alias("s"), F.lit(0).alias("b"))
            .unionByName(bronze.select(F.lit(0).alias("s"), F.lit(1).alias("b"))))
    return (both.agg(F.sum("s").alias("silver_rows"), F.sum("b").alias("bronze_rows"))
            .withColumn("rows_match", F.col("silver_rows") == F.col("bronze_rows")))
