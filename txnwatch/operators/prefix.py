"""Running sums in a global order without funnelling rows through one task.

``Window.orderBy`` with no partition moves every row to a single task.  Here the
rows are range-partitioned on the order (so each chunk is a contiguous slice),
written to the checkpoint folder (chunk ids stay fixed if an executor is lost
and the lineage is cut), summed inside each chunk, and shifted by the totals of
all earlier chunks.  The offset table has one row per (chunk, group), so with
no groups it is bounded by the chunk count and is broadcast; with groups it is
stored and joined as the planner sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.session import ensure_checkpoint_dir

def _ranged(df: DataFrame, keys: list[Column], num_chunks: int | None) -> DataFrame:
    """Range-partition on ``keys``.  Without ``num_chunks`` the count is left to
    the session: ``spark.sql.shuffle.partitions`` ranges, which AQE merges into
    contiguous chunks of its advisory size (so a small table is not spread over
    thousands of empty chunks, and the order of chunks is kept)."""
    if num_chunks:
        return df.repartitionByRange(num_chunks, *keys)
    return df.repartitionByRange(*keys)


def _offset_table(offsets: DataFrame, grouped: bool) -> DataFrame:
    """The per-(chunk, group) offset table, ready to join back to the chunks.

    Without groups it has at most one row per chunk and is broadcast as it is.
    With groups the input was range-partitioned on the groups first, so a chunk
    holds a contiguous run of groups and the table has at most chunks + groups - 1
    rows, which is bounded only by the number of groups: it is stored, and the
    planner picks the join from its measured size.
    """
    return offsets.checkpoint(eager=True) if grouped else F.broadcast(offsets)


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, Column],
                groups: list[str] = (), num_chunks: int | None = None, totals: bool = False) -> DataFrame:
    """Add one inclusive running-sum column per entry of ``values`` (and, with
    ``totals``, a ``total_<name>`` column holding the whole group's sum).

    ``order`` must be a total order (end it with a unique id); ``groups`` restart
    the sums (they must be non-null).  Cost: one range shuffle, one checkpoint,
    one hash shuffle of the chunks, and a small offset table.
    """
    groups = list(groups)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    vals = df.select("*", *[c.alias("_v_" + k) for k, c in values.items()])
    ranged = (_ranged(vals, [*[F.col(g) for g in groups], *order], num_chunks)
              .withColumn("_chunk", F.spark_partition_id())
              .checkpoint(eager=True))
    w_local = (Window.partitionBy("_chunk", *groups).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum("_v_" + k).over(w_local).alias("_l_" + k) for k in values])
    totals = ranged.groupBy("_chunk", *groups).agg(*[F.sum("_v_" + k).alias("_t_" + k) for k in values])
    w_before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    offsets = totals.select("_chunk", *groups,
                            *[F.coalesce(F.sum("_t_" + k).over(w_before), F.lit(0)).alias("_o_" + k)
                              for k in values],
                            *[F.sum("_t_" + k).over(w_all).alias("total_" + k) for k in values])
    out = local.join(_offset_table(offsets, bool(groups)), on=["_chunk", *groups], how="inner")
    drop = ["_chunk"] + [p + k for k in values for p in ("_v_", "_l_", "_o_")]
    if not totals:
        drop += ["total_" + k for k in values]
    return out.select("*", *[(F.col("_l_" + k) + F.col("_o_" + k)).alias(k) for k in values]).drop(*drop)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", groups: list[str] = (),
                num_chunks: int | None = None, size_name: str | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (within ``groups``).

    One range shuffle, no window: after the range exchange each partition is
    sorted locally and ``monotonically_increasing_id`` records (partition,
    position in partition); the result is checkpointed so both numbers are
    fixed, and a per-(chunk, group) count table (bounded by chunks x groups
    present in them) turns them into global ranks.  ``order`` must be total.
    With ``size_name`` the group's row count is added as well (from the same
    count table, no extra pass).
    """
    groups = list(groups)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*[F.col(g) for g in groups], *order]
    ranged = (_ranged(df, keys, num_chunks).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_chunk", F.shiftrightunsigned("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_chunk", *groups).agg(F.count(F.lit(1)).alias("_c"),
                                                   F.min("_pos").alias("_first"))
    w_before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_chunk", *groups, "_first",
                            F.coalesce(F.sum("_c").over(w_before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(Window.partitionBy(*groups)).alias("_size"))
    out = ranged.join(_offset_table(offsets, bool(groups)), on=["_chunk", *groups], how="inner")
    rank = F.col("_off") + F.col("_pos") - F.col("_first") + 1
    out = out.withColumn(name, rank)
    if size_name:
        out = out.withColumnRenamed("_size", size_name)
    return out.drop("_mid", "_chunk", "_pos", "_first", "_off", "_size")
