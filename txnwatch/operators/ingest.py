"""Raw files -> bronze: transactions CSV, labelled pattern blocks, typology join,
and the quality profile of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnwatch.functions.expr import parse_ts, typology_from_header
from txnwatch.session import work_dir
from txnwatch.schema import (BLOCK_BEGIN, BLOCK_END, JOIN_KEYS, PATTERN_RECORD_COLUMNS, TRANSACTION_CSV_SCHEMA)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions CSV with the explicit schema (columns bind by position, so the
    repeated header name does not matter); ``ts`` is the wall-clock time of ``ts_raw``
    without a zone.

    ``txn_id`` is ``monotonically_increasing_id``: unique for every row, repeated records
    included.  It depends on the file splits, so store the table before relying on it."""
    raw = spark.read.option("header", True).schema(TRANSACTION_CSV_SCHEMA).csv(path)
    return raw.withColumn("ts", parse_ts("ts_raw")).withColumn("txn_id", F.monotonically_increasing_id()).drop("ts_raw")


def read_pattern_records(spark: SparkSession, path: str) -> DataFrame:
    """Parse a labelled-block text file into ``ts_raw .. payment_format, typology``
    rows (all text), one per record line.

    A line that begins with the block marker names the typology of the lines after it (text
    after the first '-', before ':'); ``END`` lines and blank lines are skipped; lines
    before the first block of a file have no typology, and lines after an ``END`` keep the
    block's.  Files are read line by line and split like any text file, so a block
    may be of any size: the records are stored once with their file split and place, a
    split looks up the last header above a line by itself, and what a split inherits is the
    last header of the splits before it (one row a split).
    """
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    head = F.when(F.col("line").startswith(BLOCK_BEGIN), F.struct(typology_from_header("line").alias("typology")))
    lines = spark.read.text(path).select(
        line.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place")).where((F.col("line") != "") & ~F.col("line").startswith(BLOCK_END))
    stored = work_dir(spark, "pattern-lines")
    lines.withColumn("head", head).write.parquet(stored)
    lines = spark.read.parquet(stored)

    ends = lines.groupBy("file", "split").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("place"))).alias("end"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select("file", "split", F.last("end", ignorenulls=True).over(before).alias("above"))
    here = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    records = lines.withColumn("own", F.last("head", ignorenulls=True).over(here)).where(F.col("head").isNull())
    records = records.join(inherited, ["file", "split"], "left")
    schema = ", ".join(f"{c} string" for c in PATTERN_RECORD_COLUMNS)
    parsed = records.select(F.from_csv("line", schema).alias("r"), F.coalesce("own", "above")["typology"].alias("typology"))
    return parsed.select(*[F.col("r." + c).alias(c) for c in PATTERN_RECORD_COLUMNS], "typology")


def typology_lookup(records: DataFrame, keys: list[str] = JOIN_KEYS) -> DataFrame:
    """One typology per full record key (``keys`` + ``typology``), typed for the
    join.  The survivor of duplicate keys is the smallest typology, so the
    result does not depend on partitioning."""
    typed = (records.withColumn("ts", parse_ts("ts_raw"))
             .withColumn("amount_paid", F.col("amount_paid").try_cast("double")))
    return typed.groupBy(*keys).agg(F.min("typology").alias("typology"))


def attach_typology(trans: DataFrame, lookup: DataFrame, keys: list[str] = JOIN_KEYS) -> DataFrame:
    """Left join on the full record key; a null in any key never matches.  The
    lookup has one row per key, so the join cannot add rows.  The strategy is
    left to the optimizer (AQE broadcasts the lookup when its measured size is
    small, else sort-merge)."""
    return trans.join(lookup, on=keys, how="left")


def ingest_profile(bronze: DataFrame, label: str = "label", typology: str = "typology",
                   ts: str = "ts") -> DataFrame:
    """One row: rows, positives, null timestamps, rows with a typology, positives
    with a typology, positive rate."""
    pos = F.col(label) == 1
    return bronze.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label)).cast("long").alias("positives"),
        F.count_if(F.col(ts).isNull()).alias("null_timestamps"),
        F.count_if(F.col(typology).isNotNull()).alias("rows_with_typology"),
        F.count_if(pos & F.col(typology).isNotNull()).alias("positives_with_typology"),
    ).withColumn("positive_rate", F.col("positives") / F.col("rows"))


def pattern_counts(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Parsed pattern records next to the unique record keys that remain."""
    both = records.select(F.lit(1).alias("r"), F.lit(0).alias("u")).unionByName(lookup.select(F.lit(0).alias("r"), F.lit(1).alias("u")))
    return both.agg(F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("parsed_records"),
                    F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unique_records"))


def typology_counts(bronze: DataFrame, label: str = "label", typology: str = "typology") -> DataFrame:
    """Positives per typology (null is its own group), most frequent first."""
    return (bronze.where(F.col(label) == 1).groupBy(typology).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count")))
