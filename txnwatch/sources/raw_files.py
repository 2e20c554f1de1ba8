"""Raw-file layouts of the published pipeline, written by Spark from a
transaction table (so raw-file ingest can be exercised on the driver's tables).

* transactions CSV: a header row, then eleven positional fields
  (``yyyy/MM/dd HH:mm`` time, banks and accounts as text, amounts, currencies,
  format, 0/1 label);
* pattern text: blocks ``BEGIN LAUNDERING ATTEMPT - <TYPOLOGY>: <detail>``,
  one CSV record per line, closed by ``END LAUNDERING ATTEMPT - <TYPOLOGY>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.schema import BLOCK_BEGIN, TS_PATTERN

# Fixed value: the stand-in has a single currency.
FIXTURE_CURRENCY = "US Dollar"
CSV_HEADER_NAMES = ["Timestamp", "From Bank", "Account", "To Bank", "Account_", "Amount Received",
                    "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]


def _record_columns(txn: DataFrame) -> list:
    return [
        F.date_format("ts", TS_PATTERN),
        F.col("from_bank").cast("string"), F.col("from_account").cast("string"),
        F.col("to_bank").cast("string"), F.col("to_account").cast("string"),
        F.col("amount_paid").cast("string"), F.lit(FIXTURE_CURRENCY),
        F.col("amount_paid").cast("string"), F.lit(FIXTURE_CURRENCY),
        F.col("payment_format"), F.col("label").cast("string"),
    ]


def write_transactions_csv(txn: DataFrame, path: str) -> None:
    """Header + positional records; nulls are written as empty fields."""
    cols = [c.alias(n) for c, n in zip(_record_columns(txn), CSV_HEADER_NAMES)]
    txn.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_pattern_blocks(txn: DataFrame, path: str, block_keys: tuple = ("typology", "from_account"),
                         block_rows: int = 10_000) -> None:
    """Blocks per (typology, sender) of about ``block_rows`` records for rows with a typology.

    A hot sender's records are dealt by id to as many blocks as that takes, so no task and no
    block grows with it.  Blocks are hash-partitioned by their key and each partition is sorted
    by (block, line kind, id), so every block lands whole and in order in one file.
    """
    typed = txn.where(F.col("typology").isNotNull())
    blocks_of = typed.groupBy(*block_keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    same = [typed[k].eqNullSafe(blocks_of[k]) for k in block_keys]
    tagged = typed.join(blocks_of, same).select(typed["*"], F.pmod(F.xxhash64("txn_id"), F.col("_blocks")).alias("_block"))
    block_keys = (*block_keys, "_block")
    record = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in _record_columns(tagged)])
    keys = [F.col(k) for k in block_keys]
    recs = tagged.select(*keys, F.lit(1).alias("_kind"), F.col("txn_id").alias("_ord"), record.alias("value"))
    blocks = tagged.select(*keys).distinct()
    heads = blocks.select(*keys, F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_ord"),
                          F.concat(F.lit(BLOCK_BEGIN + " - "), F.col("typology"), F.lit(": from table")).alias("value"))
    ends = blocks.select(*keys, F.lit(2).alias("_kind"), F.lit(0).cast("long").alias("_ord"),
                         F.concat(F.lit("END LAUNDERING ATTEMPT - "), F.col("typology")).alias("value"))
    lines = recs.unionByName(heads).unionByName(ends)
    (lines.repartition(*keys).sortWithinPartitions(*keys, "_kind", "_ord")
     .select("value").write.mode("overwrite").text(path))
