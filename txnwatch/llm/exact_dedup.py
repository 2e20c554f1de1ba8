"""Exact deduplication by skew-safe combining [DataFrame functions only].

Texts are equal when identical after every run of blanks became one space (null
is the empty text).  Equal texts meet in two rounds, both keyed on digest *and*
full text, so two texts that share a digest are never merged:

1. each input task combines its own copies (map-side), then the copies of all
   tasks that share a salt meet on (digest, salt, text);
2. the salt winners, at most ``salts`` per text, meet on (digest, text).

The salt is the input task's number modulo ``salts``: a text held by a third of
all rows leaves each task as one row and is merged by ``salts`` tasks at once.

The answer goes back to the rows as (digest, id), without their text: on the
digest alone where the second round found one text for it, and on digest and
full text for the rows of a digest that has several.

Of equal texts the row with the smallest id stays, a null id counting as the
largest; of repeated rows with the same id one stays, the one whose place in its file
has the least hash, whatever the number of executors.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import BLANK_RUN, free_name, stored_rows, table, with_row_id, written

SALTS = 16
_MAX = (1 << 63) - 1
_UNIT = f"cast('{1 << 63}' as decimal(19,0))"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest=sha256) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256,
    and ``_row``, the row's key (``with_row_id`` of ``stored_rows``)."""
    rows = with_row_id(stored_rows(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")))
    rows = rows.select("doc_id", "_row", normalised(F.col("_text")).alias("_norm"))
    rows = rows.select("*", digest(F.col("_norm")).alias("_digest"))
    # (id, hash of the row's key) as one exact number: it orders as the pair and suits a hash aggregate
    first = F.expr(f"cast(coalesce(doc_id, {_MAX}) as decimal(19,0)) * {_UNIT} + (xxhash64(_row) & {_MAX})")
    combine = (F.min("_first").alias("_first"), F.sum("_n").alias("_n"))

    salted = rows.select("_digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), "_norm",
                         first.alias("_first"), F.lit(1).cast("long").alias("_n"))
    winners = salted.groupBy("_digest", "_salt", "_norm").agg(*combine)
    groups = written(winners.groupBy("_digest", "_norm").agg(*combine).drop("_norm"), "exact-groups")
    by_digest = groups.groupBy("_digest").agg(*combine, F.count(F.lit(1)).alias("_texts"))
    by_digest = written(by_digest, "exact-digests")      # a plain side, so that the join can split a hot digest

    out = rows.drop("_norm").join(by_digest.where("_texts = 1").drop("_texts"), "_digest")
    shared = by_digest.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        told = rows.join(shared, "_digest", "left_semi")
        by_text = told.select("_digest", "_norm", first.alias("_first"), F.lit(1).cast("long").alias("_n")) \
            .groupBy("_digest", "_norm").agg(*combine)
        out = out.unionByName(told.join(by_text, ["_digest", "_norm"]).drop("_norm"))
    keep_id = F.expr(f"cast((_first - pmod(_first, {_UNIT})) / {_UNIT} as long)")
    keep_id = F.when(keep_id == _MAX, F.when(F.col("doc_id") == _MAX, F.col("doc_id"))).otherwise(keep_id)
    return out.select("doc_id", keep_id.alias("keep_id"), F.col("_n").alias("group_size"),
                      (F.col("_first") == first).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"), "_row")


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``df`` with one row of each group of equal texts, all its columns unchanged."""
    df = stored_rows(df)
    row = free_name(df, "_row")
    kept = exact_groups(df, doc_id, text, salts).where("kept").select(F.col("_row").alias(row))
    return with_row_id(df, row).join(kept, row, "left_semi").drop(row)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_row")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
