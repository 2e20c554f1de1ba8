"""Fetch columns of a large table for the rows of a smaller one.

``small LEFT JOIN large USING (key)`` cannot broadcast the small side.  The large
table is therefore first cut to the small table's keys with a semi join (the planner
broadcasts the keys when their size allows and otherwise can filter the large side
with a runtime Bloom filter before its shuffle), then reduced to one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_by_key(target: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``target`` plus ``cols`` of ``source`` by ``key`` (left join semantics: rows without
    a match, or with a null key, get nulls).  A key that ``source`` repeats gives its
    smallest row (columns compared in the order of ``cols``), so no row is multiplied."""
    ids = target.select(key).where(F.col(key).isNotNull()).distinct()
    cut = source.select(key, *cols).join(ids, on=key, how="left_semi")
    single = cut.groupBy(key).agg(F.min(F.struct(*cols)).alias("_s")).select(key, *[F.col("_s")[c].alias(c) for c in cols])
    return target.join(single, on=key, how="left")
