"""Seeded, partition-independent sampling and splitting.

Every random choice is a keyed MD5 hash of ``'<seed>:<id>'`` instead of
``rand(seed)``, so a rerun, a lost executor or a different partitioning gives
the same rows.  "The N smallest hashes" is exact and never funnels rows into one
task: a cut on the (uniform) hash keeps slightly more than N candidates, which
are checkpointed and then ranked with the distributed prefix sum (two passes
over the input: a count and the cut).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.expr import keyed_hash
from txnwatch.operators.prefix import global_rank
from txnwatch.session import ensure_checkpoint_dir

_HASH_SPACE = float(2 ** 32)


def _cut_fraction(n: int, total: int) -> float:
    """Share of the (uniform) hash space that holds at least ``n`` of ``total``
    rows with near certainty: ``n/total`` plus 8 binomial deviations."""
    frac = n / total
    return min(1.0, frac + 8.0 * math.sqrt(frac * (1 - frac) / total) + 1.0 / total)


def _candidates(h: DataFrame, pick: Column, n: int, total: int, always: Column | None = None) -> DataFrame:
    """Rows of ``h`` with ``pick`` and a hash under the cut (at least ``n`` of
    them, flagged ``_cand``), plus every row with ``always``, written once to
    the checkpoint folder: the counts and ranks that follow read that copy
    instead of computing the input again."""
    frac = _cut_fraction(n, total)
    while True:
        under = pick & (F.col("_h") < F.lit(frac * _HASH_SPACE))
        cond = under if always is None else (under | always)
        cand = h.where(cond).withColumn("_cand", under).checkpoint(eager=True)
        if cand.where(F.col("_cand")).count() >= n or frac >= 1.0:
            return cand
        frac = min(1.0, frac * 2)


def _keep_smallest(cand: DataFrame, n: int, key: str) -> DataFrame:
    ranked = global_rank(cand, [F.asc("_h"), F.asc(key)], "_hrank")
    return ranked.where(F.col("_hrank") <= n).drop("_h", "_hrank", "_cand")


def smallest_by_hash(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest ``keyed_hash(key, seed)``
    (ties by ``key``).  Returns the input columns."""
    total = df.count()
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    ensure_checkpoint_dir(df.sparkSession)
    h = df.withColumn("_h", keyed_hash(key, seed))
    return _keep_smallest(_candidates(h, F.lit(True), n, total), n, key)


def class_capped_sample(silver: DataFrame, n_negatives: int, seed: int, key: str = "txn_id",
                        label: str = "label") -> DataFrame:
    """Every positive plus exactly ``n_negatives`` negatives chosen by keyed hash
    (rows with a null label are in neither class).

    The input is read twice: a count of the negatives (label column only) and
    one pass that writes the positives and the negative candidates to a single
    checkpoint, so computed inputs (feature windows) run once.
    """
    y = F.col(label)
    n_neg = silver.where(y == 0).count()
    if n_negatives >= n_neg:
        return silver.where((y == 1) | (y == 0))
    if n_negatives <= 0:
        return silver.where(y == 1)
    ensure_checkpoint_dir(silver.sparkSession)
    h = silver.withColumn("_h", keyed_hash(key, seed))
    cand = _candidates(h, y == 0, n_negatives, n_neg, always=(y == 1))
    pos = cand.where(y == 1).drop("_h", "_cand")
    neg = _keep_smallest(cand.where(F.col("_cand")), n_negatives, key)
    return pos.unionByName(neg)


def stratified_split(df: DataFrame, seed: int, key: str = "txn_id", label: str = "label",
                     fractions=(0.6, 0.2), name: str = "split") -> DataFrame:
    """Exact per-class split: within each class rows are ordered by keyed hash and
    the first ``floor(0.6 n_c)`` go to train, up to ``floor(0.8 n_c)`` to val,
    the rest to test."""
    a = fractions[0]
    b = fractions[0] + fractions[1]
    h = df.withColumn("_h", keyed_hash(key, seed))
    out = global_rank(h, [F.asc("_h"), F.asc(key)], "_r", groups=[label], size_name="_n")
    part = (F.when(F.col("_r") <= F.floor(F.lit(a) * F.col("_n")), "train")
            .when(F.col("_r") <= F.floor(F.lit(b) * F.col("_n")), "val").otherwise("test"))
    return out.withColumn(name, part).drop("_h", "_r", "_n")


def hash_split(df: DataFrame, seed: int, key: str = "txn_id", fractions=(0.6, 0.2),
               name: str = "split") -> DataFrame:
    """Shuffle-free approximate split: bucket of the keyed hash, cut at 0.6 / 0.8."""
    a = fractions[0]
    b = fractions[0] + fractions[1]
    u = keyed_hash(key, seed) / F.lit(_HASH_SPACE)
    return df.withColumn(name, F.when(u < a, "train").when(u < b, "val").otherwise("test"))


def uniform_sample(df: DataFrame, k: int, seed: int, key: str = "txn_id") -> DataFrame:
    """At most ``k`` rows by smallest keyed hash (a fixed-size sample: the limit is the feature)."""
    return (df.withColumn("_h", keyed_hash(key, seed)).orderBy("_h", key).limit(k).drop("_h"))
