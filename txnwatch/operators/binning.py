"""One binned matrix for all histogram learners: every feature as a byte.

Cut points are quantiles of a bounded sample of rows (``sample`` rows by a hash of the
key, so the same rows whatever the partitioning).  A value's bin is the number of cut
points below it: ``x <= cuts[b]`` exactly where its bin is at most ``b``.  The matrix
is stored once as (key, label, bins); every fit reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.session import ship_package, work_dir

MAX_BINS = 256
SAMPLE = 65_536          # rows that the cut points are taken from


def filled(f: str):
    """A feature as the models see it: double, null as 0."""
    return F.coalesce(F.col(f).cast("double"), F.lit(0.0))


def quantile_cuts(values: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """At most ``max_bins - 1`` increasing cut points: all distinct values but the largest, or quantiles."""
    distinct = np.unique(values[~np.isnan(values)])
    if len(distinct) > max_bins:
        at = np.quantile(values[~np.isnan(values)], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower")
        distinct = np.append(np.unique(at), distinct[-1])
    return np.unique(distinct)[:-1]


def fit_cuts(train: DataFrame, features: list[str], key: str, max_bins: int = MAX_BINS, sample: int = SAMPLE) -> list[np.ndarray]:
    """Cut points of every feature."""
    few = train.select(*[filled(f).alias(f"x{i}") for i, f in enumerate(features)], F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    rows = few.orderBy("h", "k").limit(sample).drop("h", "k").toPandas().to_numpy(float).reshape(-1, len(features))
    return [quantile_cuts(rows[:, i], max_bins) for i in range(len(features))]


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of raw values (rows x features); NaN lies above all cut points."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8) if cuts else np.zeros((0, len(x)), np.uint8)


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], kept: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.stack([b.column(kept + i).to_numpy(zero_copy_only=False) for i in range(len(cuts))], axis=1)
        data = np.ascontiguousarray(bins_of(x, cuts).T)
        offsets = pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32())
        column = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), column], [*b.schema.names[:kept], "bins"])


def binned_matrix(df: DataFrame, features: list[str], cuts: list[np.ndarray], key: str, label: str = "label") -> DataFrame:
    """The stored matrix: key (long hash of the id), label (int) and bins (one byte a feature)."""
    ship_package(df.sparkSession)
    rows = df.select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(label).cast("int").alias("label"),
                     *[filled(f).alias(f"x{i}") for i, f in enumerate(features)])
    path = work_dir(df.sparkSession, "binned")
    rows.mapInArrow(lambda it: _binned(it, cuts, 2), "key long, label int, bins binary").write.parquet(path)
    return df.sparkSession.read.parquet(path)
