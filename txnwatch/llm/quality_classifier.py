"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes ``FEATURES``: shares and lengths on log scales.  Each class has a
mean and a covariance, shrunk in two steps: towards the pooled covariance
(``to_pooled``) and towards a round one of the same size (``to_round``).  A text's
score is the posterior of class 1 from the difference of the two Gaussian
log-densities; their Mahalanobis terms use the Cholesky factors, computed once per
model and sent to the tasks.

Training moments are sums over all labelled rows given (one small row a task).  A
doc_id labelled twice counts once, with its lowest label; other labels than 0 and 1
and null ids do not train.  With one class only, every score is that class's share;
with no labels, 0.5.  Null text is empty, which has statistics like any other.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import id_back, id_text, python_ready, table, written
from txnwatch.llm.language_id import fold
from txnwatch.llm.quality_rules import WORD_LIST

FEATURES = ["chars", "words", "word_length", "distinct", "pairs", "common", "upper", "digits", "marks", "symbols",
            "bars", "shouts", "beyond", "line_length", "dup_lines", "stutter", "capitals"]
TO_POOLED, TO_ROUND = 0.15, 0.05
THRESHOLD = 0.7
_COMMON = frozenset(WORD_LIST)


def _bytes(chars: str) -> list[int]:
    return [ord(c) for c in chars]


def statistics(text: str | None) -> list[float]:
    """The raw statistics of a text; shares are 0 where there is nothing to share."""
    t = text or ""
    words = t.split()
    lines = [x for x in t.split("\n") if x.strip()]
    h = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars, n = len(t), len(words)
    c, w, m = max(chars, 1), max(n, 1), max(len(lines), 1)
    return [chars, n, sum(map(len, words)) / w, len(set(words)) / w, len(set(zip(words, words[1:]))) / max(n - 1, 1),
            sum(map(_COMMON.__contains__, words)) / w, h[65:91].sum() / c, h[48:58].sum() / c, h[_bytes(".,;:'\"()-?")].sum() / c,
            h[_bytes("#*$%&<>@^~_=+\\/{}[]`")].sum() / c, h[124] / c, h[33] / c, h[0xC0:].sum() / c, chars / m,
            1 - len(set(lines)) / m if lines else 0.0, sum(a == b for a, b in zip(words, words[1:])) / w,
            sum(x[0].isupper() for x in words) / w]


def transform(raw: np.ndarray) -> np.ndarray:
    """Lengths as log(1 + x), shares as log(x + 0.002)."""
    out = raw.astype(float).reshape(-1, len(FEATURES)).copy()
    lengths = [FEATURES.index(f) for f in ("chars", "words", "word_length", "line_length")]
    shares = [i for i in range(len(FEATURES)) if i not in lengths]
    out[:, lengths] = np.log1p(out[:, lengths])
    out[:, shares] = np.log(out[:, shares] + 0.002)
    return out


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = transform(np.array([statistics(t) for t in b["text"]], float))
        yield b.drop(columns="text").assign(x=list(x))


def features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (the transformed statistics) of every row."""
    python_ready(df.sparkSession)
    rows = df.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return id_back(rows.mapInPandas(_featured, "doc_id string, x array<double>"), "doc_id")


@dataclass
class Discriminant:
    prior: np.ndarray             # share of class 0 and 1 in training
    mean: np.ndarray              # [2, d]
    factors: list                 # inverse Cholesky factor of each class
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if not self.factors:
            return np.full(len(x), self.prior[1])
        density = [-0.5 * (((x - self.mean[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] + np.log(self.prior[k])
                   for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for b in batches:
        if not len(b):
            continue
        x, y = np.stack(b["x"].to_numpy()), b["label"].to_numpy()
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pd.DataFrame({"label": [0, 1], "m": list(sums)})


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_round: float = TO_ROUND) -> Discriminant:
    """From rows (x, label)."""
    d = len(FEATURES)
    parts = rows.select("x", F.col("label").cast("int").alias("label")).mapInPandas(_moments, "label int, m array<double>")
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        total[r["label"], r["k"]] = r["v"]              # 2 x (1 + d + d * d) numbers
    n = total[:, 0]
    if not n.all():
        return Discriminant(np.array([0.5, 0.5]) if not n.any() else n / n.sum(), np.zeros((2, d)), [], np.zeros(2))
    mean = total[:, 1:1 + d] / n[:, None]
    scatter = [total[k, 1 + d:].reshape(d, d) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))                # features on one scale before rounding
    factors, log_det = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
        cov = cov / np.outer(spread, spread)
        cov = (1 - to_round) * cov + to_round * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low) / spread)
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(n / n.sum(), mean, factors, np.array(log_det))


def _scored(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, len(FEATURES)))
        yield b.drop(columns="x").assign(score=shared.value.score(x))


def classify(df: DataFrame, labels: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = THRESHOLD, **shrink) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``df``; rows where ``held_out``
    (a function of the id column) is true do not train."""
    stored = written(features(df, doc_id, text), "quality-features")
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).alias("label"))
    own = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(stored.where(~own).join(known, "doc_id"), **shrink)
    shared = df.sparkSession.sparkContext.broadcast(model)              # a few hundred numbers
    out = stored.select(id_text("doc_id").alias("doc_id"), own.alias("held_out"), "x").mapInPandas(
        lambda it: _scored(it, shared), "doc_id string, held_out boolean, score double")
    return id_back(out, "doc_id").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: fold(i, 4) == 2)
