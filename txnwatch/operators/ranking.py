"""Ranking metrics, curves and thresholds over a scored table.

Input: any DataFrame with a 0/1 label, a score and id columns (ties in score are
ordered by the ids, everywhere).  Metrics that only need counts per distinct
score (average precision, ROC-AUC, the precision-recall curve, thresholds) are
computed on the per-score table with a distributed running sum; nothing is
collected, and no window runs without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.operators.prefix import global_rank, prefix_sums
from txnwatch.session import ensure_checkpoint_dir


def score_order(score: str, ids: list[str]) -> list[Column]:
    """Highest score first, ties by ascending id: the single order used everywhere."""
    return [F.desc(score)] + [F.asc(i) for i in ids]


def score_table(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """One row per distinct score: ``score, pos, neg`` and inclusive running
    ``cum_pos, cum_neg`` from the highest score down, plus the class totals."""
    by_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    cum = prefix_sums(by_score, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
                      totals=True)
    # class totals come with the (broadcast) chunk-offset table: no extra pass
    return cum.withColumnRenamed("total_cum_pos", "P").withColumnRenamed("total_cum_neg", "N")


def stored_scores(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """``score_table`` kept in the checkpoint folder: every metric of a scored set can read it."""
    ensure_checkpoint_dir(scored.sparkSession)
    return score_table(scored, label, score).checkpoint(eager=True)


def _curve_cols(t: DataFrame) -> DataFrame:
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("P"))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.select("*", precision.alias("precision"), recall.alias("recall"))


def ranking_summary(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """One row: ``positives, negatives, auprc, roc_auc``.

    ``auprc`` is step-wise average precision, sum over distinct scores of
    (recall gain) x precision; 0 when there is no positive.  ``roc_auc`` counts
    tied pairs as half; null when a class is missing.
    """
    return summary_of(score_table(scored, label, score))


def summary_of(table: DataFrame) -> DataFrame:
    """``ranking_summary`` from a score table."""
    t = _curve_cols(table)
    ap_term = F.when(F.col("P") > 0, F.col("pos") / F.col("P") * F.col("precision")).otherwise(F.lit(0.0))
    # doubles: the products of class totals pass the bigint range at scale
    auc_term = F.col("pos").cast("double") * (F.col("N") - F.col("cum_neg") + F.col("neg") / 2.0)
    return t.agg(
        F.coalesce(F.max("P"), F.lit(0)).alias("positives"),
        F.coalesce(F.max("N"), F.lit(0)).alias("negatives"),
        F.sum(ap_term).alias("auprc"),
        F.when((F.max("P") > 0) & (F.max("N") > 0),
               F.sum(auc_term) / F.max("P").cast("double") / F.max("N").cast("double")).alias("roc_auc"))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "prob", end_point: bool = True) -> DataFrame:
    """``threshold, precision, recall`` per distinct score; with ``end_point`` the
    closing point (precision 1, recall 0, no threshold) is appended."""
    return curve_of(score_table(scored, label, score), end_point)


def curve_of(table: DataFrame, end_point: bool = True) -> DataFrame:
    """``pr_curve`` from a score table."""
    t = _curve_cols(table)
    curve = t.select(F.col("score").alias("threshold"), "precision", "recall")
    if end_point:
        end = t.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(None).cast(curve.schema["threshold"].dataType).alias("threshold"),
                                F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
        curve = curve.unionByName(end)
    return curve


def threshold_for_recall(scored: DataFrame, target: float, label: str = "label", score: str = "prob",
                         default: float = 0.5) -> DataFrame:
    """One row ``threshold``: where the ranking first catches the share ``target`` of the
    positives, reading scores from the top; ``default`` when it never does."""
    return threshold_of(curve_of(score_table(scored, label, score), end_point=False), target, default)


def threshold_of(curve: DataFrame, target: float, default: float = 0.5) -> DataFrame:
    """``threshold_for_recall`` from a curve; points without a threshold do not count."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("recall") >= target, F.col("threshold"))).cast("double"),
                            F.lit(default)).alias("threshold"))


def operating_point(scored: DataFrame, threshold: float, label: str = "label", score: str = "prob") -> DataFrame:
    """The first curve point at or above ``threshold`` (lowest such score); the
    end point (precision 1, recall 0) when every score is below it."""
    return point_of(pr_curve(scored, label, score, end_point=False), threshold)


def point_of(curve: DataFrame, threshold: float) -> DataFrame:
    """``operating_point`` from a curve."""
    first = curve.where(F.col("threshold") >= threshold).agg(F.min_by(F.struct("threshold", "precision", "recall"), F.col("threshold")).alias("p"))
    return first.select(F.col("p.threshold").alias("threshold"),
                        F.coalesce(F.col("p.precision"), F.lit(1.0)).alias("precision"),
                        F.coalesce(F.col("p.recall"), F.lit(0.0)).alias("recall"))


def confusion(scored: DataFrame, threshold: float, label: str = "label", score: str = "prob") -> DataFrame:
    """One row ``tn, fp, fn, tp`` for the alert flag ``score >= threshold``."""
    alert = F.col(score) >= F.lit(threshold)
    pos = F.col(label) == 1
    return scored.agg(F.count_if(~alert & ~pos).alias("tn"), F.count_if(alert & ~pos).alias("fp"),
                      F.count_if(~alert & pos).alias("fn"), F.count_if(alert & pos).alias("tp"))


def threshold_metrics(scored: DataFrame, threshold: float, label: str = "label", score: str = "prob") -> DataFrame:
    """One row: confusion counts plus precision and recall (0 when undefined)."""
    return rates_of(confusion(scored, threshold, label, score))


def rates_of(counts: DataFrame) -> DataFrame:
    """Confusion counts with ``alerts, precision, recall``."""
    return counts.select("*", (F.col("tp") + F.col("fp")).alias("alerts"),
                    F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
                    .otherwise(0.0).alias("precision"),
                    F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
                    .otherwise(0.0).alias("recall"))


def baseline(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Random baseline (positive rate) and the lift of average precision over it."""
    return baseline_of(score_table(scored, label, score))


def baseline_of(table: DataFrame) -> DataFrame:
    """``baseline`` from a score table."""
    s = summary_of(table)
    rate = F.col("positives") / (F.col("positives") + F.col("negatives"))
    return s.select(rate.alias("positive_rate"), "auprc",
                    F.when(rate > 0, F.col("auprc") / rate).alias("lift"))


def top_alerts(scored: DataFrame, k: int, ids: list[str], score: str = "prob") -> DataFrame:
    """The ``k`` highest-scored rows (a top-k report: the limit is the feature)."""
    return scored.orderBy(*score_order(score, ids)).limit(k)


def top_case(scored: DataFrame, ids: list[str], label: str = "label", score: str = "prob") -> DataFrame:
    """The highest-scored positive."""
    return top_alerts(scored.where(F.col(label) == 1), 1, ids, score)


def confusion_of(table: DataFrame, threshold: float) -> DataFrame:
    """``tn, fp, fn, tp`` of the flag ``score >= threshold`` from a score table."""
    alert = F.col("score") >= F.lit(threshold)

    def total(which, when):
        return F.coalesce(F.sum(F.when(when, F.col(which))), F.lit(0)).cast("long")

    return table.agg(total("neg", ~alert).alias("tn"), total("neg", alert).alias("fp"),
                     total("pos", ~alert).alias("fn"), total("pos", alert).alias("tp"))


def precision_at_k(scored: DataFrame, ks, ids: list[str], label: str = "label", score: str = "prob") -> DataFrame:
    """``k, precision_at_k`` rows: positive share of the top ``k``; null when fewer than ``k`` rows.

    One top-``max(ks)`` pass (each task keeps at most that many rows) serves
    every ``k``; the positions inside that bounded set come from a window over
    at most ``max(ks)`` rows.
    """
    ks = [int(k) for k in ks]
    n = scored.agg(F.count(F.lit(1))).scalar()
    top = top_alerts(scored.select(*ids, label, score), max(ks), ids, score)
    pos = top.withColumn("_r", F.row_number().over(Window.orderBy(*score_order(score, ids))))
    y = F.col(label).cast("double")
    wide = pos.agg(*[F.avg(F.when(F.col("_r") <= k, y)).alias(f"_p{j}") for j, k in enumerate(ks)])
    pairs = ", ".join(f"{k}, _p{j}" for j, k in enumerate(ks))
    allk = wide.selectExpr(f"stack({len(ks)}, {pairs}) as (k, p)")
    return allk.select("k", F.when(F.lit(n) >= F.col("k"), F.col("p")).alias("precision_at_k"))


def equal_recall_alerts(scored: DataFrame, k_tp: DataFrame, ids: list[str], label: str = "label",
                        score: str = "prob") -> DataFrame:
    """Flag the shortest score-ordered prefix holding ``k`` true positives.

    ``k_tp`` is a one-row DataFrame with column ``k`` (e.g. the rules' true
    positives).  The prefix ends at the k-th positive, so its length is the
    number of rows ordered at or before that positive; with ``k = 0`` nothing is
    flagged.  Returns ``scored`` plus an int column ``matched``.
    """
    pos = scored.where(F.col(label) == 1).select(*ids, score)
    ranked = global_rank(pos, score_order(score, ids), "_pos_rank")
    # the k-th positive: one bounded row, fetched once and used as literals
    piv = ranked.where(F.col("_pos_rank") == k_tp.select("k").scalar()).select(score, *ids).first()
    if piv is None:
        return scored.withColumn("matched", F.lit(0))
    p_score, p_ids = F.lit(piv[score]), [F.lit(piv[i]) for i in ids]
    # lexicographic "at or before the pivot" in (score desc, ids asc)
    before = F.col(score) > p_score
    for j, i in enumerate(ids):
        cond = F.col(score) == p_score
        for prev, p_prev in zip(ids[:j], p_ids[:j]):
            cond = cond & (F.col(prev) == p_prev)
        last = j == len(ids) - 1
        before = before | (cond & ((F.col(i) <= p_ids[j]) if last else (F.col(i) < p_ids[j])))
    return scored.select("*", F.coalesce(before, F.lit(False)).cast("int").alias("matched"))
