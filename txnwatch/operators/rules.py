"""Named alert rules, their breakdown, and the comparison with a model.

A rule is a ``(name, Column)`` pair of a boolean predicate; a null predicate
counts as "did not fire".  Every table here is a single aggregation pass (the
per-rule breakdown is one ``agg`` unpivoted afterwards), so nothing is exploded
per row and nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.ranking import equal_recall_alerts
from txnwatch.schema import (INTERBANK_AMOUNT, LARGE_AMOUNT, ROUND_UNIT, VELOCITY_COUNT, TxnColumns)

# System names of the comparison table.
RULES_SYSTEM = "Rule-based system (4 rules)"
OWN_THRESHOLD_SYSTEM = "{model} @ threshold {threshold:.3f}"
SAME_RECALL_SYSTEM = "{model} @ same recall as rules"


def default_rules(cols: TxnColumns | None = None, interbank: str = "is_interbank") -> list[tuple[str, Column]]:
    """The four legacy rules (nominal thresholds on mixed currencies)."""
    c = cols or TxnColumns()
    amt = F.col(c.amount)
    return [
        ("large_amount", amt > LARGE_AMOUNT),
        ("high_velocity", F.col("sender_24h_count") > VELOCITY_COUNT),
        ("round_number", (amt % ROUND_UNIT) == 0),
        ("interbank_risk", (F.col(interbank) == 1) & (amt > INTERBANK_AMOUNT)),
    ]


def rule_flags(df: DataFrame, rules: list[tuple[str, Column]], any_name: str = "rbs_alert") -> DataFrame:
    """One int flag per rule plus the any-of flag."""
    flags = [F.coalesce(pred, F.lit(False)).cast("int").alias(name) for name, pred in rules]
    out = df.select("*", *flags)
    return out.withColumn(any_name, F.greatest(*[F.col(name) for name, _ in rules]))


def summarise(df: DataFrame, system: str | Column, pred: str, label: str = "label") -> DataFrame:
    """One row: ``system, alerts, true_positives, false_positives, recall,
    precision, alert_rate``; denominators are floored at 1."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    agg = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                 F.count_if(~p & y).alias("fn"), F.count(F.lit(1)).alias("n"))
    sys_col = system if isinstance(system, Column) else F.lit(system)
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return agg.select(
        sys_col.alias("system"), (tp + fp).alias("alerts"), tp.alias("true_positives"),
        fp.alias("false_positives"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        ((tp + fp) / n).alias("alert_rate"))


def rule_breakdown(df: DataFrame, rules: list[tuple[str, Column]], label: str = "label") -> DataFrame:
    """``rule, alerts, precision, recall`` per rule, rounded to 4 places.

    Precision is 0 for a rule that never fires; recall is null without positives.
    """
    y = F.col(label) == 1
    aggs = []
    for name, pred in rules:
        fired = F.coalesce(pred, F.lit(False))
        aggs += [F.count_if(fired).alias(f"{name}__a"), F.count_if(fired & y).alias(f"{name}__tp")]
    wide = df.agg(*aggs, F.count_if(y).alias("__pos"))
    stack = ", ".join(f"'{name}', `{name}__a`, `{name}__tp`" for name, _ in rules)
    long = wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, alerts, tp)", "__pos")
    return long.select(
        "rule", "alerts",
        F.round(F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(0.0), 4).alias("precision"),
        F.round(F.when(F.col("__pos") > 0, F.col("tp") / F.col("__pos")), 4).alias("recall"))


def summarise_many(df: DataFrame, systems: list[tuple[str, str]], label: str = "label") -> DataFrame:
    """``summarise`` for several alert columns in one pass: one aggregation,
    then one row per system (in the given order)."""
    y = F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, (_, pred) in enumerate(systems):
        p = F.col(pred) == 1
        aggs += [F.count_if(p & y).alias(f"__tp{i}"), F.count_if(p & ~y).alias(f"__fp{i}"),
                 F.count_if(~p & y).alias(f"__fn{i}")]
    wide = df.agg(*aggs)
    names = ", ".join(f"{i}, '{name.replace(chr(39), chr(39) * 2)}', __tp{i}, __fp{i}, __fn{i}"
                      for i, (name, _) in enumerate(systems))
    long = wide.selectExpr(f"stack({len(systems)}, {names}) as (ord, system, tp, fp, fn)", "__n as n")
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return long.orderBy("ord").select(
        "system", (tp + fp).alias("alerts"), tp.alias("true_positives"), fp.alias("false_positives"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        ((tp + fp) / n).alias("alert_rate"))


def compare_with_model(test: DataFrame, rules: list[tuple[str, Column]], model_name: str, threshold: float,
                       ids: list[str], label: str = "label", score: str = "prob") -> DataFrame:
    """Three rows: the rules, the model at its own threshold, and the model at
    the rules' recall (the shortest score-ordered prefix with as many true
    positives as the rules caught).  One pass over ``test`` for the counts."""
    flagged = rule_flags(test, rules).withColumn("_own", (F.col(score) >= F.lit(threshold)).cast("int"))
    k_tp = flagged.agg(F.count_if((F.col("rbs_alert") == 1) & (F.col(label) == 1)).alias("k"))
    matched = equal_recall_alerts(flagged, k_tp, ids, label, score)
    return summarise_many(matched, [(RULES_SYSTEM, "rbs_alert"),
                                    (OWN_THRESHOLD_SYSTEM.format(model=model_name, threshold=threshold), "_own"),
                                    (SAME_RECALL_SYSTEM.format(model=model_name), "matched")], label)


def false_positive_reduction(comparison: DataFrame) -> DataFrame:
    """``1 - fp(model at equal recall) / max(fp(rules), 1)`` from the comparison table."""
    fp_rules = F.max(F.when(F.col("system") == RULES_SYSTEM, F.col("false_positives")))
    fp_model = F.max(F.when(F.col("system").endswith("same recall as rules"), F.col("false_positives")))
    return comparison.agg((1 - fp_model / F.greatest(fp_rules, F.lit(1))).alias("fp_reduction"))
