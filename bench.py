"""Benchmark: the five pipeline stages and the headline queries on one scale.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value" (sum of stage seconds), "unit",
"queries" {name: seconds}, "sf", "rows", ...}.  Every timed step ends in a
write or a full action, so nothing is left lazy.

``rates`` holds rows per second of ingest and features on the same table ``BENCH_COPIES``
(default 20) times over, each copy with senders, receivers and ids of its own: a size at
which fixed costs fade.

Before timing, the ingest and feature stages run once, untimed, on the
smallest fixture (``sf0.001`` next to ``BENCH_SF_DIR``).  This loads the
JVM classes and JIT-compiles the scan, join, window and aggregation paths first,
so the timings are closer to steady state.  Model fits are not warmed up; their
time is dominated by per-iteration jobs.  ``"warm_up_sec"`` in the output says
how long the warm-up took.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from txnwatch.plans import pipeline as pl  # noqa: E402
from txnwatch.plans import queries as q  # noqa: E402
from txnwatch.session import build_session, clear_work, work_dir  # noqa: E402
from txnwatch.sources import raw_files  # noqa: E402
from txnwatch.sources.fixture import load_txn  # noqa: E402

HEADLINE = ["velocity_alerts", "silver_features", "rule_breakdown", "rules_summary", "ranking_summary", "pr_curve",
            "precision_at_k", "rules_vs_model", "training_sample", "split_counts", "ingest_roundtrip"]


def timed(fn):
    t0 = time.time()
    out = fn()
    return out, round(time.time() - t0, 3)


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    times: dict[str, float] = {}
    _, warm = timed(lambda: warm_up(spark, sf_dir))

    # raw files for the ingest stage (prepared, not timed: the published job starts from files)
    txn = load_txn(spark, sf_dir)
    base = work_dir(spark, "bench")
    raw_files.write_transactions_csv(txn, base + "/transactions_csv")
    raw_files.write_pattern_blocks(txn, base + "/patterns_txt")
    rows = txn.count()

    cfg = pl.PipelineConfig(out_dir=base + "/tables", features=q.FIXTURE_SPEC)
    ing, times["stage_ingest"] = timed(lambda: _ingest(spark, cfg, base))
    _, times["stage_features"] = timed(lambda: _features(spark, cfg, sf_dir))
    _, times["stage_train"] = timed(lambda: pl.run_train(spark, cfg))
    _, times["stage_explain"] = timed(lambda: _explain(spark, cfg))
    _, times["stage_rule_baseline"] = timed(lambda: _rules(spark, cfg))
    stage_total = round(sum(v for k, v in times.items() if k.startswith("stage_")), 3)

    for name in HEADLINE:
        _, times[name] = timed(lambda: consume(q.QUERIES[name](spark, sf_dir)))

    rates = scaled_rates(spark, sf_dir, int(os.environ.get("BENCH_COPIES", "20")))
    print(json.dumps({"metric": "pipeline_seconds", "value": stage_total, "unit": "sec", "queries": times,
                      "sf": sf, "rows": rows, "rows_per_sec_features": round(rows / times["stage_features"], 1),
                      "rates": rates, "cpus": cpus, "warm_up_sec": warm}))
    clear_work(spark)


def scaled_rates(spark, sf_dir, copies):
    """Rows per second of the ingest and feature stages on ``copies`` copies of the table."""
    base = work_dir(spark, "bench-scaled")
    txn = load_txn(spark, sf_dir).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for c in ("txn_id", "from_account", "to_account"):
        txn = txn.withColumn(c, F.col(c) * copies + F.col("_copy"))
    txn.drop("_copy").write.parquet(base + "/bronze")
    bronze = spark.read.parquet(base + "/bronze")
    raw_files.write_transactions_csv(bronze, base + "/csv")
    raw_files.write_pattern_blocks(bronze, base + "/patterns")
    n = bronze.count()
    cfg = pl.PipelineConfig(out_dir=base + "/tables", features=q.FIXTURE_SPEC)
    _, ingest = timed(lambda: _ingest(spark, cfg, base, "/csv", "/patterns"))
    _, feats = timed(lambda: pl.run_features(spark, cfg, bronze=bronze)["reconcile"].collect())
    return {"rows": n, "ingest_rows_per_sec": round(n / ingest), "features_rows_per_sec": round(n / feats)}


def warm_up(spark, sf_dir):
    """The ingest and feature stages once on the smallest fixture, untimed."""
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(small) or os.path.abspath(small) == os.path.abspath(sf_dir):
        return
    txn = load_txn(spark, small)
    base = work_dir(spark, "bench-warm")
    raw_files.write_transactions_csv(txn, base + "/transactions_csv")
    raw_files.write_pattern_blocks(txn, base + "/patterns_txt")
    cfg = pl.PipelineConfig(out_dir=base + "/tables", features=q.FIXTURE_SPEC)
    _ingest(spark, cfg, base)
    _features(spark, cfg, small)


def _ingest(spark, cfg, base, csv="/transactions_csv", patterns="/patterns_txt"):
    out = pl.run_ingest(spark, cfg, base + csv, base + patterns)
    out["profile"].collect()
    out["typologies"].collect()
    return out


def _features(spark, cfg, sf_dir):
    # the stand-in's bronze keeps the driver's event ids and exact times
    out = pl.run_features(spark, cfg, bronze=load_txn(spark, sf_dir))
    out["reconcile"].collect()
    out["class_means"].collect()


def _explain(spark, cfg):
    out = pl.run_explain(spark, cfg)
    for k in ("curve", "tradeoff", "operating_point", "confusion", "baseline", "global_drivers", "case"):
        consume(out[k])


def _rules(spark, cfg):
    out = pl.run_rule_baseline(spark, cfg)
    for k in ("comparison", "fp_reduction", "breakdown"):
        out[k].collect()


if __name__ == "__main__":
    main()
