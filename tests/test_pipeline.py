"""End to end: raw files -> bronze -> silver -> gold -> explanations -> rules
(SURVEY §7.3 step 9), on the smallest fixture with small models."""

from pyspark.sql import functions as F

from txnwatch.operators import models as mo
from txnwatch.plans import pipeline as pl
from txnwatch.plans.queries import FIXTURE_SPEC
from txnwatch.session import work_dir
from txnwatch.sources import raw_files
from txnwatch.sources.fixture import load_txn

SF = "/root/testdata/sf0.001"


def test_run_all_from_raw_files(spark):
    txn = load_txn(spark, SF)
    base = work_dir(spark, "e2e")
    raw_files.write_transactions_csv(txn, base + "/csv")
    raw_files.write_pattern_blocks(txn, base + "/patterns")
    specs = mo.default_specs(scale=0.02)
    specs[0].params["maxIter"] = 50
    cfg = pl.PipelineConfig(out_dir=base + "/tables", features=FIXTURE_SPEC, model_specs=specs)
    out = pl.run_all(spark, cfg, base + "/csv", base + "/patterns")

    p = out["ingest"]["profile"].first()
    assert (p["rows"], p["positives"], p["null_timestamps"], p["rows_with_typology"]) == (1000, 28, 0, 17)
    assert out["features"]["reconcile"].first()["rows_match"]

    bench = pl.read(spark, cfg, "gold", "benchmark_results")
    assert bench.count() == 5
    champ = pl.read(spark, cfg, "gold", "champion").first()
    assert champ["model"] == bench.orderBy(F.desc("val_auprc"), "model").first()["model"]
    test = pl.read(spark, cfg, "gold", "test_predictions")
    n_test = test.count()
    assert n_test > 0 and test.where(F.col("prob").isNull()).count() == 0

    codes = out["explain"]["reason_codes"]
    assert codes.count() == min(cfg.top_alerts, n_test)
    assert codes.where(F.col("reason_1_shap") < F.col("reason_2_shap")).count() == 0

    comp = out["rules"]["comparison"].collect()
    assert len(comp) == 3
    for r in comp:
        assert r["true_positives"] + r["false_positives"] == r["alerts"]
    # the equal-recall row holds exactly as many true positives as the rules
    assert comp[2]["true_positives"] == comp[0]["true_positives"]
    assert out["rules"]["fp_reduction"].count() == 1
    assert out["rules"]["breakdown"].count() == 4

    # the run log keeps every benchmark: a repeat adds nothing, other settings add theirs
    logged = pl.read_runs(spark, cfg)
    n, ids = logged.count(), {r.benchmark_id for r in logged.select("benchmark_id").distinct().collect()}
    pl.run_train(spark, cfg)
    assert pl.read_runs(spark, cfg).count() == n
    cfg.model_specs = specs[:2]
    pl.run_train(spark, cfg)
    now = {r.benchmark_id for r in pl.read_runs(spark, cfg).select("benchmark_id").distinct().collect()}
    assert ids < now and len(now) == 2 and pl.read(spark, cfg, "gold", "benchmark_results").count() == 2
