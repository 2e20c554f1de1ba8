"""The end-to-end job: raw files -> bronze -> silver -> gold, then alert
explanations and the rule comparison.  Each stage is a plain function that
reads the previous stage's tables and overwrites its own (parquet under
``out_dir``), so stages can run as separate tasks of any scheduler and state
passes only through tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators import explain as ex
from txnwatch.operators import ingest, models, ranking, rules, sampling
from txnwatch.sources import tables
from txnwatch.operators.features import add_features, class_means, reconcile
from txnwatch.schema import (CHECK_FEATURES, JOIN_KEYS, N_NEGATIVES, SEED, TARGET_RECALL, TOP_ALERTS,
                             FeatureSpec)


@dataclass
class PipelineConfig:
    out_dir: str
    n_negatives: int = N_NEGATIVES
    target_recall: float = TARGET_RECALL
    include_interbank: bool = False
    seed: int = SEED
    features: FeatureSpec = field(default_factory=FeatureSpec)
    model_specs: list | None = None
    top_alerts: int = TOP_ALERTS
    explain_sample: int = 1000
    ids: tuple = ("txn_id",)
    join_keys: tuple = tuple(JOIN_KEYS)
    database: str | None = None      # set: also register managed tables <database>_<layer>.<name>


def table_path(cfg: PipelineConfig, layer: str, name: str) -> str:
    return f"{cfg.out_dir.rstrip('/')}/{layer}/{name}"


def write(df: DataFrame, cfg: PipelineConfig, layer: str, name: str) -> DataFrame:
    """Replace a table all at once (schema may change between runs) and return it re-read.

    Tables are parquet versions under ``out_dir/<layer>/<name>``; with ``database`` set
    they are also catalog tables in one namespace per layer (created if missing)."""
    table = None
    if cfg.database:
        df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {cfg.database}_{layer}")
        table = f"{cfg.database}_{layer}.{name}"
    return tables.replace(df, table_path(cfg, layer, name), table)


def read(spark: SparkSession, cfg: PipelineConfig, layer: str, name: str) -> DataFrame:
    return tables.read(spark, table_path(cfg, layer, name))


def read_runs(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """The log of all benchmark runs."""
    return spark.read.schema(models.RUN_SCHEMA).parquet(table_path(cfg, "gold", "runs"))


# --------------------------------------------------------------------------- 1: ingest
def run_ingest(spark: SparkSession, cfg: PipelineConfig, transactions_csv: str, patterns_txt: str) -> dict:
    trans = ingest.read_transactions(spark, transactions_csv)
    records = ingest.read_pattern_records(spark, patterns_txt)
    lookup = write(ingest.typology_lookup(records, list(cfg.join_keys)), cfg, "bronze", "laundering_typologies")
    bronze = write(ingest.attach_typology(trans, lookup, list(cfg.join_keys)), cfg, "bronze", "transactions")
    return {"profile": ingest.ingest_profile(bronze), "typologies": ingest.typology_counts(bronze),
            "patterns": ingest.pattern_counts(records, lookup)}


# --------------------------------------------------------------------------- 2: features
def run_features(spark: SparkSession, cfg: PipelineConfig, bronze: DataFrame | None = None) -> dict:
    bronze = bronze if bronze is not None else read(spark, cfg, "bronze", "transactions")
    silver = write(add_features(bronze, cfg.features), cfg, "silver", "features")
    return {"reconcile": reconcile(silver, bronze), "class_means": class_means(silver, CHECK_FEATURES)}


# --------------------------------------------------------------------------- 3: sample, split, train
def run_train(spark: SparkSession, cfg: PipelineConfig, silver: DataFrame | None = None) -> models.Benchmark:
    silver = silver if silver is not None else read(spark, cfg, "silver", "features")
    feats = cfg.features.model_features(cfg.include_interbank)
    key = cfg.ids[0]
    sample = sampling.class_capped_sample(silver, cfg.n_negatives, cfg.seed, key)
    # the bank flag stays on the sampled rows: the rule comparison need not look it up in silver
    kept = list(dict.fromkeys([*cfg.ids, "typology", "label", *feats, "is_interbank"]))
    gold = write(sample.select(*kept), cfg, "gold", "training_set")
    split = sampling.stratified_split(gold, cfg.seed + 1, key).persist()
    parts = {p: split.where(F.col("split") == p).drop("split") for p in ("train", "val", "test")}
    bench = models.run_benchmark(spark, parts["train"], parts["val"], parts["test"], feats, cfg.model_specs,
                                 cfg.target_recall, list(cfg.ids), ("typology", "is_interbank"))
    write(bench.results, cfg, "gold", "benchmark_results")
    write(bench.test_predictions, cfg, "gold", "test_predictions")
    write(bench.champion, cfg, "gold", "champion")
    tables.append_run(bench.runs, table_path(cfg, "gold", "runs"), "benchmark_id")
    write(bench.importance, cfg, "gold", "gain_importance")
    models.save_model(spark, bench.models[bench.champion_name], table_path(cfg, "gold", "champion_model"))
    split.unpersist()
    bench.release()
    return bench


# --------------------------------------------------------------------------- 4: explain
def run_explain(spark: SparkSession, cfg: PipelineConfig) -> dict:
    champ = read(spark, cfg, "gold", "champion").first()
    feats, thr = list(champ["features"]), float(champ["threshold"])
    model = models.load_model(spark, table_path(cfg, "gold", "champion_model"))
    test = read(spark, cfg, "gold", "test_predictions")
    ids = list(cfg.ids)
    keep = [*ids, "label", "typology", "prob"]
    background = sampling.uniform_sample(test, cfg.explain_sample, 42, ids[0])
    prepared = ex.explainer_for(spark, model, feats)
    sample_attr = ex.explain(background, model, feats, keep, background, prepared)
    top = ranking.top_alerts(test, cfg.top_alerts, ids)
    codes = ex.top_reasons(ex.explain(top, model, feats, keep, background, prepared), feats)
    codes = codes.select(*ids, "label", "typology", "prob",
                         *[c for r in range(1, 4) for c in (f"reason_{r}", f"reason_{r}_shap")])
    codes = write(codes, cfg, "gold", "alert_reason_codes")
    sample_attr = write(sample_attr, cfg, "gold", "sample_attributions")
    points = write(ex.attribution_points(sample_attr, background, feats, ids[0]), cfg, "gold", "attribution_points")
    top_row = ranking.top_case(test, ids)
    case_attr = ex.explain(top_row, model, feats, keep, background, prepared)
    values = ex.attribution_points(case_attr, top_row, feats, ids[0]).select("feature", "value")
    case = ex.case_breakdown(case_attr, feats).join(values, "feature").orderBy(F.desc(F.abs("contribution")), "feature")
    table = ranking.stored_scores(test)
    curve = write(ranking.curve_of(table), cfg, "gold", "pr_curve")
    tradeoff = curve.where(F.col("threshold").isNotNull())
    return {
        "curve": curve, "tradeoff": tradeoff, "operating_point": ranking.point_of(tradeoff, thr),
        "confusion": ranking.confusion_of(table, thr), "baseline": ranking.baseline_of(table),
        "global_drivers": ex.mean_abs(sample_attr, feats), "attribution_points": points, "case": case, "reason_codes": codes,
    }


# --------------------------------------------------------------------------- 5: rules vs model
def run_rule_baseline(spark: SparkSession, cfg: PipelineConfig) -> dict:
    champ = read(spark, cfg, "gold", "champion").first()
    test = read(spark, cfg, "gold", "test_predictions")      # carries the bank flag: silver is not read
    rule_set = rules.default_rules(cfg.features.cols)
    comp = rules.compare_with_model(test, rule_set, champ["model"], float(champ["threshold"]), list(cfg.ids))
    comp = write(comp, cfg, "gold", "rbs_comparison")
    return {"comparison": comp, "fp_reduction": rules.false_positive_reduction(comp),
            "breakdown": rules.rule_breakdown(test, rule_set)}


def run_all(spark: SparkSession, cfg: PipelineConfig, transactions_csv: str, patterns_txt: str) -> dict:
    out = {"ingest": run_ingest(spark, cfg, transactions_csv, patterns_txt)}
    out["features"] = run_features(spark, cfg)
    out["train"] = run_train(spark, cfg)
    out["explain"] = run_explain(spark, cfg)
    out["rules"] = run_rule_baseline(spark, cfg)
    return out
