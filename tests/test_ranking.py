import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnwatch.operators import ranking
from txnwatch.operators.prefix import global_rank, prefix_sums


def scored_df(spark, y, p):
    pdf = pd.DataFrame({"id": np.arange(len(y)), "label": np.asarray(y, dtype=int), "prob": np.asarray(p, float)})
    return spark.createDataFrame(pdf)


def ref_curve(y, p):
    """Reference maths: one point per distinct score, highest first."""
    y, p = np.asarray(y), np.asarray(p)
    P = y.sum()
    out = []
    for s in sorted(set(p), reverse=True):
        tp = y[p >= s].sum()
        fp = (1 - y[p >= s]).sum()
        out.append((s, tp / (tp + fp), 1.0 if P == 0 else tp / P))
    return out


def ref_ap(y, p):
    y = np.asarray(y)
    P = y.sum()
    if P == 0:
        return 0.0
    prev, ap = 0.0, 0.0
    for _, prec, rec in ref_curve(y, p):
        ap += (rec - prev) * prec
        prev = rec
    return ap


def ref_auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


CASES = {
    "random": (np.random.default_rng(0).integers(0, 2, 300), np.round(np.random.default_rng(1).random(300), 2)),
    "no_positives": (np.zeros(50, int), np.random.default_rng(2).random(50)),
    "all_positives": (np.ones(50, int), np.random.default_rng(3).random(50)),
    "all_equal": (np.random.default_rng(4).integers(0, 2, 40), np.full(40, 0.5)),
}


@pytest.mark.parametrize("case", list(CASES))
def test_summary_matches_reference_maths(spark, case):
    y, p = CASES[case]
    r = ranking.ranking_summary(scored_df(spark, y, p)).first()
    assert r["auprc"] == pytest.approx(ref_ap(y, p), abs=1e-12)
    auc = ref_auc(y, p)
    assert (r["roc_auc"] is None) if auc is None else r["roc_auc"] == pytest.approx(auc, abs=1e-12)


@pytest.mark.parametrize("case", list(CASES))
def test_curve_and_threshold(spark, case):
    y, p = CASES[case]
    df = scored_df(spark, y, p)
    got = sorted((r["threshold"], r["precision"], r["recall"]) for r in
                 ranking.pr_curve(df, end_point=False).collect())
    want = sorted(ref_curve(y, p))
    assert np.allclose(np.array(got), np.array(want))
    ends = ranking.pr_curve(df).where(F.col("threshold").isNull()).collect()
    assert [(e["precision"], e["recall"]) for e in ends] == [(1.0, 0.0)]
    thr = ranking.threshold_for_recall(df, 0.75).first()["threshold"]
    ok = [s for s, _, rec in want if rec >= 0.75]
    assert thr == (max(ok) if ok else 0.5)


def test_operating_point_and_confusion(spark):
    y, p = CASES["random"]
    df = scored_df(spark, y, p)
    op = ranking.operating_point(df, 0.5).first()
    curve = sorted(ref_curve(y, p))
    first = [c for c in curve if c[0] >= 0.5][0]
    assert (op["threshold"], op["precision"], op["recall"]) == pytest.approx(first)
    assert ranking.operating_point(df, 2.0).first()["recall"] == 0.0
    m = ranking.confusion(df, 0.5).first()
    pred = p >= 0.5
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()),
                                                    int((~pred & (y == 1)).sum()), int((~pred & (y == 0)).sum()))


def test_precision_at_k_and_fewer_rows(spark):
    y, p = CASES["random"]
    df = scored_df(spark, y, p)
    order = sorted(range(len(y)), key=lambda i: (-p[i], i))
    got = {r["k"]: r["precision_at_k"] for r in ranking.precision_at_k(df, (10, 100, 1000), ["id"]).collect()}
    assert got[10] == pytest.approx(np.mean([y[i] for i in order[:10]]))
    assert got[100] == pytest.approx(np.mean([y[i] for i in order[:100]]))
    assert got[1000] is None


@pytest.mark.parametrize("k", [0, 1, 17, 40])
def test_equal_recall_prefix(spark, k):
    y, p = CASES["random"]
    df = scored_df(spark, y, p)
    kdf = spark.createDataFrame([(k,)], "k long")
    flagged = ranking.equal_recall_alerts(df, kdf, ["id"]).where("matched = 1").select("id").toPandas()
    order = sorted(range(len(y)), key=lambda i: (-p[i], i))
    cum = np.cumsum([y[i] for i in order])
    n = 0 if k == 0 else int(np.searchsorted(cum, k) + 1)
    assert sorted(flagged.id) == sorted(order[:n])


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_prefix_sums_equal_window(spark, parts):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": np.arange(2000), "g": rng.integers(0, 3, 2000), "v": rng.integers(-5, 10, 2000)})
    df = spark.createDataFrame(pdf).repartition(parts)
    # explicit chunk counts: without one, AQE merges this small table into a single chunk
    got = prefix_sums(df, [F.desc("v"), F.asc("id")], {"cs": F.col("v")}, groups=["g"],
                      num_chunks=parts).toPandas()
    pdf = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    pdf["cs"] = pdf.groupby("g")["v"].cumsum()
    m = got.merge(pdf, on="id", suffixes=("", "_ref"))
    assert (m.cs == m.cs_ref).all() and len(m) == 2000
    r = global_rank(df, [F.asc("id")], "rk", num_chunks=parts).toPandas()
    assert (r.rk == r.id + 1).all()
    r = global_rank(df, [F.asc("id")], "rk").toPandas()
    assert (r.rk == r.id + 1).all()


def test_fixture_average_precision(spark):
    from txnwatch.sources.fixture import load_scored
    r = ranking.ranking_summary(load_scored(spark, "/root/testdata/sf0.01")).first()
    assert round(r["auprc"], 6) == 0.336683
    assert round(r["roc_auc"], 6) == 0.501679


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_grouped_offsets_broadcast_or_shuffled(spark, limit):
    """Many groups: the planner broadcasts the stored offset table or shuffles it; the sums
    and ranks are the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        _grouped_offsets(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _grouped_offsets(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": rng.integers(0, 200, 3000), "v": rng.integers(0, 9, 3000)})
    df = spark.createDataFrame(pdf).repartition(5)
    cs = prefix_sums(df, [F.asc("id")], {"cs": F.col("v")}, groups=["g"], totals=True, num_chunks=6)
    got = cs.toPandas()
    rk = global_rank(df, [F.asc("id")], "rk", groups=["g"], size_name="n", num_chunks=6).toPandas()
    ref = pdf.sort_values(["g", "id"])
    ref["cs"] = ref.groupby("g")["v"].cumsum()
    ref["rk"] = ref.groupby("g").cumcount() + 1
    ref["n"] = ref.groupby("g")["id"].transform("size")
    ref["total_cs"] = ref.groupby("g")["v"].transform("sum")
    m = got.merge(rk[["id", "rk", "n"]], on="id").merge(ref, on="id", suffixes=("", "_ref"))
    assert len(m) == 3000
    for c in ("cs", "rk", "n", "total_cs"):
        assert (m[c] == m[c + "_ref"]).all(), c


def test_class_totals_beyond_bigint_products(spark):
    """4e9 positives and negatives a score: products of the totals pass 2**63."""
    table = spark.createDataFrame([(0.9, 3 * 10**11, 10**11, 3 * 10**11, 10**11, 4 * 10**11, 4 * 10**11),
                                   (0.1, 10**11, 3 * 10**11, 4 * 10**11, 4 * 10**11, 4 * 10**11, 4 * 10**11)],
                                  "score double, pos long, neg long, cum_pos long, cum_neg long, P long, N long")
    r = ranking.summary_of(table).first()
    assert r["roc_auc"] == pytest.approx(0.75) and r["auprc"] == pytest.approx(0.75 * 0.75 + 0.25 * 0.5)
    assert ranking.confusion_of(table, 0.5).first()["tp"] == 3 * 10**11
