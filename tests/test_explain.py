import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array

from txnwatch.operators import explain as ex
from txnwatch.operators import models as mo

FEATS = list("abcd")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 400
    X = rng.normal(size=(n, 4))
    X[:, 3] = (X[:, 3] > 0).astype(float)
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 3] + rng.normal(scale=0.5, size=n)) > 0.3).astype(int)
    pdf = pd.DataFrame(X, columns=FEATS)
    pdf["label"] = y
    pdf["txn_id"] = range(n)
    return X, spark.createDataFrame(pdf)


def game(E, x, S):
    """Expected score when the features of S are known: follow their splits, average over the others."""
    def of(t, level, place):
        here = t.levels[level].start + place
        if t.leaf[here]:
            return t.value[here]
        return below(t, level, place)

    def below(t, level, place):
        nxt = t.levels[level + 1] if level + 1 < len(t.levels) else None
        kids = [k for k in range(nxt.stop - nxt.start) if t.parent[nxt.start + k] == place]
        f = t.feat[nxt.start + kids[0]]
        if f in S:
            return of(t, level + 1, kids[0] if x[f] <= t.thr[nxt.start + kids[0]] else kids[1])
        cover = [t.share[nxt.start + k] / (t.share[t.prev[nxt.start + k]] if t.prev[nxt.start + k] >= 0 else 1) for k in kids]
        return sum(c * of(t, level + 1, k) for c, k in zip(cover, kids))

    return sum(below(t, -1, 0) if t.levels else t.base for t in E.trees)


SPECS = [mo.ModelSpec("dt", "histogram", {"rounds": 1, "rate": 1.0, "max_depth": 4, "l2": 0.0, "min_hessian": 0.0, "objective": "mean"}),
         mo.ModelSpec("rf", "forest", {"numTrees": 3, "maxDepth": 3}),
         mo.ModelSpec("gbt", "histogram", {"rounds": 4, "max_depth": 3}, weighting="positive"),
         mo.ModelSpec("leaves", "histogram", {"rounds": 4, "max_depth": None, "max_leaves": 7, "min_rows": 5}, weighting="positive")]


def _fit(spec, df, feats):
    rows, counts = mo.assemble(df, feats), mo.class_counts(df)
    return mo.fit(spec, rows, sum(counts), mo.binned(df, feats, "txn_id", counts))[0]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_tree_attributions_exact(spark, data, spec):
    X, df = data
    model = _fit(spec, df, FEATS)
    E = ex.explainer_for(spark, model, FEATS)
    p1 = mo.score(model, mo.assemble(df, FEATS)).select("txn_id", "prob").toPandas().sort_values("txn_id").prob.to_numpy()
    attr = ex.explain(df, model, FEATS, ["txn_id"]).toPandas().sort_values("txn_id")
    phi = np.stack(attr.phi.values)
    target = np.log(p1 / (1 - p1)) if E.unit == "log_odds" else p1
    assert np.abs(attr.base.values + phi.sum(1) - target).max() < 1e-9        # efficiency
    for r in range(4):                                                        # brute-force Shapley
        for i in range(4):
            others = [j for j in range(4) if j != i]
            val = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (game(E, X[r], set(S) | {i})
                                                                        - game(E, X[r], set(S)))
                      for k in range(4) for S in itertools.combinations(others, k))
            assert phi[r, i] == pytest.approx(val, abs=1e-9)


def test_linear_closed_form(spark, data):
    X, df = data
    spec = mo.ModelSpec("lr", "linear", {"maxIter": 100})
    model = mo.build_pipeline(spec, len(X)).fit(mo.with_weights(mo.assemble(df, FEATS), "balanced"))
    attr = ex.explain_linear(df, model, df, FEATS, ["txn_id"]).toPandas().sort_values("txn_id")
    raw = model.transform(mo.assemble(df, FEATS)).select(
        "txn_id", vector_to_array("rawPrediction")[1].alias("m")).toPandas().sort_values("txn_id")
    phi = np.stack(attr.phi.values)
    assert np.abs(attr.base.values + phi.sum(1) - raw.m.values).max() < 1e-9
    assert np.abs(phi.mean(0)).max() < 1e-9       # centred on the background


def test_reasons_signed_top3(spark):
    df = spark.createDataFrame([(1, [0.1, -3.0, 0.5, 0.5]), (2, [-1.0, -2.0, -0.5, -4.0])],
                               "txn_id long, phi array<double>")
    r = {x["txn_id"]: x for x in ex.top_reasons(df, FEATS).collect()}
    assert [r[1][f"reason_{i}"] for i in (1, 2, 3)] == ["c", "d", "a"]     # ties by feature order
    assert [r[2][f"reason_{i}"] for i in (1, 2, 3)] == ["c", "a", "b"]
    assert r[1]["reason_1_shap"] == 0.5
    drivers = ex.mean_abs(df, FEATS).collect()
    assert drivers[0]["feature"] == "b" and drivers[0]["mean_abs_shap"] == 2.5


def test_case_breakdown_adds_up_to_the_score(spark):
    """Every feature is listed, more than ten included: base + contributions = score."""
    feats = [f"f{i}" for i in range(15)]
    phi = [(-1) ** i * (i + 1) / 7 for i in range(15)]
    attr = spark.createDataFrame([(1, phi, 0.25)], "txn_id long, phi array<double>, base double")
    got = ex.case_breakdown(attr, feats).collect()
    assert [r["feature"] for r in got] == list(reversed(feats))
    assert got[0]["base"] + sum(r["contribution"] for r in got) == pytest.approx(0.25 + sum(phi))
    rows = spark.createDataFrame([(1, *[float(i) for i in range(14)], None)], "txn_id long, " + ", ".join(f"{f} double" for f in feats))
    points = {r["feature"]: (r["value"], r["attribution"]) for r in ex.attribution_points(attr, rows, feats, "txn_id").collect()}
    assert points["f3"] == (3.0, phi[3]) and points["f14"] == (0.0, phi[14])


def test_deep_tree_is_efficient_and_quick(spark):
    """A tree of thousands of leaves, 30 levels allowed: efficiency on every row."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(6000, 8))
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(8)]).assign(label=rng.integers(0, 2, 6000), txn_id=range(6000))
    feats = list(pdf.columns[:8])
    df = spark.createDataFrame(pdf)
    spec = {"rounds": 1, "rate": 1.0, "max_depth": 30, "l2": 0.0, "min_hessian": 0.0, "objective": "mean"}
    model = _fit(mo.ModelSpec("dt", "histogram", spec), df, feats)
    E = ex.tree_explainer(spark, model, 8)
    assert E.trees[0].leaf.sum() > 1000
    phi = ex.tree_shap(X[:200], E.trees, 8)
    assert np.abs(E.base + phi.sum(axis=1) - model.probabilities(X[:200])).max() < 1e-9


def _enumerated(x, predict, background):
    """Shapley values over all coalitions."""
    n = len(x)
    value = {}
    for k in range(n + 1):
        for s in itertools.combinations(range(n), k):
            rows = background.copy()
            rows[:, list(s)] = x[list(s)]
            value[s] = predict(rows).mean()
    return np.array([sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[tuple(sorted((*s, i)))] - value[s])
                         for k in range(n) for s in itertools.combinations([j for j in range(n) if j != i], k)) for i in range(n)])


def test_sampled_values_meet_enumeration(spark):
    rng = np.random.default_rng(5)
    feats = [f"f{i}" for i in range(6)]
    X = rng.normal(size=(60, 6))
    predict = ex.LogisticScore(np.array([2.0, -1.0, 0.5, 0.0, 1.5, -2.0]), -0.5)
    df = spark.createDataFrame(pd.DataFrame(X, columns=feats).assign(txn_id=range(60)))
    got = ex.explain_sampled(df.where("txn_id < 12"), predict, df, feats, ["txn_id"], permutations=40).toPandas().sort_values("txn_id")
    again = ex.explain_sampled(df.where("txn_id < 12").repartition(5), predict, df, feats, ["txn_id"], permutations=40).toPandas().sort_values("txn_id")
    for (_, r), (_, s) in zip(got.iterrows(), again.iterrows()):
        x = X[int(r.txn_id)]
        want, phi, error = _enumerated(x, predict, X), np.array(r.phi), np.array(r.error)
        assert (np.abs(phi - want) <= 5 * error + 1e-9).all()
        assert error.max() < 0.02
        assert r.base + phi.sum() == pytest.approx(predict(x[None])[0], abs=1e-12)
        assert phi == pytest.approx(np.array(s.phi), abs=1e-12)
        assert phi[3] == pytest.approx(0, abs=1e-12)          # no weight, no effect


def test_logistic_champion_is_explained_in_probability(spark, data):
    X, df = data
    model = mo.build_pipeline(mo.ModelSpec("lr", "linear", {"maxIter": 50}), len(X)).fit(mo.with_weights(mo.assemble(df, FEATS), "balanced"))
    attr = ex.explain(df, model, FEATS, ["txn_id"], background=df.limit(200)).toPandas().sort_values("txn_id")
    p = mo.score(model, mo.assemble(df, FEATS)).select("txn_id", "prob").toPandas().sort_values("txn_id").prob.to_numpy()
    assert attr.base.to_numpy() + np.stack(attr.phi.values).sum(1) == pytest.approx(p, abs=1e-9)


def test_a_tree_is_explained_level_by_level():
    import tracemalloc

    from txnwatch.operators.explain import _level_tree, tree_shap

    n = (1 << 15) - 1                                    # a full tree of depth 14 on 12 features
    split = np.arange(n) < (n - 1) // 2
    cover = np.array([float(1 << (14 - (k + 1).bit_length() + 1)) for k in range(n)])
    nodes = {k: (2 * k + 1, 2 * k + 2, k % 12, 0.5, cover[k], 0.0) if split[k] else (-1, -1, -1, 0.0, cover[k], (k * 37 % 101) / 101) for k in range(n)}
    tree, x = _level_tree(nodes), np.random.default_rng(1).random((2, 12))
    tracemalloc.start()
    phi = tree_shap(x, [tree], 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    products = 2 * n * -(-tree.features // 2) * 8
    for row, own in zip(x, phi):
        at = 0
        while split[at]:
            at = 2 * at + (1 if row[nodes[at][2]] <= 0.5 else 2)
        assert abs(tree.base + own.sum() - nodes[at][5]) < 1e-9
    assert peak < 6 * products                           # factors of all nodes at once took 8.3 times the products
