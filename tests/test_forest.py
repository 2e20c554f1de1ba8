import numpy as np
import pytest
from pyspark.sql import functions as F

from txnwatch.operators import forest as fo
from txnwatch.operators import models as mo

FEATS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, len(FEATS))).astype(float)
    y = ((x[:, 0] + x[:, 1] > 12) & (rng.random(600) < 0.7)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "txn_id long, label int, " + ", ".join(f"{f} double" for f in FEATS)).persist()
    counts = mo.class_counts(df)
    return df, mo.binned(df, FEATS, "txn_id", counts), counts


def _fit(data, spec, deal=None, **k):
    df, m, counts = data
    return fo.fit_forest(m.rows if deal is None else m.rows.repartition(deal), FEATS, m.cuts, spec, counts, mo.class_weights(*counts, "balanced"), **k)


def _scores(model, df):
    return [r["prob"] for r in model.score(df).orderBy("txn_id").collect()]


def _plain(bins, label, count, path, depth, spec, w):
    """Share of class 1 of every row by a tree grown one node at a time."""
    n0, n1 = count[label == 0].sum() * w[0], count[label == 1].sum() * w[1]

    def value(rows):
        a, b = count[rows & (label == 0)].sum() * w[0], count[rows & (label == 1)].sum() * w[1]
        return (a * a + b * b) / (a + b) if a + b else 0.0

    best = (1e-12 * (n0 + n1), None, None)
    everything = np.ones(len(label), bool)
    if n0 > 0 and n1 > 0 and depth < spec.max_depth:
        for f in fo.subsets(np.array([path], np.uint64), len(bins))[0]:
            for cut in np.unique(bins[f])[:-1]:
                left = bins[f] <= cut
                gain = value(left) + value(~left) - value(everything)
                if count[left].sum() and count[~left].sum() and gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    out = np.full(len(label), n1 / (n0 + n1) if n0 + n1 else 0.0)
    if best[1] is not None:
        left = bins[best[1]] <= best[2]
        for side, p in zip((left, ~left), fo.below(np.array([path], np.uint64))):
            out[side] = _plain(bins[:, side], label[side], count[side], p, depth + 1, spec, w)
    return out


def test_trees_are_those_of_one_node_at_a_time(data):
    df, m, counts = data
    spec, w = fo.ForestSpec(trees=3, max_depth=5), mo.class_weights(*counts, "balanced")
    rows = m.rows.collect()
    key, label = np.array([r["key"] for r in rows]), np.array([r["label"] for r in rows])
    bins = np.array([list(r["bins"]) for r in rows], np.uint8).T
    for t in range(spec.trees):
        count = fo.draws(key, spec, t).astype(float)
        own, path = count > 0, fo.root_of(spec, t)
        nodes = fo.grow(bins[:, own], label[own], count[own], path, 0, spec, w)
        got = fo.Forest(FEATS, m.cuts, spec, w, "").shares(nodes)[fo.reached(nodes, bins[:, own])]
        assert np.allclose(got, _plain(bins[:, own], label[own], count[own], path, 0, spec, w))


def test_bootstrap_draws_are_poisson():
    counts = fo.draws(np.arange(200_000), fo.ForestSpec(), 5)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert abs((counts * fo.draws(np.arange(200_000), fo.ForestSpec(), 6)).mean() - 1) < 0.02      # trees draw on their own


@pytest.mark.parametrize("rows_per_node", [400, 60, 5])
def test_tops_by_summed_histograms_give_the_same_forest(spark, data, rows_per_node):
    spec = fo.ForestSpec(trees=4, max_depth=8)
    whole, parts = _fit(data, spec), _fit(data, spec, deal=5, rows_per_node=rows_per_node)
    groups = spark.read.parquet(parts.path).where("slot >= 0").select("tree", "slot", F.length("nodes").alias("n")).collect()
    assert len(groups) > spec.trees                                          # no group holds a tree
    assert _scores(whole, data[0]) == _scores(parts, data[0])


def test_nodes_are_held_some_trees_at_a_time(spark, data, monkeypatch, tmp_path):
    model = _fit(data, fo.ForestSpec(trees=5, max_depth=6))
    expected = _scores(model, data[0])
    monkeypatch.setattr(fo, "NODES_AT_ONCE", 1)
    assert [len(p) for p in model.passes(spark)] == [1] * 5
    assert np.allclose(_scores(model, data[0]), expected)
    mo.save_model(spark, model, str(tmp_path / "m"))
    assert np.allclose(_scores(mo.load_model(spark, str(tmp_path / "m")), data[0]), expected)


def test_forest_learns_and_takes_odd_tables(spark, data):
    df, m, counts = data
    model = _fit(data, fo.ForestSpec(trees=30))
    auc = df.join(model.score(df).select("txn_id", "prob"), "txn_id").groupBy("label").agg(F.avg("prob").alias("p")).orderBy("label").collect()
    assert auc[1]["p"] > auc[0]["p"] + 0.5
    for few in (df.where("txn_id < 0"), df.where("txn_id < 1"), df.where("label = 0")):
        c = mo.class_counts(few)
        b = mo.binned(few, FEATS, "txn_id", c)
        got = fo.fit_forest(b.rows, FEATS, b.cuts, fo.ForestSpec(trees=3), c)
        assert all(p == 0.0 for p in _scores(got, df)) or sum(c) == c[1]


def test_attributions_add_up_over_passes(spark, data, monkeypatch):
    from txnwatch.operators import explain as ex

    df = data[0].where("txn_id % 20 = 0")
    model = _fit(data, fo.ForestSpec(trees=4, max_depth=6))

    def found():
        return [(r["base"], *r["phi"]) for r in ex.explain(df, model, FEATS, ["txn_id"]).orderBy("txn_id").collect()]

    expected = found()
    monkeypatch.setattr(fo, "NODES_AT_ONCE", 1)
    assert np.allclose(found(), expected)
    assert np.allclose(np.sum(expected, axis=1), _scores(model, df))
