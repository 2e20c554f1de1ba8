import zlib

import numpy as np
import pytest

from txnwatch.llm import quality_classifier as qc


def test_density_by_cholesky_equals_the_plain_formula(spark):
    rng = np.random.default_rng(3)
    d = len(qc.FEATURES)
    x = np.r_[rng.normal(0, 1, (80, d)) * np.arange(1, d + 1), rng.normal(1, 2, (120, d))]
    y = [0] * 80 + [1] * 120
    model = qc.fit(spark.createDataFrame([(r.tolist(), k) for r, k in zip(x, y)], "x array<double>, label int"), 0.3, 0.1)
    sets = [x[:80], x[80:]]
    scatter = [(s - s.mean(0)).T @ (s - s.mean(0)) for s in sets]
    pooled = sum(scatter) / 200
    spread = np.sqrt(np.diag(pooled))
    logs = []
    for s, sc in zip(sets, scatter):
        cov = (0.7 * sc / len(s) + 0.3 * pooled) / np.outer(spread, spread)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / d * np.eye(d)
        z = (x - s.mean(0)) / spread
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(s) / 200))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "w" * 50_000, "x"), (4, "some fine words", "x"), (4, "some fine words", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = "doc_id long, quality int, score int"
    for known, want in (([], 0.5), ([(4, 1, 0)], 1.0), ([(4, 1, 0), (4, 0, 0), (None, 1, 0), (3, 7, 1)], 0.0)):
        got = qc.classify(df, spark.createDataFrame(known, labels), lambda i: i == 2).collect()
        assert len(got) == len(rows) and {r.score for r in got} == {want}
    both = qc.classify(df, spark.createDataFrame([(4, 1, 0), (1, 0, 0)], labels), lambda i: i == 2).collect()
    assert len(both) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in both)
    assert qc.classify(df.where("doc_id > 9"), spark.createDataFrame([], labels), lambda i: i == 2).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = qc.op5_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(sf + "/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2
    acc = (held.predicted == held.quality).mean()
    print("AUC", auc, "accuracy", acc, "good kept", (good >= .7).mean(), "bad kept", (bad >= .7).mean())
    assert auc > 0.93 and acc > 0.93
